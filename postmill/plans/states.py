"""Queries of kept state: upserts, transitions, episodes, lookups by precedence, references, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postmill.functions.text import norm
from postmill.operators import classify as C
from postmill.operators import observe as O
from postmill.operators import states as T
from postmill.plans import sqltext as S
from postmill.plans.registry import Registry
from postmill.runtime import load

R = Registry()
_NAME = S.norm("company_name")
_B = S.blank_to_null


def _companies(spark: SparkSession, sf: str) -> DataFrame:
    """One row per name: the smallest id."""
    c = load(spark, sf, "companies").withColumn("key", norm(F.col("name")))
    return O.latest(c, ["key"], F.asc("id"))


_COMPANIES = f"c AS (SELECT *, {S.norm('name')} AS key FROM companies QUALIFY row_number() OVER (PARTITION BY {S.norm('name')} ORDER BY id) = 1)"


@R.add(
    "company_upsert",
    f"""WITH {_COMPANIES}, n AS (SELECT {_NAME} AS key, careers_url, source_mode, company_name AS hint FROM sources QUALIFY row_number() OVER (PARTITION BY {_NAME} ORDER BY id DESC) = 1)
    SELECT coalesce(n.key, c.key) AS key, CASE WHEN n.key IS NULL THEN c.source_mode ELSE n.source_mode END AS source_mode, coalesce({_B('n.careers_url')}, c.careers_url) AS careers_url,
    CASE WHEN c.key IS NULL THEN 'inserted' WHEN n.key IS NULL THEN 'kept' WHEN n.source_mode IS DISTINCT FROM c.source_mode OR coalesce({_B('n.careers_url')}, c.careers_url) IS DISTINCT FROM c.careers_url THEN 'updated' ELSE 'unchanged' END AS action
    FROM c FULL JOIN n ON c.key = n.key""",
)
def company_upsert(spark: SparkSession, sf: str) -> DataFrame:
    new = O.latest(load(spark, sf, "sources").withColumn("key", norm(F.col("company_name"))), ["key"], F.desc("id"))
    return T.upsert(_companies(spark, sf).select("key", "source_mode", "careers_url"), new.select("key", "source_mode", "careers_url"), key="key", overwrite=["source_mode"], preserve=["careers_url"])


_FOLDED = ("careers_url", "ats_type", "collector", "status", "error")


@R.add(
    "source_state",
    "SELECT source_name, " + ", ".join(f"arg_max({_B(c)}, (observed_at, observation_id)) FILTER ({_B(c)} IS NOT NULL) AS {c}" for c in _FOLDED) + ", "
    + ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in O.COUNTERS) + ", min(observed_at) AS first_at, max(observed_at) AS last_at, count(*) AS n_rows FROM source_observations GROUP BY 1",
)
def source_state(spark: SparkSession, sf: str) -> DataFrame:
    """All observations of a source as one row: counters added, values kept until another is said."""
    return T.fold(load(spark, sf, "source_observations"), key="source_name", order=["observed_at", "observation_id"], last_said=list(_FOLDED), sums=list(O.COUNTERS), at="observed_at")


@R.add(
    "source_update",
    f"""WITH f AS (SELECT source_name, arg_max({_B('careers_url')}, (observed_at, observation_id)) FILTER ({_B('careers_url')} IS NOT NULL) AS url, max(observed_at) AS checked FROM source_observations GROUP BY 1)
    SELECT s.source_name, coalesce(f.url, s.careers_url) AS careers_url, f.checked AS last_checked_at, f.source_name IS NOT NULL AS changed FROM sources s LEFT JOIN f USING (source_name)""",
)
def source_update(spark: SparkSession, sf: str) -> DataFrame:
    """Sources marked as checked, with the address last seen."""
    seen = T.fold(load(spark, sf, "source_observations"), key="source_name", order=["observed_at", "observation_id"], last_said=["careers_url"], sums=[], at="observed_at")
    s = T.migrate(load(spark, sf, "sources").select("source_name", "careers_url"), "source_name string, careers_url string, last_checked_at timestamp_ntz", {})
    j = s.join(seen.select("source_name", F.col("careers_url").alias("url"), "last_at"), "source_name", "left")
    return T.transition(j, when=F.col("last_at").isNotNull(), changes={"careers_url": F.coalesce("url", "careers_url"), "last_checked_at": F.col("last_at")}).select("source_name", "careers_url", "last_checked_at", "changed")


@R.add("schema_migration", "SELECT source_name, coalesce(source_name, company_name) AS display_name, 'active' AS state, CAST(NULL AS BIGINT) AS checks, is_active FROM sources")
def schema_migration(spark: SparkSession, sf: str) -> DataFrame:
    s = load(spark, sf, "sources").select("source_name", "company_name", "is_active")
    return T.migrate(s, "display_name string, state string, checks bigint", {"display_name": F.coalesce("source_name", "company_name"), "state": F.lit("active")}).drop("company_name")


@R.add(
    "issue_update",
    f"""WITH ok AS (SELECT DISTINCT {_NAME} AS key FROM (SELECT * FROM source_observations QUALIFY row_number() OVER (PARTITION BY source_name ORDER BY observed_at DESC, observation_id DESC) = 1) WHERE trim(status) IN {S.in_list(C.SUCCESS)})
    SELECT i.id, CASE WHEN ok.key IS NOT NULL AND i.status <> 'resolved' THEN 'resolved' ELSE i.status END AS status, coalesce(ok.key IS NOT NULL AND i.status <> 'resolved', false) AS changed
    FROM interventions i LEFT JOIN ok ON {S.norm('i.company_name')} = ok.key""",
)
def issue_update(spark: SparkSession, sf: str) -> DataFrame:
    """Open issues of companies one of whose sources was last seen in order are resolved, all at once."""
    last = O.latest(load(spark, sf, "source_observations"), ["source_name"], F.desc("observed_at"), F.desc("observation_id"))
    good = last.where(F.trim("status").isin(*C.SUCCESS)).select(norm(F.col("company_name")).alias("key")).distinct()
    i = load(spark, sf, "interventions").select("id", "company_name", "status").withColumn("_k", norm(F.col("company_name"))).join(good, F.col("_k") == F.col("key"), "left")
    return T.transition(i, when=F.col("key").isNotNull() & (F.col("status") != "resolved"), changes={"status": F.lit("resolved")}).select("id", "status", "changed")


@R.add(
    "posting_status_update",
    """WITH l AS (SELECT job_id, status FROM job_snapshots WHERE status IS NOT NULL AND job_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ingested_at DESC, snapshot_id DESC) = 1)
    SELECT j.id, coalesce(l.status, j.status) AS status, coalesce(l.status IS DISTINCT FROM j.status AND l.status IS NOT NULL, false) AS changed FROM jobs j LEFT JOIN l ON j.id = l.job_id""",
)
def posting_status_update(spark: SparkSession, sf: str) -> DataFrame:
    s = load(spark, sf, "job_snapshots").where("status is not null and job_id is not null").select("job_id", F.col("status").alias("last"), "ingested_at", "snapshot_id")
    last = s.groupBy("job_id").agg(F.max_by("last", F.struct("ingested_at", "snapshot_id")).alias("last"))
    j = load(spark, sf, "jobs").select("id", "status").join(last, F.col("id") == F.col("job_id"), "left")
    return T.transition(j, when=F.col("last").isNotNull() & ~F.col("last").eqNullSafe(F.col("status")), changes={"status": F.col("last")}).select("id", "status", "changed")


@R.add("issue_episodes")
def issue_episodes(spark: SparkSession, sf: str) -> DataFrame:
    """Issues by company: a new episode begins with what is found after the one before was resolved."""
    i = load(spark, sf, "interventions").withColumn("company", norm(F.col("company_name"))).where("detected_at is not null")
    return T.episodes(i, keys=["company"], order=["detected_at", "id"], opened="detected_at", closed="resolved_at", count="occurrence_count")


@R.add(
    "pending_issue_of_source",
    f"""WITH p AS (SELECT *, {_NAME} AS co, coalesce({S.norm(S.identity_url('source_url'))}, '') AS u FROM interventions WHERE status <> 'resolved' QUALIFY row_number() OVER (PARTITION BY {_NAME}, coalesce({S.norm(S.identity_url('source_url'))}, '') ORDER BY detected_at DESC NULLS LAST, id DESC) = 1)
    SELECT s.source_name, p.id AS issue_id FROM sources s LEFT JOIN p ON {S.norm('s.company_name')} = p.co AND coalesce({S.norm(S.identity_url('s.careers_url'))}, '') = p.u""",
)
def pending_issue_of_source(spark: SparkSession, sf: str) -> DataFrame:
    from postmill.functions.urls import identity_url

    u = lambda c: F.coalesce(norm(identity_url(F.col(c))), F.lit(""))
    p = load(spark, sf, "interventions").where("status <> 'resolved'").select("id", "detected_at", norm(F.col("company_name")).alias("co"), u("source_url").alias("u"))
    p = O.latest(p, ["co", "u"], F.desc_nulls_last("detected_at"), F.desc("id")).select(F.col("id").alias("issue_id"), "co", "u")
    s = load(spark, sf, "sources").select("source_name", norm(F.col("company_name")).alias("_co"), u("careers_url").alias("_u"))
    return s.join(p, (F.col("_co") == F.col("co")) & (F.col("_u") == F.col("u")), "left").select("source_name", "issue_id")


@R.add(
    "config_with_stored",
    f"""WITH s AS (SELECT {_NAME} AS k, min({_B('careers_url')}) AS url, min(source_mode) AS mode, count(*) AS n FROM sources GROUP BY 1)
    SELECT id, coalesce({_B('c.careers_url')}, s.url) AS careers_url, CASE WHEN c.status = 'skip' THEN 'skip' ELSE coalesce({_B('c.source_mode')}, s.mode) END AS source_mode, coalesce(s.n, 0) AS stored FROM companies c LEFT JOIN s ON {S.norm('c.name')} = s.k""",
)
def config_with_stored(spark: SparkSession, sf: str) -> DataFrame:
    from postmill.functions.text import blank_to_null

    s = load(spark, sf, "sources").groupBy(norm(F.col("company_name")).alias("k")).agg(F.min(blank_to_null(F.col("careers_url"))).alias("url"), F.min("source_mode").alias("mode"), F.count(F.lit(1)).alias("n"))
    c = load(spark, sf, "companies").withColumn("_k", norm(F.col("name"))).join(s, F.col("_k") == F.col("k"), "left")
    mode = F.when(F.col("status") == "skip", "skip").otherwise(F.coalesce(blank_to_null(F.col("source_mode")), "mode"))
    return c.select("id", F.coalesce(blank_to_null(F.col("careers_url")), "url").alias("careers_url"), mode.alias("source_mode"), F.coalesce("n", F.lit(0)).alias("stored"))


@R.add(
    "address_by_precedence",
    f"""WITH k AS (SELECT id, {S.norm('name')} AS k FROM companies), u AS (
        SELECT {S.norm('name')} AS k, 0 AS r, 'companies' AS o, {_B('careers_url')} AS v FROM companies UNION ALL SELECT {_NAME}, 1, 'sources', {_B('careers_url')} FROM sources
        UNION ALL SELECT {_NAME}, 2, 'observations', {_B('careers_url')} FROM source_observations), b AS (SELECT k, min((r, v, o)) AS b FROM u WHERE v IS NOT NULL GROUP BY 1)
    SELECT id, b[2] AS value, coalesce(b[3], 'none') AS origin FROM k LEFT JOIN b USING (k)""",
)
def address_by_precedence(spark: SparkSession, sf: str) -> DataFrame:
    k = load(spark, sf, "companies").select("id", norm(F.col("name")).alias("key"))
    named = lambda t, c: load(spark, sf, t).withColumn("key", norm(F.col(c)))
    found = [("companies", named("companies", "name"), "key", "careers_url"), ("sources", named("sources", "company_name"), "key", "careers_url"), ("observations", named("source_observations", "company_name"), "key", "careers_url")]
    return T.by_precedence(k, "key", *found).drop("key")


@R.add("unknown_companies", f"SELECT company_name, count(*) AS n FROM jobs WHERE company_name IS NOT NULL AND {_NAME} NOT IN (SELECT {S.norm('name')} FROM companies) GROUP BY 1")
def unknown_companies(spark: SparkSession, sf: str) -> DataFrame:
    j = load(spark, sf, "jobs").where("company_name is not null").select("company_name", norm(F.col("company_name")).alias("k"))
    return T.orphans(j, _companies(spark, sf), key="k", parent_key="key").groupBy("company_name").agg(F.count(F.lit(1)).alias("n"))


@R.add(
    "broken_references",
    """SELECT 'jobs.source_name' AS rule, count(*) AS n FROM jobs WHERE source_name IS NOT NULL AND source_name NOT IN (SELECT source_name FROM sources)
    UNION ALL SELECT 'interventions.job_id', count(*) FROM interventions WHERE job_id IS NOT NULL AND job_id NOT IN (SELECT id FROM jobs)
    UNION ALL SELECT 'job_snapshots.job_id', count(*) FROM job_snapshots WHERE job_id IS NOT NULL AND job_id NOT IN (SELECT id FROM jobs)""",
)
def broken_references(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for t, k, p, pk in (("jobs", "source_name", "sources", "source_name"), ("interventions", "job_id", "jobs", "id"), ("job_snapshots", "job_id", "jobs", "id")):
        one = T.orphans(load(spark, sf, t).select(k), load(spark, sf, p), key=k, parent_key=pk).agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"{t}.{k}").alias("rule"), "n")
        out = one if out is None else out.union(one)
    return out


@R.add(
    "explanation_lookup",
    """SELECT job_id, arg_min(s, r) AS match_score, arg_min(o, r) AS origin FROM (
        SELECT id AS job_id, 0 AS r, 'jobs' AS o, match_score AS s FROM jobs WHERE match_score IS NOT NULL
        UNION ALL SELECT job_id, 1, 'snapshots', max(match_score) FROM job_snapshots WHERE match_score IS NOT NULL AND job_id IS NOT NULL GROUP BY 1) GROUP BY 1""",
)
def explanation_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Scores by posting: the saved one, else the highest a run has seen."""
    a = load(spark, sf, "jobs").where("match_score is not null").select(F.col("id").alias("job_id"), F.lit(0).alias("r"), F.lit("jobs").alias("o"), "match_score")
    b = load(spark, sf, "job_snapshots").where("match_score is not null and job_id is not null").groupBy("job_id").agg(F.max("match_score").alias("match_score"))
    both = a.union(b.select("job_id", F.lit(1), F.lit("snapshots"), "match_score"))
    return both.groupBy("job_id").agg(F.min_by("match_score", "r").alias("match_score"), F.min_by("o", "r").alias("origin"))


@R.add(
    "link_sheet",
    f"""WITH {_COMPANIES} SELECT id, key, coalesce(j.n, 0) AS postings, coalesce(s.n, 0) AS sources, coalesce(i.n, 0) AS issues, coalesce(o.n, 0) AS observations FROM c
    LEFT JOIN (SELECT {_NAME} AS k, count(*) AS n FROM jobs GROUP BY 1) j ON j.k = key LEFT JOIN (SELECT {_NAME} AS k, count(*) AS n FROM sources GROUP BY 1) s ON s.k = key
    LEFT JOIN (SELECT {_NAME} AS k, count(*) AS n FROM interventions GROUP BY 1) i ON i.k = key LEFT JOIN (SELECT {_NAME} AS k, count(*) AS n FROM source_observations GROUP BY 1) o ON o.k = key""",
)
def link_sheet(spark: SparkSession, sf: str) -> DataFrame:
    t = {n: (load(spark, sf, f), norm(F.col("company_name"))) for n, f in (("postings", "jobs"), ("sources", "sources"), ("issues", "interventions"), ("observations", "source_observations"))}
    return T.counts_of(_companies(spark, sf).select("id", "key"), "key", **t)


@R.add("status_rollup", "SELECT company_name, trim(status) AS status, count(*) AS n, CAST(grouping(company_name) * 2 + grouping(trim(status)) AS BIGINT) AS level FROM source_observations GROUP BY ROLLUP (company_name, trim(status))")
def status_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "source_observations").select("company_name", F.trim("status").alias("status")).rollup("company_name", "status").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


@R.add("any_flag", "SELECT company_name, coalesce(bool_or(fallback_used), false) AS any_fallback, coalesce(bool_or(intervention_required), false) AS any_intervention FROM source_observations GROUP BY 1")
def any_flag(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return load(spark, sf, "source_observations").groupBy("company_name").agg(one("fallback_used").alias("any_fallback"), one("intervention_required").alias("any_intervention"))


@R.add(
    "coverage",
    f"""SELECT {S.norm('s.company_name')} AS company, count(*) AS expected, count(j.id) AS matched, count(*) - count(j.id) AS missing, min(CASE WHEN j.id IS NULL THEN s.job_id END) AS first_missing
    FROM (SELECT DISTINCT job_id, company_name FROM job_snapshots WHERE job_id IS NOT NULL) s LEFT JOIN (SELECT DISTINCT id FROM jobs WHERE status = 'new') j ON s.job_id = j.id GROUP BY 1""",
)
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Postings that runs have seen against those kept as new, by company; the ids are rows of a join, never one list."""
    s = load(spark, sf, "job_snapshots").where("job_id is not null").select("job_id", "company_name").distinct()
    j = s.join(load(spark, sf, "jobs").where("status = 'new'").select("id").distinct(), F.col("job_id") == F.col("id"), "left")
    return j.groupBy(norm(F.col("company_name")).alias("company")).agg(
        F.count(F.lit(1)).alias("expected"), F.count("id").alias("matched"), F.count_if(F.col("id").isNull()).alias("missing"), F.min(F.when(F.col("id").isNull(), F.col("job_id"))).alias("first_missing")
    )


@R.add("candidates_distinct", "SELECT min(observation_id) AS id, count(*) AS n FROM source_observations GROUP BY company_name, source_name, careers_url, ats_type")
def candidates_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """One row per name, source, address and system, NULLs being equal; the smallest id stays."""
    return load(spark, sf, "source_observations").groupBy("company_name", "source_name", "careers_url", "ats_type").agg(F.min("observation_id").alias("id"), F.count(F.lit(1)).alias("n")).select("id", "n")


@R.add("candidates_ranked", "SELECT observation_id AS id, CAST(row_number() OVER (PARTITION BY company_name ORDER BY source_name NULLS FIRST, careers_url NULLS FIRST, observation_id) AS INTEGER) AS place FROM source_observations")
def candidates_ranked(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("company_name").orderBy("source_name", "careers_url", "observation_id")
    return load(spark, sf, "source_observations").select(F.col("observation_id").alias("id"), F.row_number().over(w).alias("place"))


@R.add("names_in_order", f"SELECT {_NAME} AS name, min(id) AS first_id FROM jobs GROUP BY 1")
def names_in_order(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "jobs").groupBy(norm(F.col("company_name")).alias("name")).agg(F.min("id").alias("first_id"))


_ACTIONS = {"captcha": "Solve it by hand", "login_required": "Log in by hand", "blocked": "Try again later"}


@R.add("action_text", f"SELECT id, CASE intervention_type {' '.join(f'WHEN {S.lit(k)} THEN {S.lit(v)}' for k, v in _ACTIONS.items())} ELSE 'Look into it' END AS action FROM interventions")
def action_text(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "interventions").select("id", T.action_text(F.col("intervention_type"), _ACTIONS, "Look into it").alias("action"))


@R.add("place_in_text")
def place_in_text(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "jobs").select("id", T.place_in(F.col("location"), ["remote", "hybrid"]).alias("place"))


@R.add(
    "observations_filtered",
    f"SELECT observation_id FROM source_observations WHERE trim(status) IN {S.in_list(C.SUCCESS)} AND NOT coalesce(fallback_used, false) AND NOT coalesce(intervention_required, false) AND coalesce(jobs_saved, 0) >= 1 AND error IS NULL AND {_NAME} <> ''",
)
def observations_filtered(spark: SparkSession, sf: str) -> DataFrame:
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    o = load(spark, sf, "source_observations")
    return o.where(F.trim("status").isin(*C.SUCCESS) & no("fallback_used") & no("intervention_required") & (F.coalesce("jobs_saved", F.lit(0)) >= 1) & F.col("error").isNull() & (norm(F.col("company_name")) != "")).select("observation_id")
