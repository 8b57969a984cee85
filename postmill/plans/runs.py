"""Queries of identity, merging, observation, issues, audits and onboarding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.text import norm, norm_alnum
from postmill.operators import audit as A
from postmill.operators import classify as C
from postmill.operators import identity as I
from postmill.operators import merge as M
from postmill.operators import observe as O
from postmill.operators import onboarding as B
from postmill.plans import sqltext as S
from postmill.plans.registry import Registry
from postmill.runtime import load, materialize

R = Registry()
_ID = f"WITH k AS ({S.identity_cte()})"


def _jobs(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "jobs")


# --- identity --------------------------------------------------------------------------------------------------------

@R.add("identity_kind", _ID + " SELECT id, kind, key FROM k")
def identity_kind(spark: SparkSession, sf: str) -> DataFrame:
    return I.with_identity(_jobs(spark, sf), "i").select("id", "i.kind", "i.key")


@R.add(
    "identity_candidates",
    _ID + """, c AS (SELECT id, unnest(list_filter([{'kind': kind, 'key': key}, CASE WHEN kind <> 'job_url' AND url IS NOT NULL THEN {'kind': 'job_url', 'key': url} END,
        CASE WHEN kind = 'job_url' THEN {'kind': 'company_title_location_source', 'key': concat_ws('|', co, ti, lo, so)} END], lambda x: x IS NOT NULL)) AS x,
        generate_subscripts(list_filter([1, CASE WHEN kind <> 'job_url' AND url IS NOT NULL THEN 1 END, CASE WHEN kind = 'job_url' THEN 1 END], lambda x: x IS NOT NULL), 1) AS pos FROM k)
    SELECT id, CAST(pos - 1 AS INTEGER) AS priority, x.kind AS kind, x.key AS key FROM c""",
)
def identity_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return I.with_candidates(_jobs(spark, sf)).select("id", F.explode("candidates").alias("c")).select("id", "c.priority", "c.kind", "c.key")


@R.add("dedupe_identity", _ID + " SELECT min(id) AS id, count(*) AS n_rows, kind, key FROM k GROUP BY kind, key")
def dedupe_identity(spark: SparkSession, sf: str) -> DataFrame:
    j = I.with_identity(_jobs(spark, sf), "i").select("id", "i")
    return I.first_ids(j, [F.col("i.kind"), F.col("i.key")], "id").select("id", "n_rows", F.col("k0").alias("kind"), F.col("k1").alias("key"))


@R.add("dedupe_page_or_title", "SELECT min(id) AS id FROM (SELECT id, trim(coalesce(job_url, '')) AS u, trim(coalesce(title, '')) AS t, trim(coalesce(location, '')) AS l FROM jobs) GROUP BY u, CASE WHEN u = '' THEN t END, CASE WHEN u = '' THEN l END")
def dedupe_page_or_title(spark: SparkSession, sf: str) -> DataFrame:
    return I.keep_first(_jobs(spark, sf).select("id", "job_url", "title", "location"), I.page_or_title(), F.asc("id")).select("id")


@R.add("duplicates_skipped", _ID + ", f AS (SELECT min(id) AS id FROM k GROUP BY kind, key) SELECT source_name, count(*) AS raw, count(f.id) AS kept, greatest(0, count(*) - count(f.id)) AS skipped FROM jobs LEFT JOIN f USING (id) GROUP BY 1")
def duplicates_skipped(spark: SparkSession, sf: str) -> DataFrame:
    j = I.with_identity(_jobs(spark, sf), "i").select("id", "source_name", "i")
    first = I.first_ids(j, [F.col("i.kind"), F.col("i.key")], "id").select(F.col("id").alias("kept_id"))
    g = j.join(first, j.id == first.kept_id, "left").groupBy("source_name").agg(F.count(F.lit(1)).alias("raw"), F.count("kept_id").alias("kept"))
    return g.withColumn("skipped", F.greatest(F.lit(0), F.col("raw") - F.col("kept")))


def _hash_sql() -> str:
    q = lambda x: f"coalesce(CAST(to_json({x}) AS VARCHAR), 'null')"
    parts = [("ats_type", S.norm("ats_type")), ("board_slug", S.norm("board_slug")), ("description", S.norm("description")), ("external_job_id", S.norm("external_job_id")), ("job_url", S.identity_url("job_url")), ("location", S.norm("location")), ("title", S.norm("title"))]
    body = " || ',' || ".join(f"'\"{k}\":' || {q(v)}" for k, v in parts)
    return f"SELECT id, sha256('{{' || {body} || '}}') AS hash FROM jobs"


@R.add("content_hash", _hash_sql())
def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return _jobs(spark, sf).select("id", I.content_hash().alias("hash"))


# --- merging ---------------------------------------------------------------------------------------------------------

_CUT = "2025-01-01"
_FIELDS = ["title", "location", "content_hash", "match_score", "status"]
_TIMES = ["first_seen_at", "last_seen_at", "last_updated_at"]


def _run(spark: SparkSession, sf: str, before: bool) -> DataFrame:
    s = load(spark, sf, "job_snapshots").where(F.col("snapshot_date") < _CUT if before else F.col("snapshot_date") >= _CUT)
    return O.latest(s, ["job_id"], F.desc("ingested_at"), F.desc("snapshot_id")).select("job_id", *_FIELDS, *_TIMES)


_RUNS = "WITH " + ", ".join(
    f"{n} AS (SELECT job_id, {', '.join(_FIELDS + _TIMES)} FROM job_snapshots WHERE snapshot_date {op} DATE '{_CUT}' QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ingested_at DESC NULLS LAST, snapshot_id DESC) = 1)" for n, op in (("o", "<"), ("n", ">="))
)
_DIFF = "(" + " OR ".join(f"o.{f} IS DISTINCT FROM n.{f}" for f in _FIELDS) + ")"
_ACTION = f"CASE WHEN o.job_id IS NULL THEN 'inserted' WHEN n.job_id IS NULL THEN 'kept' WHEN {_DIFF} THEN 'updated' ELSE 'unchanged' END"
_MERGED = _RUNS + f""", m AS (SELECT coalesce(n.job_id, o.job_id) AS job_id, {', '.join(f'CASE WHEN n.job_id IS NULL THEN o.{f} ELSE n.{f} END AS {f}' for f in _FIELDS)},
    coalesce(o.first_seen_at, n.first_seen_at) AS first_seen_at, greatest(o.last_seen_at, n.last_seen_at) AS last_seen_at,
    CASE WHEN o.job_id IS NULL THEN coalesce(n.last_updated_at, n.last_seen_at) WHEN n.job_id IS NULL OR NOT {_DIFF} THEN o.last_updated_at ELSE n.last_seen_at END AS last_updated_at,
    {_ACTION} AS action FROM o FULL OUTER JOIN n ON o.job_id = n.job_id)"""


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    return M.merge(_run(spark, sf, True), _run(spark, sf, False), key="job_id", fields=_FIELDS)


@R.add("merge_snapshot", _MERGED + " SELECT * FROM m")
def merge_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return _merged(spark, sf)


@R.add("merge_actions", _MERGED + " SELECT action, count(*) AS n FROM m GROUP BY 1")
def merge_actions(spark: SparkSession, sf: str) -> DataFrame:
    return _merged(spark, sf).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@R.add("merge_again", _MERGED + " SELECT CASE WHEN n.job_id IS NULL THEN 'kept' ELSE 'unchanged' END AS action, count(*) AS n FROM m LEFT JOIN n USING (job_id) GROUP BY 1")
def merge_again(spark: SparkSession, sf: str) -> DataFrame:
    """The same run merged twice: the second time nothing is inserted or updated."""
    once = materialize(_merged(spark, sf).drop("action"), "merged")
    return M.merge(once, _run(spark, sf, False), key="job_id", fields=_FIELDS).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@R.add(
    "match_existing",
    _ID + """, c AS (SELECT id, 0 AS p, kind, key FROM k UNION ALL SELECT id, 1, 'job_url', url FROM k WHERE kind <> 'job_url' AND url IS NOT NULL UNION ALL
        SELECT id, 1, 'company_title_location_source', concat_ws('|', co, ti, lo, so) FROM k WHERE kind = 'job_url'),
    j AS (SELECT c.*, batch_no FROM c JOIN jobs USING (id)), old AS (SELECT kind, key, min(id) AS row_id FROM j WHERE batch_no = 0 GROUP BY ALL)
    SELECT id, arg_min(row_id, p) AS row_id FROM j JOIN old USING (kind, key) WHERE batch_no > 0 GROUP BY id""",
)
def match_existing(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of later batches with the row of the history that their identities find."""
    j = I.with_candidates(_jobs(spark, sf)).select("id", "batch_no", "candidates")
    return M.match_existing(j.where("batch_no > 0"), j.where("batch_no = 0").withColumnRenamed("id", "row_id"), seq="id", row_id="row_id")


# --- reading ---------------------------------------------------------------------------------------------------------

@R.add("jobs_with_company", "SELECT j.id, j.company_name, c.sector, c.priority, c.n FROM jobs j LEFT JOIN (SELECT name, min(sector) AS sector, min(priority) AS priority, count(*) AS n FROM companies GROUP BY name) c ON j.company_name = c.name")
def jobs_with_company(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "companies").groupBy("name").agg(F.min("sector").alias("sector"), F.min("priority").alias("priority"), F.count(F.lit(1)).alias("n"))
    j = _jobs(spark, sf).select("id", "company_name")
    return j.join(c, j.company_name == c.name, "left").drop("name")


@R.add("jobs_filtered", f"SELECT id, match_score FROM jobs WHERE status = 'new' AND match_score >= 60 AND {S.norm('title')} LIKE '%engineer%'")
def jobs_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return _jobs(spark, sf).where((F.col("status") == "new") & (F.col("match_score") >= 60) & norm(F.col("title")).contains("engineer")).select("id", "match_score")


@R.add("top10_jobs", "SELECT id, match_score, last_seen_at FROM jobs ORDER BY match_score DESC NULLS LAST, last_seen_at DESC NULLS LAST, id DESC LIMIT 10")
def top10_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return _jobs(spark, sf).select("id", "match_score", "last_seen_at").orderBy(F.desc("match_score"), F.desc("last_seen_at"), F.desc("id")).limit(10)


@R.add("top_n_per_company", "SELECT company_name, id FROM jobs QUALIFY row_number() OVER (PARTITION BY company_name ORDER BY match_score DESC NULLS LAST, last_seen_at DESC NULLS LAST, title DESC NULLS LAST, id DESC) <= 5")
def top_n_per_company(spark: SparkSession, sf: str) -> DataFrame:
    return A.top_sample(_jobs(spark, sf).select("company_name", "id", "match_score", "last_seen_at", "title"), "company_name", 5, F.desc("match_score"), F.desc("last_seen_at"), F.desc("title"), F.desc("id")).select("company_name", "id")


_PRIO = "CASE lower(trim(coalesce(priority, ''))) WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"


def _prio():
    p = F.lower(F.trim(F.coalesce("priority", F.lit(""))))
    return F.when(p == "high", 1).when(p == "medium", 2).when(p == "low", 3).otherwise(4)


@R.add("watchlist_ranked", f"SELECT id, CAST(row_number() OVER (ORDER BY {_PRIO}, name, id) AS INTEGER) AS rank FROM companies")
def watchlist_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """The list has a fixed size; its rank over all is one small sort."""
    from pyspark.sql import Window

    return load(spark, sf, "companies").select("id", F.row_number().over(Window.orderBy(_prio(), "name", "id")).alias("rank"))


@R.add("watchlist_by_mode", "SELECT id, name FROM companies WHERE source_mode = 'api_allowed' ORDER BY name, id LIMIT 20")
def watchlist_by_mode(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "companies").where("source_mode = 'api_allowed'").select("id", "name").orderBy("name", "id").limit(20)


@R.add("missing_urls", "SELECT id, name, priority FROM companies WHERE trim(coalesce(careers_url, '')) = ''")
def missing_urls(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "companies").where(F.trim(F.coalesce("careers_url", F.lit(""))) == "").select("id", "name", "priority")


@R.add("filter_options", "SELECT DISTINCT source_mode, status FROM jobs")
def filter_options(spark: SparkSession, sf: str) -> DataFrame:
    return _jobs(spark, sf).select("source_mode", "status").distinct()


# --- observation -----------------------------------------------------------------------------------------------------

_SUMS = ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in O.COUNTERS)
_METRICS = f"""count(*) AS sources_checked, count(*) FILTER (trim(status) IN {S.in_list(C.SKIPPED)}) AS sources_skipped, count(*) FILTER (collector IN {S.in_list(C.API_COLLECTORS)}) AS api_sources_used,
    count(*) FILTER (collector = 'static_jsonld') AS static_jsonld_used, count(*) FILTER (collector IN {S.in_list(C.BROWSER_COLLECTORS)}) AS browser_collector_used, count(*) FILTER (fallback_used) AS browser_fallback_used,
    count(*) FILTER (status = 'api_collector_not_implemented') AS api_not_implemented, count(*) FILTER (status = 'manual_only') AS manual_only_skipped, count(*) FILTER (status = 'needs_url') AS needs_url_skipped,
    count(*) FILTER (intervention_required) AS interventions_required, count(*) FILTER (trim(status) IN {S.in_list(C.ERROR)}) AS errors, {_SUMS}"""


@R.add("source_metrics", f"SELECT {_METRICS} FROM source_observations")
def source_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return O.metrics(load(spark, sf, "source_observations"))


@R.add("source_metrics_by_source", f"SELECT source_name, {_METRICS} FROM source_observations GROUP BY 1")
def source_metrics_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return O.metrics(load(spark, sf, "source_observations"), ["source_name"])


@R.add("source_counts", _ID + ", f AS (SELECT min(id) AS id FROM k GROUP BY kind, key) SELECT source_name, count(*) AS raw, count(f.id) AS deduped, count(*) FILTER (match_score >= 50) AS relevant FROM jobs LEFT JOIN f USING (id) GROUP BY 1")
def source_counts(spark: SparkSession, sf: str) -> DataFrame:
    j = I.with_identity(_jobs(spark, sf), "i").select("id", "source_name", "match_score", "i")
    first = I.first_ids(j, [F.col("i.kind"), F.col("i.key")], "id").select(F.col("id").alias("kept_id"))
    return j.join(first, j.id == first.kept_id, "left").groupBy("source_name").agg(F.count(F.lit(1)).alias("raw"), F.count("kept_id").alias("deduped"), F.count_if(F.col("match_score") >= 50).alias("relevant"))


@R.add("status_pivot", "SELECT source_name, count(*) FILTER (status = 'new') AS \"new\", count(*) FILTER (status = 'saved') AS saved, count(*) FILTER (status = 'rejected') AS rejected FROM jobs WHERE status IN ('new', 'saved', 'rejected') GROUP BY 1")
def status_pivot(spark: SparkSession, sf: str) -> DataFrame:
    j = _jobs(spark, sf).where(F.col("status").isin("new", "saved", "rejected"))
    return j.groupBy("source_name").pivot("status", ["new", "saved", "rejected"]).count().fillna(0)


@R.add("overview", "SELECT (SELECT count(*) FROM jobs) AS jobs, (SELECT count(*) FROM jobs WHERE status = 'new') AS new_jobs, (SELECT count(*) FROM companies) AS companies, (SELECT count(*) FROM interventions WHERE status = 'open') AS open_issues")
def overview(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda t, name, cond="true": load(spark, sf, t).agg(F.count_if(F.expr(cond)).alias(name))
    return one("jobs", "jobs").crossJoin(one("jobs", "new_jobs", "status = 'new'")).crossJoin(one("companies", "companies")).crossJoin(one("interventions", "open_issues", "status = 'open'"))


_FAIL = f"coalesce(trim(status) IN {S.in_list([*C.ERROR, 'paused'])}, false)"
_GOOD = f"coalesce(trim(status) IN {S.in_list(C.SUCCESS)}, false)"


@R.add(
    "failure_streaks",
    f"""WITH a AS (SELECT *, sum(CASE WHEN {_FAIL} THEN 0 ELSE 1 END) OVER w AS island, max(CASE WHEN {_GOOD} THEN observed_at END) OVER w AS last_success_at FROM source_observations
        WINDOW w AS (PARTITION BY source_name ORDER BY observed_at, observation_id ROWS UNBOUNDED PRECEDING))
    SELECT observation_id, CAST(sum(CASE WHEN {_FAIL} THEN 1 ELSE 0 END) OVER (PARTITION BY source_name, island ORDER BY observed_at, observation_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS consecutive_failures, last_success_at FROM a""",
)
def failure_streaks(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "source_observations")
    st = F.trim(F.col("status"))
    s = O.streaks(o, key="source_name", order=[F.asc("observed_at"), F.asc("observation_id")], fails=st.isin(*C.ERROR, "paused"), succeeds=st.isin(*C.SUCCESS), at="observed_at")
    return s.select("observation_id", "consecutive_failures", "last_success_at")


@R.add(
    "first_last_seen",
    """WITH a AS (SELECT job_id, first_seen_at, last_seen_at, content_hash, lag(content_hash) OVER (PARTITION BY job_id ORDER BY ingested_at, snapshot_id) AS p FROM job_snapshots)
    SELECT job_id, min(first_seen_at) AS first_seen, max(last_seen_at) AS last_seen, count(*) FILTER (content_hash IS DISTINCT FROM p) AS changes FROM a GROUP BY 1""",
)
def first_last_seen(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("job_id").orderBy("ingested_at", "snapshot_id")
    s = load(spark, sf, "job_snapshots").select("job_id", "first_seen_at", "last_seen_at", "content_hash", F.lag("content_hash").over(w).alias("p"))
    return s.groupBy("job_id").agg(F.min("first_seen_at").alias("first_seen"), F.max("last_seen_at").alias("last_seen"), F.count_if(~F.col("content_hash").eqNullSafe(F.col("p"))).alias("changes"))


_ISSUE = f"""WITH i AS (SELECT *, {S.norm('company_name')} AS company_key, coalesce(nullif({S.norm(S.identity_url('source_url'))}, ''), {S.norm('company_name')}) AS url_key,
    coalesce(detected_at, created_at) AS seen, trim(coalesce(nullif(reason, ''), intervention_type, '')) AS why FROM interventions),
    g AS (SELECT company_key, url_key, arg_max(id, (coalesce(seen, TIMESTAMP '0001-01-01'), id)) AS latest_id, CAST(sum(greatest(1, coalesce(occurrence_count, 1))) AS BIGINT) AS occurrences, count(*) AS n_rows FROM i GROUP BY ALL),
    f AS (SELECT company_key, url_key, why, row_number() OVER (PARTITION BY company_key, url_key ORDER BY seen DESC NULLS LAST, id DESC) AS r FROM i WHERE why <> ''),
    d AS (SELECT company_key, url_key, why, min(r) AS r FROM f GROUP BY ALL), h AS (SELECT company_key, url_key, string_agg(why, ' > ' ORDER BY r) AS reasons FROM d GROUP BY ALL)"""


@R.add("intervention_queue", _ISSUE + " SELECT company_key, url_key, latest_id, occurrences, n_rows, coalesce(reasons, '') AS reasons FROM g LEFT JOIN h USING (company_key, url_key)")
def intervention_queue(spark: SparkSession, sf: str) -> DataFrame:
    c = O.collapse(load(spark, sf, "interventions"))
    return c.select("company_key", "url_key", F.col("latest.id").alias("latest_id"), F.col("occurrence_count").alias("occurrences"), F.col("active_row_count").alias("n_rows"), F.array_join("reasons", " > ").alias("reasons"))


@R.add("intervention_history", "SELECT id, coalesce(resolved_at, detected_at, created_at) AS closed_at FROM interventions ORDER BY closed_at DESC NULLS LAST, id DESC LIMIT 20")
def intervention_history(spark: SparkSession, sf: str) -> DataFrame:
    i = load(spark, sf, "interventions").select("id", F.coalesce("resolved_at", "detected_at", "created_at").alias("closed_at"))
    return i.orderBy(F.desc("closed_at"), F.desc("id")).limit(20)


@R.add(
    "status_with_fallback",
    _ISSUE + f""", o AS (SELECT company_key, count(*) AS n, min(latest_id) AS only_id FROM g GROUP BY 1), s AS (SELECT id, {S.norm('company_name')} AS co, coalesce(nullif({S.norm(S.identity_url('careers_url'))}, ''), {S.norm('company_name')}) AS u FROM sources)
    SELECT s.id, coalesce(g.latest_id, CASE WHEN o.n = 1 THEN o.only_id END) AS issue_id FROM s LEFT JOIN g ON s.co = g.company_key AND s.u = g.url_key LEFT JOIN o ON s.co = o.company_key""",
)
def status_with_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return O.with_issues(load(spark, sf, "sources"), load(spark, sf, "interventions")).select("id", F.col("issue.latest.id").alias("issue_id"))


@R.add("notes_fold")
def notes_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Notes of a company's issues in one text; a fold, which SQL does not have."""
    return O.fold_notes(load(spark, sf, "interventions").where("company_name is not null"), key="company_name", order=["created_at", "id"], note="notes")


# --- audits ----------------------------------------------------------------------------------------------------------

def _audit_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    s = _jobs(spark, sf).select(F.col("id").alias("seq"), "company_name", "external_job_id", "job_url", "title", "location", F.lit(None).cast("string").alias("manual_found"), F.lit(None).cast("string").alias("manual_relevant"))
    m = O.latest(load(spark, sf, "job_snapshots"), ["job_id"], F.desc("ingested_at"), F.desc("snapshot_id"))
    m = m.select(F.col("snapshot_id").alias("seq"), "company_name", "external_job_id", F.lit(None).cast("string").alias("job_url"), "title", "location", F.when(F.col("match_score") >= 50, "yes").otherwise("no").alias("manual_relevant"))
    return s, m


@R.add("audit_link")
def audit_link(spark: SparkSession, sf: str) -> DataFrame:
    return A.link(*_audit_sides(spark, sf))


@R.add("audit_metrics")
def audit_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return A.verdict(A.metrics(A.verdicts(*_audit_sides(spark, sf))))


_IDS = lambda u, p: f"nullif(regexp_extract(coalesce({u}, ''), '[?&]jobId=([^&#]+)', 1), '') AS {p}q, upper(nullif(regexp_extract(coalesce({u}, ''), '(?i)(R_\\d+(?:-\\d+)?|JR-?\\d+(?:-\\d+)?)', 1), '')) AS {p}r, CASE WHEN {S.host(u)} IS NOT NULL THEN {S.scheme(u)} || '://' || {S.host(u)} || regexp_replace(coalesce({S.path(u)}, ''), '/+$', '') END AS {p}p"


@R.add(
    "recall_by_address",
    f"""WITH e AS (SELECT id AS expected_id, {_IDS('source_url', 'e')} FROM interventions), r AS (SELECT id AS row_id, {_IDS('job_url', 'r')} FROM jobs),
    h AS (SELECT expected_id, row_id FROM e JOIN r ON eq = rq UNION ALL SELECT expected_id, row_id FROM e JOIN r ON er = rr AND NOT (eq IS NOT NULL AND rq IS NOT NULL)
        UNION ALL SELECT expected_id, row_id FROM e JOIN r ON ep = rp AND NOT (eq IS NOT NULL AND rq IS NOT NULL) AND NOT (er IS NOT NULL AND rr IS NOT NULL))
    SELECT expected_id, min(row_id) AS row_id, 'url' AS how FROM h GROUP BY 1""",
)
def recall_by_address(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "interventions").select(F.col("id").alias("expected_id"), F.lit(None).cast("string").alias("title"), F.col("source_url").alias("job_url"))
    return A.match_expected(e, _jobs(spark, sf).select(F.col("id").alias("row_id"), "title", "job_url"))


@R.add(
    "unique_title_match",
    f"""WITH t AS (SELECT {S.norm_alnum('title')} AS t, count(*) AS n, min(id) AS row_id FROM jobs GROUP BY 1)
    SELECT snapshot_id AS expected_id, row_id, 'title' AS how FROM job_snapshots JOIN t ON {S.norm_alnum('job_snapshots.title')} = t WHERE n = 1 AND t <> ''""",
)
def unique_title_match(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "job_snapshots").select(F.col("snapshot_id").alias("expected_id"), "title", F.lit(None).cast("string").alias("job_url"))
    return A.match_expected(e, _jobs(spark, sf).select(F.col("id").alias("row_id"), "title", "job_url"))


@R.add(
    "validation_errors",
    f"""WITH b AS (SELECT id AS line, 'blank' AS rule, 'location' AS field FROM jobs WHERE {S.norm('location')} = '' UNION ALL SELECT id, 'blank', 'job_url' FROM jobs WHERE {S.norm('job_url')} = ''),
    d AS (SELECT id AS line, min(id) OVER (PARTITION BY {S.norm_alnum('company_name')}, {S.norm_alnum('title')}, {S.norm_alnum('location')}) AS f FROM jobs)
    SELECT * FROM b UNION ALL SELECT line, 'duplicate', 'company_name+title+location' FROM d WHERE line > f""",
)
def validation_errors(spark: SparkSession, sf: str) -> DataFrame:
    j = _jobs(spark, sf).select(F.col("id").alias("line"), "company_name", "title", "location", "job_url")
    return A.validate(j, line="line", required=["location", "job_url"], booleans=[], unique=["company_name", "title", "location"])


@R.add("recent_sample", "SELECT company_name, id FROM jobs WHERE last_seen_at IS NULL OR last_seen_at >= TIMESTAMP '2025-12-01 00:00:00' - INTERVAL 90 DAY QUALIFY row_number() OVER (PARTITION BY company_name ORDER BY match_score DESC NULLS LAST, id) <= 3")
def recent_sample(spark: SparkSession, sf: str) -> DataFrame:
    j = A.recent(_jobs(spark, sf).select("company_name", "id", "match_score", "last_seen_at"), "last_seen_at", F.lit("2025-12-01 00:00:00").cast("timestamp"), 90)
    return A.top_sample(j, "company_name", 3, F.desc("match_score"), F.asc("id")).select("company_name", "id")


@R.add("expected_presence", f"SELECT c.id, count(d.doc_id) AS n_docs FROM companies c LEFT JOIN (SELECT doc_id, trim(str_split(split_part(text, chr(10), 2), ' - ')[1]) AS co FROM documents WHERE doc_kind = 'posting') d ON {S.norm_alnum('c.name')} = {S.norm_alnum('d.co')} GROUP BY 1")
def expected_presence(spark: SparkSession, sf: str) -> DataFrame:
    """Companies with the number of documents whose second line names them."""
    d = load(spark, sf, "documents").where("doc_kind = 'posting'").select("doc_id", norm_alnum(F.split(F.split_part(F.col("text"), F.lit("\n"), F.lit(2)), " - ", -1)[0]).alias("k"))
    c = load(spark, sf, "companies").select("id", norm_alnum(F.col("name")).alias("k"))
    return c.join(d, "k", "left").groupBy("id").agg(F.count("doc_id").alias("n_docs"))


# --- onboarding ------------------------------------------------------------------------------------------------------

@R.add(
    "alias_join",
    f"""WITH i AS (SELECT DISTINCT company_name AS i FROM jobs), e AS (SELECT DISTINCT name AS e FROM companies),
    keys(kind, n, k) AS (SELECT 'i', i, list_distinct_ordered FROM (SELECT i, list_filter([{S.norm_key('i')}, {S.norm_key("regexp_replace(coalesce(i, ''), '\\([^)]*\\)', ' ', 'g')")}], lambda x: x <> '')
        || list_filter(list_transform(regexp_extract_all(coalesce(i, ''), '\\(([^)]*)\\)', 1), lambda x: {S.norm_key('x')}), lambda x: x <> '') AS list_distinct_ordered FROM i)
        UNION ALL SELECT 'e', e, list_filter([{S.norm_key('e')}, {S.norm_key("regexp_replace(coalesce(e, ''), '\\([^)]*\\)', ' ', 'g')")}], lambda x: x <> '') || list_filter(list_transform(regexp_extract_all(coalesce(e, ''), '\\(([^)]*)\\)', 1), lambda x: {S.norm_key('x')}), lambda x: x <> '') FROM e),
    ik AS (SELECT n AS i, unnest(k) AS key, k[1] AS first FROM keys WHERE kind = 'i'), ek AS (SELECT n AS e, unnest(k) AS key FROM keys WHERE kind = 'e'),
    h AS (SELECT DISTINCT i, e, ik.key = first AND ik.key = {S.norm_key('e')} AS ex FROM ik JOIN ek USING (key)),
    g AS (SELECT i, count(DISTINCT CASE WHEN ex THEN e END) AS nx, min(CASE WHEN ex THEN e END) AS x, count(DISTINCT e) AS n, min(e) AS a FROM h GROUP BY 1),
    o AS (SELECT i.i, x, a, CASE WHEN n IS NULL THEN 'none' WHEN nx = 1 THEN 'exact' WHEN nx > 1 OR n > 1 THEN 'ambiguous' WHEN n = 1 THEN 'alias' ELSE 'none' END AS outcome FROM i LEFT JOIN g ON i.i = g.i)
    SELECT i AS input_name, CASE outcome WHEN 'exact' THEN x WHEN 'alias' THEN a END AS entry_name, outcome FROM o""",
)
def alias_join(spark: SparkSession, sf: str) -> DataFrame:
    return B.alias_join(_jobs(spark, sf), load(spark, sf, "companies"), input_name="company_name", entry_name="name")


@R.add(
    "best_url",
    f"SELECT s.id, CASE WHEN {S.is_public('s.careers_url')} THEN trim(s.careers_url) WHEN {S.is_public('c.u')} THEN trim(c.u) END AS url, CASE WHEN {S.is_public('s.careers_url')} THEN 'source' WHEN {S.is_public('c.u')} THEN 'company' END AS origin FROM sources s LEFT JOIN (SELECT name, min(careers_url) AS u FROM companies GROUP BY 1) c ON s.company_name = c.name",
)
def best_url(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "companies").groupBy("name").agg(F.min("careers_url").alias("u"))
    s = load(spark, sf, "sources").join(c, F.col("company_name") == F.col("name"), "left")
    return s.select("id", B.best_url(("source", F.col("careers_url")), ("company", F.col("u"))).alias("b")).select("id", "b.url", F.col("b.source").alias("origin"))


@R.add("readiness_distribution", "SELECT website_category AS value, count(*) AS n, min(id) AS first_seq FROM companies GROUP BY 1")
def readiness_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return B.distribution(load(spark, sf, "companies"), "website_category", "id")


_LAST = "SELECT * FROM source_observations QUALIFY row_number() OVER (PARTITION BY source_name ORDER BY observed_at DESC NULLS LAST, observation_id DESC) = 1"


@R.add(
    "problem_sources",
    f"SELECT source_name, CASE WHEN NOT {S.is_public('careers_url')} THEN 'no usable url' WHEN status IN ('error', 'api_error', 'parse_error') THEN 'last run failed' WHEN status = 'paused' THEN 'waits for a person' WHEN coalesce(jobs_discovered, 0) = 0 THEN 'finds nothing' END AS problem, coalesce(CAST(greatest(0, floor((epoch_us(TIMESTAMP '2026-01-01') - epoch_us(observed_at)) / 86400000000.0)) AS BIGINT) >= 7, true) AS due FROM ({_LAST})",
)
def problem_sources(spark: SparkSession, sf: str) -> DataFrame:
    o = O.latest(load(spark, sf, "source_observations"), ["source_name"], F.desc("observed_at"), F.desc("observation_id"))
    p = B.problem(F.col("status"), F.lit(0), F.col("jobs_discovered"), F.col("careers_url"))
    return o.select("source_name", p.alias("problem"), B.due(F.col("observed_at").cast("timestamp"), F.lit("2026-01-01").cast("timestamp"), 7).alias("due"))


@R.add(
    "apply_outcomes",
    f"SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN NOT coalesce(s.is_active, false) THEN 'not_approved' WHEN NOT {S.is_public('s.careers_url')} THEN 'invalid_url' WHEN c.name IS NOT NULL AND coalesce(c.u = s.careers_url, false) THEN 'unchanged' WHEN c.name IS NOT NULL THEN 'updated' ELSE 'added' END AS outcome FROM sources s LEFT JOIN (SELECT name, min(careers_url) AS u FROM companies GROUP BY 1) c ON s.company_name = c.name) GROUP BY 1",
)
def apply_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "companies").groupBy("name").agg(F.min("careers_url").alias("u"))
    s = load(spark, sf, "sources").join(c, F.col("company_name") == F.col("name"), "left")
    o = B.apply_outcome(F.col("is_active"), F.col("careers_url"), F.col("name").isNotNull(), F.coalesce(F.col("u") == F.col("careers_url"), F.lit(False)))
    return s.select(o.alias("outcome")).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
