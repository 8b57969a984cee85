"""Queries of scoring, classification and the listing filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.operators import classify as C
from postmill.operators import listing as L
from postmill.operators.scoring import WEIGHTS, Phrases, explain, score, top_per_group
from postmill.plans import sqltext as S
from postmill.plans.registry import Registry
from postmill.runtime import load

R = Registry()

#: A dictionary of words of the test data.
P = Phrases(
    target_roles=["platform engineer", "security engineer", "reliability", "infrastructure"],
    skills={"networking": ["network", "router"], "data": ["database", "sql"], "linux": ["linux"], "support": ["support", "help desk"], "scripting": ["rust", "kotlin"]},
    locations=["valdoria", "remote", "corvane"],
    support=["help desk", "ticket triage", "on call"],
    adjacent_roles=["consultant", "advisor"],
    conditional_roles=["coordinator", "specialist"],
    adjacent_context=["cloud", "frontend", "backend"],
    negatives=["junior", "graduate", "night shift"],
    support_context=["software", "search index"],
)


def _score_sql() -> str:
    t, x, lo, w = "t", "x", "lo", WEIGHTS
    first = lambda text, words: f"{S.hits(text, words)}[1]"
    gated = S.in_list(P.gated)
    return f"""
    WITH a AS (SELECT id, source_name, batch_no, lower(trim(coalesce(title, ''))) AS t, lower(trim(coalesce(location, ''))) AS lo, {S.search_text('title', 'location', 'description')} AS x FROM jobs),
    b AS (SELECT *, {first(t, P.target_roles)} AS rt, {first(x, P.target_roles)} AS rx0, {S.hits_by_name(x, P.skills)} AS sk0,
        len({S.hits(t, P.support_titles)}) > 0 AS titled, len({S.hits(x, P.support_context)}) > 0 AS ctx,
        list_filter({S.text_list(P.locations)}, lambda p: contains({lo}, lower(p)) OR contains({x}, lower(p))) AS pl,
        {S.hits(x, P.support)} AS su, {first(t, P.adjacent_roles)} AS ajt, {first(x, P.adjacent_roles)} AS ax0, {S.hits(x, P.adjacent_context)} AS ac,
        {first(t, P.conditional_roles)} AS ct0, {first(x, P.conditional_roles)} AS cx0, {S.hits(x, P.negatives)} AS ng FROM a),
    c AS (SELECT *, CASE WHEN rt IS NULL THEN rx0 END AS rx, list_filter(sk0, lambda s: s NOT IN {gated}) AS fr, CASE WHEN ajt IS NULL THEN ax0 END AS ax FROM b),
    d AS (SELECT *, CASE WHEN titled OR len(fr) > 0 OR ctx THEN sk0 ELSE fr END AS sk FROM c),
    e AS (SELECT *, len(su) > 0 AND (titled OR len(sk) > 0 OR ctx) AS sup, len(ac) > 0 OR len(sk) > 0 OR len(su) > 0 AS may FROM d),
    f AS (SELECT *, CASE WHEN may THEN ct0 END AS ct FROM e),
    g AS (SELECT *, CASE WHEN may AND ct IS NULL THEN cx0 END AS cx FROM f),
    h AS (SELECT *, CAST(greatest(0, least(100,
        CASE WHEN rt IS NOT NULL THEN {w['role_in_title']} ELSE 0 END + CASE WHEN rx IS NOT NULL THEN {w['role_in_text']} ELSE 0 END
        + least(len(sk) * {w['skill_per_match']}, {w['skill_cap']}) + least(len(pl) * {w['location_per_match']}, {w['location_cap']})
        + CASE WHEN sup THEN least(len(su) * {w['support_signal_bonus']}, {w['support_signal_cap']}) ELSE 0 END
        + CASE WHEN ajt IS NOT NULL THEN {w['adjacent_role_in_title']} ELSE 0 END + CASE WHEN ax IS NOT NULL THEN {w['adjacent_role_in_text']} ELSE 0 END
        + CASE WHEN ct IS NOT NULL THEN {w['conditional_adjacent_role_bonus']} ELSE 0 END + CASE WHEN cx IS NOT NULL THEN {w['adjacent_role_in_text']} ELSE 0 END
        - least(len(ng) * {w['negative_penalty']}, {w['negative_cap']}))) AS BIGINT) AS match_score FROM g),
    s AS (SELECT id, source_name, batch_no, match_score, array_to_string(list_filter([
            'title matches target role: ' || rt, 'description mentions target role: ' || rx, CASE WHEN len(sk) > 0 THEN 'matched skills: ' || array_to_string(sk, ', ') END,
            CASE WHEN len(pl) > 0 THEN 'location signals: ' || array_to_string(pl, ', ') END, CASE WHEN sup THEN 'support/ops signals: ' || array_to_string(su, ', ') END,
            'adjacent customer-facing technical fit: ' || ajt, 'adjacent customer-facing technical fit: ' || ax,
            'adjacent customer-facing technical fit: ' || ct || ' (technical context)', 'adjacent customer-facing technical fit: ' || cx || ' (technical context)'], lambda r: r IS NOT NULL), '; ') AS reasons,
        array_to_string(list_transform(ng, lambda n: 'negative signal: ' || n), '; ') AS flags,
        CASE WHEN match_score <= 0 THEN 'not_relevant' WHEN rt IS NOT NULL OR rx IS NOT NULL THEN 'core_target_fit'
             WHEN coalesce(ajt, ax, ct, cx) IS NOT NULL THEN 'adjacent_customer_facing_technical_fit' WHEN len(sk) > 0 OR sup THEN 'core_target_fit' ELSE 'not_relevant' END AS relevance_tier,
        match_score > 0 AND (rt IS NOT NULL OR rx IS NOT NULL OR coalesce(ajt, ax, ct, cx) IS NOT NULL OR len(sk) > 0 OR sup) AS is_relevant,
        array_to_string(list_filter([rt, ajt, ct], lambda r: r IS NOT NULL), ', ') AS title_matches FROM h)
    """


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    jobs = load(spark, sf, "jobs").select("id", "source_name", "batch_no", "title", "location", "description")
    return score(jobs, P)


@R.add("score_jobs", _score_sql() + "SELECT id, match_score, reasons, flags, relevance_tier, is_relevant FROM s")
def score_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("id", "match_score", F.array_join("match_reasons", "; ").alias("reasons"), F.array_join("risk_flags", "; ").alias("flags"), "relevance_tier", "is_relevant")


@R.add("score_explain", _score_sql() + "SELECT id, match_score, title_matches, relevance_tier FROM s")
def score_explain(spark: SparkSession, sf: str) -> DataFrame:
    jobs = load(spark, sf, "jobs").select("id", "title", "location", "description")
    return explain(jobs, P).select("id", "match_score", F.array_join("title_matches", ", ").alias("title_matches"), "relevance_tier")


@R.add("score_tiers", _score_sql() + "SELECT relevance_tier, is_relevant, count(*) AS n, CAST(sum(match_score) AS BIGINT) AS total FROM s GROUP BY ALL")
def score_tiers(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).groupBy("relevance_tier", "is_relevant").agg(F.count(F.lit(1)).alias("n"), F.sum("match_score").alias("total"))


@R.add("score_top3_per_source", _score_sql() + "SELECT source_name, id, match_score, relevance_tier, reasons FROM s WHERE is_relevant QUALIFY row_number() OVER (PARTITION BY source_name ORDER BY match_score DESC, id) <= 3")
def score_top3_per_source(spark: SparkSession, sf: str) -> DataFrame:
    # relevant rows rank first, so they can be told after the ranking; a filter before it would work out the score twice
    s = _scored(spark, sf).select("source_name", "id", "match_score", "relevance_tier", F.array_join("match_reasons", "; ").alias("reasons"), "is_relevant")
    return top_per_group(s, "source_name", 3, F.desc("is_relevant"), F.desc("match_score"), F.asc("id")).where("is_relevant").drop("is_relevant")


# --- sources ---------------------------------------------------------------------------------------------------------

def _system_sql(url: str, hint: str, category: str) -> str:
    low = lambda x: f"lower(trim(coalesce({x}, '')))"
    any_ = lambda x, ws: "(" + " OR ".join(f"contains({x}, {S.lit(w)})" for w in ws) + ")"

    def from_hint(x: str) -> str:
        t = f"replace(replace({low(x)}, '-', '_'), ' ', '_')"
        alias = f"CASE {t} " + " ".join(f"WHEN {S.lit(k)} THEN {S.lit(v)}" for k, v in C.SYSTEM_ALIASES.items()) + f" ELSE {t} END"
        known = S.in_list([*C.SYSTEM_WORDS, "restricted_board", "ultipro"])
        words = " ".join(f"WHEN {any_(low(x), w)} THEN {S.lit(s)}" for s, w in C.SYSTEM_WORDS.items())
        return f"coalesce(CASE WHEN {any_(low(x), ('linkedin', 'indeed', 'glassdoor'))} THEN 'restricted_board' END, CASE WHEN {alias} IN {known} THEN {alias} END, CASE {words} END)"

    h = S.host(url)
    under = lambda ns: " OR ".join(f"{h} = {S.lit(n)} OR ends_with({h}, {S.lit('.' + n)})" for n in ns)
    by_host = "CASE " + " ".join(f"WHEN {under(n)} THEN {S.lit(s)}" for s, n in C.SYSTEM_HOSTS.items()) + " END"
    return f"coalesce(CASE WHEN {S.is_public(url)} AND {any_(h, C.RESTRICTED)} THEN 'restricted_board' END, {from_hint(hint)}, {from_hint(category)}, CASE WHEN {S.is_public(url)} THEN {by_host} END)"


def _mode_sql(url: str, system: str, current: str) -> str:
    now = f"lower(trim(coalesce({current}, '')))"
    return (
        f"CASE WHEN {now} IN ('manual_only', 'avoid') THEN {now} WHEN NOT {S.is_public(url)} THEN 'needs_url' WHEN {system} = 'restricted_board' THEN 'manual_only' "
        f"WHEN {system} IN {S.in_list(C.API_SYSTEMS)} THEN 'api_allowed' WHEN {system} IN {S.in_list(C.HUMAN_SYSTEMS)} THEN 'human_in_loop' ELSE 'browser_allowed' END"
    )


_CLASSIFIED = f"WITH k AS (SELECT *, {_system_sql('careers_url', 'ats_hint', 'website_category')} AS system FROM companies), m AS (SELECT id, system, {_mode_sql('careers_url', 'system', 'source_mode')} AS mode FROM k)"


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "companies")
    s = C.detect_system(F.col("careers_url"), F.col("ats_hint"), F.col("website_category"))
    return c.withColumn("system", s).withColumn("mode", C.select_mode(F.col("careers_url"), F.col("system"), F.col("source_mode")))


@R.add("classify_companies", _CLASSIFIED + " SELECT id, system, mode FROM m")
def classify_companies(spark: SparkSession, sf: str) -> DataFrame:
    return _classified(spark, sf).select("id", "system", "mode")


@R.add("select_mode_counts", _CLASSIFIED + " SELECT system, mode, count(*) AS n FROM m GROUP BY ALL")
def select_mode_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _classified(spark, sf).groupBy("system", "mode").agg(F.count(F.lit(1)).alias("n"))


@R.add(
    "routing_outcomes",
    f"""
    WITH o AS (SELECT observation_id, careers_url, source_mode, ats_type, status, {_mode_sql('careers_url', 'ats_type', 'source_mode')} AS mode FROM source_observations),
    r AS (SELECT *, ats_type IN ('greenhouse', 'lever', 'ashby') AS has_api, coalesce(status IN ('success', 'no_jobs_found'), false) AS fine, mode = 'api_allowed' AS api,
        coalesce(status = 'success', false) AS page_fine FROM o),
    c AS (SELECT *, api AND NOT coalesce(has_api, false) AND coalesce(ats_type IN {S.in_list(C.API_SYSTEMS)}, false) AS waiting FROM r),
    d AS (SELECT *, CASE WHEN mode = 'manual_only' THEN 'manual_only' WHEN mode = 'needs_url' THEN 'needs_url' WHEN api AND has_api THEN ats_type || '_api' WHEN waiting THEN 'api_not_implemented'
        WHEN api THEN 'browser' WHEN mode = 'browser_allowed' AND page_fine THEN 'static_jsonld' WHEN mode = 'browser_allowed' THEN 'browser_after_jsonld' WHEN mode = 'human_in_loop' THEN 'browser' ELSE 'needs_url' END AS collector FROM c)
    SELECT observation_id, mode, collector, CASE WHEN collector = 'manual_only' THEN 'manual_only' WHEN mode = 'needs_url' THEN 'needs_url' WHEN ends_with(collector, '_api') THEN coalesce(status, 'api_error')
        WHEN waiting THEN 'api_collector_not_implemented' WHEN collector = 'static_jsonld' THEN 'success' WHEN starts_with(collector, 'browser') THEN 'completed' ELSE 'unsupported_source_mode' END AS outcome,
        collector IN ('browser_fallback', 'browser_after_jsonld') AS fallback, mode = 'manual_only' AS intervention FROM d
    """,
)
def routing_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "source_observations").withColumn("mode", C.select_mode(F.col("careers_url"), F.col("ats_type"), F.col("source_mode")))
    r = o.withColumn("r", C.route(F.col("mode"), F.col("ats_type"), F.col("status"), F.col("status"), fallback=False))
    return r.select("observation_id", "mode", "r.collector", F.col("r.status").alias("outcome"), F.col("r.fallback_used").alias("fallback"), F.col("r.intervention_required").alias("intervention"))


_READY = f"""
    CASE WHEN st IN {S.in_list(C.ERROR)} THEN 'error' WHEN st = 'api_collector_not_implemented' THEN 'api_not_implemented' WHEN st = 'needs_url' OR m = 'needs_url' THEN 'needs_url'
         WHEN st = 'manual_only' OR m = 'manual_only' THEN 'manual_only' WHEN st = 'paused' OR coalesce(intervention_required, false) THEN 'needs_human'
         WHEN co = 'static_jsonld' AND st IN {S.in_list(C.SUCCESS)} THEN 'ready_static_jsonld' WHEN co IN {S.in_list(C.BROWSER_COLLECTORS)} AND st IN {S.in_list(C.SUCCESS)} THEN 'ready_browser'
         WHEN m = 'api_allowed' THEN 'ready_api' WHEN m = 'browser_allowed' THEN 'ready_browser' WHEN m = 'human_in_loop' THEN 'needs_human' ELSE 'ready_browser' END"""
_OBS = f"WITH o AS (SELECT *, trim(coalesce(status, '')) AS st, trim(coalesce(source_mode, '')) AS m, trim(coalesce(collector, '')) AS co FROM source_observations), r AS (SELECT *, {_READY} AS ready FROM o)"


def _ready(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "source_observations")
    return o.withColumn("ready", C.readiness(F.col("status"), F.col("source_mode"), F.col("collector"), F.col("intervention_required")))


@R.add("readiness_labels", _OBS + " SELECT observation_id, ready FROM r")
def readiness_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _ready(spark, sf).select("observation_id", "ready")


_BY_REASON = {"timeout": "retry_later", "login required": "login_required"}


@R.add(
    "remediation_labels",
    _OBS + f""" SELECT observation_id, CASE trim(coalesce(error, '')) {' '.join(f'WHEN {S.lit(k)} THEN {S.lit(v)}' for k, v in _BY_REASON.items())} ELSE
        CASE WHEN ready = 'needs_url' OR st = 'needs_url' OR m = 'needs_url' THEN 'source_url_review' WHEN ready = 'manual_only' OR st = 'manual_only' OR m = 'manual_only' THEN 'manual_tracking'
             WHEN ready = 'api_not_implemented' OR st = 'api_collector_not_implemented' THEN 'api_pending' WHEN ready = 'error' OR st IN {S.in_list(C.ERROR)} THEN 'source_error'
             WHEN ready = 'needs_human' OR st = 'paused' THEN 'human_review' WHEN st IN {S.in_list(C.SUCCESS)} THEN 'monitor_only' ELSE 'review_needed' END END AS remediation FROM r""",
)
def remediation_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _ready(spark, sf).select("observation_id", C.remediation(F.col("error"), F.col("status"), F.col("source_mode"), F.col("ready"), _BY_REASON).alias("remediation"))


_RULES = {"cookie": ("cookie consent", "accept all"), "login": ("sign in", "log in"), "gate": ("choose a location",), "captcha": ("captcha",)}


@R.add("page_barriers", f"SELECT doc_id, array_to_string(list_filter([{', '.join('CASE WHEN ' + ' OR '.join(f'contains(lower(coalesce(text, {S.lit(str())})), {S.lit(w)})' for w in ws) + f' THEN {S.lit(n)} END' for n, ws in _RULES.items())}], lambda x: x IS NOT NULL), ',') AS barriers FROM documents")
def page_barriers(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", F.array_join(C.barriers(F.col("text"), _RULES), ",").alias("barriers"))


# --- listing filter --------------------------------------------------------------------------------------------------

def _signals_sql() -> str:
    r = L.ListingRules()
    starts = lambda x, ws: "(" + " OR ".join(f"starts_with({x}, {S.lit(w)})" for w in ws) + ")"
    own = f"({S.clean('external_job_id')} <> '' AND ({S.clean('ats_type')} <> '' OR {S.clean('board_slug')} <> ''))"
    generic = f"(t IN {S.in_list(r.generic_titles)} OR {starts('t', r.generic_starts)} OR regexp_matches(t, '\\b\\d+\\s+available jobs?\\b'))"
    ends = " OR ".join(f"ends_with(p, {S.lit(x)})" for x in r.index_paths)
    return f"""
    WITH a AS (SELECT id, source_name, source_mode, lower({S.title_text('title')}) AS t, trim(coalesce(job_url, '')) AS u, {own} AS own, regexp_replace(lower(coalesce({S.path("trim(coalesce(job_url, ''))")}, '')), '/+$', '') AS p FROM jobs),
    b AS (SELECT *, list_filter([CASE WHEN t = '' THEN 'missing_title' END, CASE WHEN {generic} THEN 'generic_title' END,
        CASE WHEN regexp_full_match(t, '[a-z0-9/&,\\- ]+\\(\\d+\\)') THEN 'facet_count_title' END,
        CASE WHEN {starts('t', r.marketing_starts)} OR ends_with(t, ' careers') OR ends_with(t, '?') THEN 'marketing_title' END,
        CASE WHEN u = '' AND NOT own THEN 'missing_url' END, CASE WHEN u <> '' AND NOT {S.is_public('u')} THEN 'non_actionable_url' END,
        CASE WHEN u <> '' AND NOT own AND p <> '' AND ({ends} OR regexp_matches(p, '/c/[^/]+-jobs$')) THEN 'index_or_category_url' END], lambda x: x IS NOT NULL) AS f FROM a),
    q AS (SELECT id, source_name, array_to_string(CASE WHEN {S.clean('source_mode')} IN ('browser_allowed', 'human_in_loop') AND NOT own AND len(f) > 0 THEN list_append(f, 'browser_without_external_id') ELSE f END, ',') AS signals FROM b)
    """


def _signals(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    s = L.quality_signals(c("title"), c("job_url"), c("external_job_id"), c("ats_type"), c("board_slug"), c("source_mode"))
    return load(spark, sf, "jobs").select("id", "source_name", F.array_join(s, ",").alias("signals"))


@R.add("quality_signals", _signals_sql() + "SELECT id, signals FROM q")
def quality_signals(spark: SparkSession, sf: str) -> DataFrame:
    return _signals(spark, sf).select("id", "signals")


@R.add("suspicious_rows", _signals_sql() + "SELECT source_name, count(*) AS n FROM q WHERE signals <> '' GROUP BY 1")
def suspicious_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _signals(spark, sf).where("signals <> ''").groupBy("source_name").agg(F.count(F.lit(1)).alias("n"))


@R.add("listing_filter")
def listing_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Postings kept and dropped by source."""
    c = F.col
    keep = L.probable_posting(c("title"), c("job_url"), c("description"), c("location"), c("external_job_id"), c("ats_type"), c("board_slug"))
    return load(spark, sf, "jobs").select("source_name", keep.alias("kept")).groupBy("source_name", "kept").agg(F.count(F.lit(1)).alias("n"))


