"""Queries of pages, feeds, walks and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.text import blank_to_null
from postmill.operators import classify as C
from postmill.operators import crawl as W
from postmill.operators import extract as E
from postmill.operators import identity as I
from postmill.operators.merge import Snapshots
from postmill.plans import sqltext as S
from postmill.plans.registry import Registry
from postmill.runtime import load, shared_dir
from postmill.sources import feeds
from postmill.streaming import streams as T

R = Registry()


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    """Descriptions as landed pages, with the source's address as base."""
    src = load(spark, sf, "sources").select("source_name", "careers_url")
    return load(spark, sf, "jobs").where("description is not null").select("id", "source_name", "description").join(src, "source_name").select("id", F.col("careers_url").alias("url"), F.col("description").alias("html"))


@R.add("extract_links")
def extract_links(spark: SparkSession, sf: str) -> DataFrame:
    return E.links(_pages(spark, sf), key="id", url="url", html="html")


def _cards(spark: SparkSession, sf: str) -> DataFrame:
    """Postings as they stand on a results page: a card between navigation and footer."""
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    j = load(spark, sf, "jobs").where("job_url is not null and title is not null").select("id", "job_url", "title", "location")
    html = F.concat(
        F.lit('<html><nav><a href="/careers">All roles</a></nav><article><h3><a href="'), esc("job_url"), F.lit('">'), esc("title"), F.lit('</a></h3><span class="location">'),
        esc("location"), F.lit("</span></article><footer><a href='/privacy'>Privacy</a></footer></html>"),
    )
    return j.select("id", F.col("job_url").alias("url"), html.alias("html"))


_CARDS = f"SELECT id, lower(regexp_extract(trim(job_url), '^[A-Za-z]+', 0)) || regexp_replace(trim(job_url), '^[A-Za-z]+', '') AS href, {S.clean('title')} AS title FROM jobs WHERE job_url IS NOT NULL AND title IS NOT NULL"


@R.add("extract_records", f"WITH c AS ({_CARDS}) SELECT id, 'card' AS strategy, 0 AS position, title, href FROM c UNION ALL SELECT id, 'link', 1, title, href FROM c WHERE title <> ''")
def extract_records(spark: SparkSession, sf: str) -> DataFrame:
    r = E.records(_cards(spark, sf), key="id", url="url", html="html")
    return r.select("id", "strategy", "position", "title", "href")


@R.add("extract_postings")
def extract_postings(spark: SparkSession, sf: str) -> DataFrame:
    return E.postings(_cards(spark, sf), key="id", url="url", html="html").select("id", "strategy", "title", "href")


@R.add("page_text")
def page_text(spark: SparkSession, sf: str) -> DataFrame:
    return E.page_text(_pages(spark, sf), key="id", html="html")


@R.add(
    "pagination_stop",
    f"""WITH k AS ({S.identity_cte()}), f AS (SELECT source_name AS site, batch_no AS page_no, kind || ' ' || key AS ident FROM k JOIN jobs USING (id)), a AS (SELECT site, ident, min(page_no) AS page_no FROM f GROUP BY ALL),
    n AS (SELECT site, page_no, count(*) AS n FROM a GROUP BY ALL), p AS (SELECT DISTINCT site, page_no FROM f), q AS (SELECT p.*, coalesce(n, 0) AS n FROM p LEFT JOIN n USING (site, page_no)),
    g AS (SELECT site, max(page_no) AS last, min(page_no) AS start, min(CASE WHEN n = 0 THEN page_no END) AS barren FROM q GROUP BY 1), s AS (SELECT *, least(coalesce(barren, 1073741824), start + 4, last) AS stop FROM g)
    SELECT site, CAST(stop - start + 1 AS INTEGER) AS pages_used, CASE WHEN barren = stop THEN 'no_new_job_urls' WHEN last = start THEN 'single_page_only' WHEN stop = start + 4 AND last > stop THEN 'max_pages_reached' ELSE 'next_disabled_or_missing' END AS stop_reason FROM s""",
)
def pagination_stop(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of a source as its pages."""
    j = I.with_identity(load(spark, sf, "jobs"), "i")
    f = j.select(F.col("source_name").alias("site"), F.col("batch_no").alias("page_no"), F.concat_ws(" ", "i.kind", "i.key").alias("ident"))
    return E.pagination(f, site="site", page_no="page_no", identity="ident", max_pages=5)


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    src = load(spark, sf, "sources").select("source_name", "careers_url")
    j = load(spark, sf, "jobs").select("id", "source_name", "job_url", "apply_url").join(src, "source_name")
    down = j.where("job_url is not null").select(F.col("careers_url").alias("url"), F.col("id").alias("position"), F.col("job_url").alias("link"))
    return down.union(j.where("job_url is not null and apply_url is not null").select(F.col("job_url").alias("url"), F.lit(0).cast("bigint").alias("position"), F.col("apply_url").alias("link")))


def _walk(spark: SparkSession, sf: str) -> DataFrame:
    return W.walk(load(spark, sf, "sources").select(F.col("source_name").alias("site"), F.col("careers_url").alias("url")), _edges(spark, sf))


@R.add("crawl_walk")
def crawl_walk(spark: SparkSession, sf: str) -> DataFrame:
    return _walk(spark, sf)


@R.add("crawl_findings")
def crawl_findings(spark: SparkSession, sf: str) -> DataFrame:
    return W.findings(_walk(spark, sf), _edges(spark, sf))


def _landed(spark: SparkSession, sf: str, system: str) -> DataFrame:
    j = load(spark, sf, "jobs").where((F.col("ats_type") == system) & F.col("raw_payload_json").isNotNull())
    return j.select("company_name", F.col("id").cast("string").alias("source_name"), "board_slug", "ats_type", F.col("raw_payload_json").alias("raw"))


@R.add(
    "feed_greenhouse",
    f"SELECT id, {S.blank_to_null(S.lit('X').replace(S.lit('X'), 'json_extract_string(raw_payload_json, ' + S.lit('$.title') + ')'))} AS title, json_extract_string(raw_payload_json, '$.absolute_url') AS job_url FROM jobs WHERE ats_type = 'greenhouse' AND raw_payload_json IS NOT NULL AND json_valid(raw_payload_json) AND json_type(raw_payload_json) = 'OBJECT'",
)
def feed_greenhouse(spark: SparkSession, sf: str) -> DataFrame:
    l = _landed(spark, sf, "greenhouse").where(F.ltrim("raw").startswith("{")).withColumn("payload", F.concat(F.lit('{"jobs":['), F.col("raw"), F.lit("]}")))
    l = l.where(F.try_parse_json("raw").isNotNull())
    return feeds.greenhouse(l).select(F.col("source_name").cast("bigint").alias("id"), "title", "job_url")


@R.add("feed_lever")
def feed_lever(spark: SparkSession, sf: str) -> DataFrame:
    l = _landed(spark, sf, "lever").where(F.try_parse_json("raw").isNotNull()).withColumn("payload", F.concat(F.lit("["), F.col("raw"), F.lit("]")))
    return feeds.lever(l).select(F.col("source_name").cast("bigint").alias("id"), "external_job_id", "title", "location", "description", "date_posted")


@R.add("feed_ashby")
def feed_ashby(spark: SparkSession, sf: str) -> DataFrame:
    l = _landed(spark, sf, "ashby").where(F.try_parse_json("raw").isNotNull()).withColumn("payload", F.concat(F.lit('{"jobPostings":['), F.col("raw"), F.lit("]}")))
    return feeds.ashby(l).select(F.col("source_name").cast("bigint").alias("id"), "external_job_id", "title", "location", "description")


@R.add(
    "feed_outcomes",
    "SELECT CASE WHEN json_valid(raw_payload_json) THEN 'well formed' ELSE 'parse_error' END AS state, count(*) AS n FROM jobs WHERE ats_type = 'greenhouse' AND raw_payload_json IS NOT NULL GROUP BY 1",
)
def feed_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    l = _landed(spark, sf, "greenhouse").withColumn("payload", F.col("raw"))
    o = feeds.outcomes(l, feeds.greenhouse(l))
    return o.select(F.when(F.col("status") == "parse_error", "parse_error").otherwise("well formed").alias("state")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@R.add("normalize_postings", f"SELECT id, {S.clean('company_name')} AS company_name, {S.clean('title')} AS title, {S.blank_to_null('location')} AS location FROM jobs")
def normalize_postings(spark: SparkSession, sf: str) -> DataFrame:
    j = load(spark, sf, "jobs")
    from postmill.functions.text import clean

    return j.select("id", clean(F.col("company_name")).alias("company_name"), clean(F.col("title")).alias("title"), blank_to_null(F.col("location")).alias("location"))


# --- streams ---------------------------------------------------------------------------------------------------------

def _stream(spark: SparkSession, sf: str, table: str) -> DataFrame:
    schema = load(spark, sf, table).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{table}.parquet*")


def _drain(spark: SparkSession, df: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and gives what it wrote."""
    at = f"{shared_dir(spark)}/postmill/stream-{uuid.uuid4().hex}"
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode(mode).trigger(availableNow=True).start()
    else:
        def keep(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{at}/out")

        q = df.writeStream.foreachBatch(keep).option("checkpointLocation", f"{at}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/out")


@R.add("stream_counts", "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_counts(spark: SparkSession, sf: str) -> DataFrame:
    e = _stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _drain(spark, T.window_counts(e, at="ts", kind="event_type"), "complete").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


_KEYS = f"WITH k AS ({S.identity_cte()})"


@R.add("stream_dedupe", _KEYS + " SELECT kind, key FROM k GROUP BY ALL")
def stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Identities seen, each once; the watermark is as wide as the data, so nothing is late."""
    j = _stream(spark, sf, "jobs").withColumn("seen", F.coalesce(F.col("last_seen_at").cast("timestamp"), F.lit("2024-01-01").cast("timestamp")))
    out = T.first_sightings(j, at="seen", late="5000 days").select(F.col("identity_kind").alias("kind"), F.col("identity_key").alias("key"))
    return _drain(spark, out)


_BAD = f"coalesce(trim(status) IN {S.in_list([*C.ERROR, 'paused'])}, false)"


@R.add(
    "stream_streak",
    f"""WITH a AS (SELECT *, sum(CASE WHEN {_BAD} THEN 0 ELSE 1 END) OVER (PARTITION BY source_name ORDER BY observed_at, observation_id ROWS UNBOUNDED PRECEDING) AS island FROM source_observations)
    SELECT observation_id, CAST(sum(CASE WHEN {_BAD} THEN 1 ELSE 0 END) OVER (PARTITION BY source_name, island ORDER BY observed_at, observation_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS consecutive_failures FROM a""",
)
def stream_streak(spark: SparkSession, sf: str) -> DataFrame:
    st = F.trim(F.col("status"))
    out = T.failure_streaks(_stream(spark, sf, "source_observations"), key="source_name", at="observed_at", order="observation_id", fails=st.isin(*C.ERROR, "paused"), succeeds=st.isin(*C.SUCCESS))
    return _drain(spark, out).select("observation_id", "consecutive_failures")


@R.add("stream_merge", "SELECT count(DISTINCT job_id) AS n_jobs FROM job_snapshots")
def stream_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots as a stream of runs, merged batch by batch into versions of one table."""
    from postmill.operators.observe import latest

    kept = Snapshots(spark, f"{shared_dir(spark)}/postmill/snapshots-{uuid.uuid4().hex}")
    fields = ["title", "location", "content_hash", "match_score", "status"]
    prepare = lambda b: latest(b, ["job_id"], F.desc("ingested_at"), F.desc("snapshot_id"))
    q = _stream(spark, sf, "job_snapshots").writeStream.foreachBatch(T.merge_into(kept, key="job_id", fields=fields, prepare=prepare))
    q.option("checkpointLocation", f"{kept.path}/state").trigger(availableNow=True).start().awaitTermination()
    return kept.read().agg(F.count(F.lit(1)).alias("n_jobs"))
