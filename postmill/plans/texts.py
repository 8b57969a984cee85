"""Queries of text and address functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions import text as T
from postmill.functions import urls as U
from postmill.plans import sqltext as S
from postmill.plans.registry import Registry
from postmill.runtime import load

R = Registry()


def _jobs(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    return load(spark, sf, "jobs").select("id", *cols)


@R.add("norm_text", f"SELECT id, {S.norm('title')} AS title, {S.norm('location')} AS location FROM jobs")
def norm_text(spark: SparkSession, sf: str) -> DataFrame:
    return _jobs(spark, sf, "title", "location").select("id", T.norm(F.col("title")).alias("title"), T.norm(F.col("location")).alias("location"))


@R.add("norm_alnum", f"SELECT id, {S.norm_alnum('title')} AS title, {S.norm_alnum('location')} AS location FROM jobs")
def norm_alnum(spark: SparkSession, sf: str) -> DataFrame:
    return _jobs(spark, sf, "title", "location").select("id", T.norm_alnum(F.col("title")).alias("title"), T.norm_alnum(F.col("location")).alias("location"))


@R.add("norm_key", f"SELECT id, {S.norm_key('company_name')} AS company_key FROM jobs")
def norm_key(spark: SparkSession, sf: str) -> DataFrame:
    return _jobs(spark, sf, "company_name").select("id", T.norm_key(F.col("company_name")).alias("company_key"))


@R.add("search_text", f"SELECT id, {S.search_text('title', 'location', 'description')} AS search_text FROM jobs")
def search_text(spark: SparkSession, sf: str) -> DataFrame:
    return _jobs(spark, sf, "title", "location", "description").select("id", T.search_text(F.col("title"), F.col("location"), F.col("description")).alias("search_text"))


@R.add("title_text", f"SELECT id, {S.title_text('title')} AS title FROM jobs")
def title_text(spark: SparkSession, sf: str) -> DataFrame:
    return _jobs(spark, sf, "title").select("id", T.title_text(F.col("title")).alias("title"))


@R.add("split_values", f"SELECT id, array_to_string(list_filter(list_transform(str_split_regex(coalesce(location, ''), '[/,;|]+'), lambda x: {S.clean('x')}), lambda x: x <> ''), '~') AS parts FROM jobs")
def split_values(spark: SparkSession, sf: str) -> DataFrame:
    return _jobs(spark, sf, "location").select("id", F.array_join(T.split_values(F.col("location"), "[/,;|]+"), "~").alias("parts"))


@R.add("parse_bool", f"SELECT observation_id, CASE WHEN {S.norm('CAST(fallback_used AS VARCHAR)')} IN ('true', 'yes', '1', 'y') THEN true WHEN {S.norm('CAST(fallback_used AS VARCHAR)')} IN ('false', 'no', '0', 'n') THEN false END AS used FROM source_observations")
def parse_bool(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "source_observations").select("observation_id", T.parse_bool(F.col("fallback_used").cast("string")).alias("used"))


@R.add("elapsed_days", "SELECT snapshot_id, CAST(greatest(0, floor((epoch_us(TIMESTAMP '2026-01-01 12:00:00') - epoch_us(last_seen_at)) / 86400000000.0)) AS BIGINT) AS days FROM job_snapshots WHERE last_seen_at IS NOT NULL")
def elapsed_days(spark: SparkSession, sf: str) -> DataFrame:
    s = load(spark, sf, "job_snapshots").where("last_seen_at is not null")
    return s.select("snapshot_id", T.days_since(F.lit("2026-01-01 12:00:00").cast("timestamp"), F.col("last_seen_at").cast("timestamp")).alias("days"))


@R.add("slug_company", "SELECT id, coalesce(nullif(regexp_replace(regexp_replace(coalesce(name, ''), '[^\\p{L}\\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'company') AS slug FROM companies")
def slug_company(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "companies").select("id", T.slug(F.col("name")).alias("slug"))


@R.add("list_text", "SELECT id, coalesce(nullif(array_to_string(match_reasons, ', '), ''), '-') AS reasons, coalesce(nullif(substr(replace(first_seen_at, 'T', ' '), 1, 19), ''), '-') AS seen FROM jobs")
def list_text(spark: SparkSession, sf: str) -> DataFrame:
    return _jobs(spark, sf, "match_reasons", "first_seen_at").select("id", T.list_text(F.col("match_reasons")).alias("reasons"), T.stamp(F.col("first_seen_at")).alias("seen"))


@R.add("parse_json_props", "SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total, count(*) AS n FROM events GROUP BY 1")
def parse_json_props(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return load(spark, sf, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count(F.lit(1)).alias("n"))


@R.add("url_parts", f"SELECT id, {S.scheme('job_url')} AS scheme, {S.host('job_url')} AS host, {S.path('job_url')} AS path, {S.query('job_url')} AS query FROM jobs")
def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("job_url")
    return _jobs(spark, sf, "job_url").select("id", U.scheme(u).alias("scheme"), U.host(u).alias("host"), U.path(u).alias("path"), U.query(u).alias("query"))


@R.add("url_identity", f"SELECT id, {S.identity_url('job_url')} AS url FROM jobs")
def url_identity(spark: SparkSession, sf: str) -> DataFrame:
    return _jobs(spark, sf, "job_url").select("id", U.identity_url(F.col("job_url")).alias("url"))


@R.add("url_crawl", f"SELECT id, {S.crawl_url('job_url')} AS url, {S.root_url('job_url')} AS root, {S.registrable(S.host('job_url'))} AS domain FROM jobs")
def url_crawl(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("job_url")
    return _jobs(spark, sf, "job_url").select("id", U.crawl_url(u).alias("url"), U.root_url(u).alias("root"), U.registrable(U.host(u)).alias("domain"))


_REQ = "upper(nullif(regexp_extract(coalesce(job_url, ''), '(?i)(R_\\d+(?:-\\d+)?|JR-?\\d+(?:-\\d+)?)', 1), ''))"
_PAGE = f"CASE WHEN {S.host('job_url')} IS NOT NULL THEN {S.scheme('job_url')} || '://' || {S.host('job_url')} || regexp_replace(coalesce({S.path('job_url')}, ''), '/+$', '') END"


@R.add("url_posting_ids", f"SELECT id, {_REQ} AS requisition_id, {_PAGE} AS page FROM jobs")
def url_posting_ids(spark: SparkSession, sf: str) -> DataFrame:
    p = U.posting_ids(F.col("job_url"))
    return _jobs(spark, sf, "job_url").select("id", p["requisition_id"].alias("requisition_id"), p["page"].alias("page"))


@R.add("boolish", "SELECT id, lower(trim(coalesce(priority, ''))) IN ('true', 'yes', '1', 'y') AS boolish, CASE WHEN lower(trim(coalesce(status, ''))) IN ('true', 'yes', '1', 'y') THEN true WHEN lower(trim(coalesce(status, ''))) IN ('false', 'no', '0', 'n') THEN false END AS state FROM companies")
def boolish(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "companies").select("id", T.parse_boolish(F.col("priority")).alias("boolish"), T.parse_bool(F.col("status")).alias("state"))


@R.add("table_cells", "SELECT id, coalesce(nullif(replace(replace(trim(coalesce(description, '')), '|', '\\|'), chr(10), ' '), ''), '-') AS cell, CASE WHEN match_score >= 60 THEN 'Yes' ELSE 'No' END AS good FROM jobs")
def table_cells(spark: SparkSession, sf: str) -> DataFrame:
    return _jobs(spark, sf, "description", "match_score").select("id", T.cell(F.col("description")).alias("cell"), T.yes_no(F.col("match_score") >= 60).alias("good"))


@R.add("notes_with_reason", f"""WITH n AS (SELECT id, {S.blank_to_null('notes')} AS o, {S.blank_to_null('reason')} AS r FROM interventions)
    SELECT id, CASE WHEN r IS NULL THEN o WHEN o IS NULL THEN r WHEN contains(o, r) THEN o ELSE o || chr(10) || chr(10) || r END AS notes FROM n""")
def notes_with_reason(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "interventions").select("id", T.merge_notes(F.col("notes"), F.col("reason")).alias("notes"))
