"""Sources over time: counters, streaks, last success, open issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions.text import norm
from postmill.functions.urls import identity_url
from postmill.operators.classify import API_COLLECTORS, BROWSER_COLLECTORS, ERROR, SKIPPED, SUCCESS

COUNTERS = ("jobs_discovered", "jobs_scored", "jobs_relevant", "jobs_saved", "jobs_inserted", "jobs_updated", "jobs_unchanged", "duplicates_skipped")


def metrics(obs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts and sums over observations, one row per group or one in all; an empty input counts 0."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False))).alias
    st, co = F.col("status"), F.col("collector")
    aggs = [
        F.count(F.lit(1)).alias("sources_checked"), n(F.trim(st).isin(*SKIPPED))("sources_skipped"), n(co.isin(*API_COLLECTORS))("api_sources_used"),
        n(co == "static_jsonld")("static_jsonld_used"), n(co.isin(*BROWSER_COLLECTORS))("browser_collector_used"), n(F.col("fallback_used"))("browser_fallback_used"),
        n(st == "api_collector_not_implemented")("api_not_implemented"), n(st == "manual_only")("manual_only_skipped"), n(st == "needs_url")("needs_url_skipped"),
        n(F.col("intervention_required"))("interventions_required"), n(F.trim(st).isin(*ERROR))("errors"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in COUNTERS],
    ]
    return obs.groupBy(*(by or [])).agg(*aggs)


def streaks(events: DataFrame, *, key: str, order: list[Column], fails: Column, succeeds: Column, at: str) -> DataFrame:
    """``events`` with ``consecutive_failures`` and ``last_success_at`` as they were after each event.

    A failure adds one, anything else resets. Two windows over one sort by key and order.
    """
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    island = Window.partitionBy(key, "_reset").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    bad = F.coalesce(fails, F.lit(False))
    out = events.withColumn("_reset", F.sum(F.when(bad, 0).otherwise(1)).over(w))
    out = out.withColumn("consecutive_failures", F.sum(F.when(bad, 1).otherwise(0)).over(island))
    return out.withColumn("last_success_at", F.last(F.when(F.coalesce(succeeds, F.lit(False)), F.col(at)), ignorenulls=True).over(w)).drop("_reset")


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row per key by ``order`` (given descending)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def issue_key() -> list[Column]:
    """Company and address of an issue, in normal form; the company again where there is no address."""
    co, url = norm(F.col("company_name")), norm(identity_url(F.col("source_url")))
    return [co.alias("company_key"), F.coalesce(F.nullif(url, F.lit("")), co).alias("url_key")]


def _reason() -> Column:
    return F.trim(F.coalesce(F.nullif(F.col("reason"), F.lit("")), F.col("intervention_type"), F.lit("")))


def collapse(issues: DataFrame) -> DataFrame:
    """One row per company and address: the latest issue, occurrences added up, rows counted, reasons once each, latest
    first. NULL counts and counts below 1 are one occurrence."""
    at = F.coalesce(F.col("detected_at"), F.col("created_at"))
    rank = F.struct(at.alias("at"), F.col("id"))
    return issues.groupBy(*issue_key()).agg(
        F.max_by(F.struct("id", "company_name", "source_url", "intervention_type", "reason", "status", at.alias("at")), rank).alias("latest"),
        F.sum(F.greatest(F.lit(1), F.coalesce("occurrence_count", F.lit(1)))).alias("occurrence_count"),
        F.count(F.lit(1)).alias("active_row_count"),
        F.array_distinct(F.filter(F.transform(F.sort_array(F.collect_list(F.struct(at.alias("at"), F.col("id"), _reason().alias("r"))), asc=False), lambda x: x["r"]), lambda r: r != "")).alias("reasons"),
    )


def with_issues(sources: DataFrame, issues: DataFrame, *, company: str = "company_name", url: str = "careers_url") -> DataFrame:
    """``sources`` with the summary of their issues: that of company and address, else the company's only one."""
    c = collapse(issues).select("company_key", "url_key", F.struct("latest", "occurrence_count", "active_row_count").alias("s"))
    only = c.groupBy("company_key").agg(F.count(F.lit(1)).alias("n"), F.first("s").alias("only")).where("n = 1").select(F.col("company_key").alias("only_key"), "only")
    src = sources.withColumn("_co", norm(F.col(company))).withColumn("_url", F.coalesce(F.nullif(norm(identity_url(F.col(url))), F.lit("")), F.col("_co")))
    j = src.join(c, (F.col("_co") == F.col("company_key")) & (F.col("_url") == F.col("url_key")), "left").join(only, F.col("_co") == F.col("only_key"), "left")
    return j.withColumn("issue", F.coalesce("s", "only")).drop("_co", "_url", "company_key", "url_key", "only_key", "s", "only")


def fold_notes(rows: DataFrame, *, key: str, order: list[str], note: str) -> DataFrame:
    """(key, notes): notes of a key in order, each added after a blank line unless it stands in what is there already.

    One row's notes are one value, so a key's notes must fit in memory.
    """
    from postmill.functions.text import blank_to_null

    got = rows.where(blank_to_null(F.col(note)).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, blank_to_null(F.col(note)).alias("_note")))).alias("l"))
    fold = F.aggregate("l", F.lit(""), lambda acc, x: F.when(acc == "", x["_note"]).when(acc.contains(x["_note"]), acc).otherwise(F.concat(acc, F.lit("\n\n"), x["_note"])))
    return got.select(key, fold.alias("notes"))
