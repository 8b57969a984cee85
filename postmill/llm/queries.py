"""Queries of the problems of training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import boilerplate, dress, gazetteer, history_dedup, mixing, splitting, tokens
from postmill.plans.registry import Registry
from postmill.runtime import broadcast_if_small, load, materialize, scratch

R = Registry()

_WORDS = "array_to_string(list_sort(regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{Nd}}]+')), ' ')"
_SETS = f"""
    WITH k AS (
        SELECT id, min(id) OVER w AS kept_id, count(*) OVER w AS n FROM jobs
        WINDOW w AS (PARTITION BY {_WORDS.format("company_name")}, {_WORDS.format("title")}, {_WORDS.format("location")})
    )
"""


@R.add("p7_found", _SETS + "SELECT kept_id, id AS job_id FROM k WHERE id <> kept_id")
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    out = dress.copies(load(spark, sf, "jobs").select("id", "company_name", "title", "location"), "id", ["company_name", "title", "location"])
    return out.select(F.col("kept").alias("kept_id"), F.col("id").alias("job_id"))


@R.add("p7_records", _SETS + "SELECT DISTINCT kept_id, CAST(n AS BIGINT) AS copies FROM k")
def p7_records(spark: SparkSession, sf: str) -> DataFrame:
    out = dress.collapse(load(spark, sf, "jobs").select("id", "company_name", "title", "location"), "id", ["company_name", "title", "location"])
    return out.select(F.col("kept").alias("kept_id"), F.col("copies").cast("bigint").alias("copies"))


@R.add("p8_ids")
def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode(load(spark, sf, "documents"), "doc_id", "text")


@R.add("p2_found")
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    src = load(spark, sf, "sources").select(F.col("source_name"), F.col("careers_url").alias("host"), F.col("company_name").alias("company"), "lang").dropDuplicates(["source_name"])
    jobs = load(spark, sf, "jobs").select("id", "source_name", "title", "description").join(broadcast_if_small(src, 50_000), "source_name", "left")
    lines = materialize(boilerplate.page_lines(jobs, key="id", text="description", host="host", company="company", lang="lang"), "lines")
    titles = boilerplate.title_wording(jobs, lines.where("why = 'slot'").select("loose"), key="id", title="title", company="company")
    return lines.select(F.col("id").alias("job_id"), F.lit("description").alias("field"), "line_no").union(
        titles.select(F.col("id").alias("job_id"), F.lit("title").alias("field"), F.lit(1).alias("line_no"))
    )


@R.add("p6_found")
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    out = gazetteer.map_values(load(spark, sf, "jobs").select("id", "location"), load(spark, sf, "places"), key="id", value="location")
    return out.select(F.col("id").alias("job_id"), F.col("place_id").cast("int").alias("place_id"))


_KNOWN = ("id", "batch_no", "company_name", "title", "location", "job_url", "source_name", "external_job_id")


def _history(spark: SparkSession) -> history_dedup.History:
    return history_dedup.History(spark, scratch(spark, "history"))


@R.add("p1_found")
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Batch 0 as the history, the rest as one delivery; rows are read each by itself."""
    jobs = load(spark, sf, "jobs").select(*_KNOWN)
    c = materialize(history_dedup.canonical(jobs, load(spark, sf, "places")).join(jobs.select("id", "batch_no"), "id"), "canonical")
    kept = _history(spark)
    kept.append(c.where("batch_no = 0"))
    return kept.take(c.where("batch_no >= 1")).select("accepted_id", F.col("id").alias("job_id"))


@R.add("p1_batches")
def p1_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Batch after batch against all before it, each read alone: rows, repeats and what found them.

    ``by_id`` and ``by_page`` count rows found by sets of one element, ``by_title`` by equal titles and ``by_slip`` by titles
    that only bands bring together.
    """
    jobs, places = load(spark, sf, "jobs").select(*_KNOWN), load(spark, sf, "places")
    kept = _history(spark)
    kept.append(materialize(history_dedup.canonical(jobs.where("batch_no = 0"), places), "canonical"))
    sizes = materialize(jobs.groupBy("batch_no").agg(F.count(F.lit(1)).alias("n_rows")).where("batch_no >= 1"), "sizes")
    parts = [r[0] for r in sizes.select("batch_no").orderBy("batch_no").collect()]  # a handful of batch numbers
    out = None
    for b in parts:
        found = kept.take(materialize(history_dedup.canonical(jobs.where(F.col("batch_no") == b), places), "canonical"))
        how = [F.count(F.when(F.col("how") == x, 1)).alias(name) for x, name in (("id", "by_id"), ("page", "by_page"), ("equal", "by_title"), ("slip", "by_slip"))]
        found = found.agg(F.count(F.lit(1)).alias("repeats"), *how).withColumn("batch_no", F.lit(b))
        out = found if out is None else out.union(found)
    return sizes if out is None else sizes.join(out, "batch_no")


@R.add("p10_pieces")
def p10_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.pieces(load(spark, sf, "documents").select("doc_id", "text"), load(spark, sf, "split_limits"))


@R.add("p10_texts")
def p10_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces of all limits with their texts."""
    docs = load(spark, sf, "documents").select("doc_id", "text")
    return splitting.texts(splitting.pieces(docs, load(spark, sf, "split_limits")), docs)


def _mixed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Mixes as large as the sources they list, whatever the scarcest of them has."""
    sizes = materialize(mixing.sized(load(spark, sf, "documents"), key="doc_id", source="source", text="text"), "before")
    planned = materialize(mixing.plan(sizes, load(spark, sf, "mix_targets"), mixing.AVAILABLE), "planned")
    return mixing.mix(sizes, planned), planned


@R.add("p9_mix")
def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)[0]


@R.add("p9_shares")
def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.shares(*_mixed(spark, sf))
