"""Queries of the general problems: timestamps, nested records, histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.operators.flatten import flatten, infer, table, tables, tags, write_tables
from postmill.operators.history import validity
from postmill.operators.timestamps import posting_instants
from postmill.plans.registry import Registry
from postmill.runtime import load, scratch

R = Registry()


@R.add("p3_found")
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    out = posting_instants(load(spark, sf, "jobs"), load(spark, sf, "sources"), load(spark, sf, "tz_abbrevs"))
    return out.where("utc_micros is not null").select("job_id", "field", "utc_micros")


@R.add("p3_basis")
def p3_basis(spark: SparkSession, sf: str) -> DataFrame:
    """How each value was understood, counted by field; 'none' are values that state no instant."""
    out = posting_instants(load(spark, sf, "jobs"), load(spark, sf, "sources"), load(spark, sf, "tz_abbrevs"))
    return out.groupBy("field", F.coalesce("basis", F.lit("none")).alias("basis")).agg(F.count(F.lit(1)).alias("n"))


@R.add("p4_found")
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """The whole pass, payloads included, written by tag; the links are read back from what was written."""
    return _written(spark, sf)[0].select(F.col("id").alias("job_id"), "path", "parent_path")


def _written(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    path = scratch(spark, "tables")
    write_tables(flatten(load(spark, sf, "jobs"), "id", "raw_payload_json"), path)
    return tables(spark, path, "bigint", "id"), path


@R.add("p4_tables")
def p4_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The flat tables, tagged, with what each row holds itself."""
    return flatten(load(spark, sf, "jobs"), "id", "raw_payload_json").withColumnRenamed("id", "job_id")


@R.add("p4_links")
def p4_links(spark: SparkSession, sf: str) -> DataFrame:
    """One row per table: its rows, its columns by an inferred schema, and how many parent links lead to a row of the
    table they should lead to; the rest hang on the record itself."""
    found, path = _written(spark, sf)
    out = None
    for tag in tags(spark, path):
        schema = infer(spark, path, tag)
        one = table(spark, path, tag, schema)
        above = tag.removesuffix("[]").rsplit("[]", 1)
        t = one.select("id", "parent_path").where("parent_path <> '$'")
        parents = found.where(F.col("tag") == above[0] + "[]").select("id", F.col("path").alias("parent_path"), F.lit(1).alias("_there")) if len(above) == 2 else None
        t = t.join(parents, ["id", "parent_path"], "left") if parents is not None else t.withColumn("_there", F.lit(None).cast("int"))
        counts = t.agg(F.count(F.lit(1)).alias("below"), F.count("_there").alias("linked"))
        row = one.agg(F.count(F.lit(1)).alias("n_rows")).join(counts).select(F.lit(tag).alias("tag"), F.lit(len(one.columns) - 5).alias("n_columns"), "n_rows", "below", "linked")
        out = row if out is None else out.union(row)
    return out if out is not None else spark.createDataFrame([], "tag string, n_columns int, n_rows bigint, below bigint, linked bigint")


@R.add(
    "p5_found",
    """
    WITH m AS (
        SELECT job_id, last_seen_at AS seen, lower(content_hash) AS h,
               row_number() OVER (PARTITION BY job_id, last_seen_at ORDER BY ingested_at DESC NULLS LAST, snapshot_id DESC) AS k
        FROM job_snapshots WHERE content_hash IS NOT NULL AND last_seen_at IS NOT NULL AND job_id IS NOT NULL
    ), c AS (
        SELECT job_id, seen, h, lag(h) OVER (PARTITION BY job_id ORDER BY seen) AS prev FROM m WHERE k = 1
    ), s AS (SELECT job_id, seen FROM c WHERE prev IS NULL OR prev <> h)
    SELECT job_id, CAST(row_number() OVER w AS INTEGER) AS version_no, epoch_us(seen) AS valid_from_us,
           coalesce(epoch_us(lead(seen) OVER w), 0) AS valid_to_us
    FROM s WINDOW w AS (PARTITION BY job_id ORDER BY seen)
    """,
)
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    out = validity(
        load(spark, sf, "job_snapshots"), entity="job_id", attribute="content_hash", seen_at="last_seen_at", ingested_at="ingested_at", tiebreak="snapshot_id"
    )
    return out.select("job_id", "version_no", "valid_from_us", "valid_to_us")
