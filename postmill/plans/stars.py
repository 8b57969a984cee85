"""Queries of the star tables: the relational operators the engine stands on, joined, grouped and windowed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postmill.plans.registry import Registry
from postmill.runtime import broadcast_if_small, load

R = Registry()


def _r(c, n: int = 2):
    return F.round(c.cast("double"), n)


@R.add(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, round(CAST(sum(l_quantity) AS DOUBLE), 2) AS sum_qty, round(CAST(sum(l_extendedprice * (1 - l_discount)) AS DOUBLE), 0) AS revenue, round(avg(l_discount), 6) AS avg_discount, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
)
def pricing_summary(spark: SparkSession, sf: str) -> DataFrame:
    l = load(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    rev = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(_r(F.sum("l_quantity")).alias("sum_qty"), _r(F.sum(rev), 0).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count(F.lit(1)).alias("n"))


@R.add(
    "revenue_by_nation",
    """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 0) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""",
)
def revenue_by_nation(spark: SparkSession, sf: str) -> DataFrame:
    l, o = load(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount"), load(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = load(spark, sf, "customer").select("c_custkey", "c_nationkey").join(broadcast_if_small(load(spark, sf, "nation").select("n_nationkey", "n_name"), 1000), F.col("c_nationkey") == F.col("n_nationkey"))
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("n_name").agg(_r(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 0).alias("revenue"), F.count(F.lit(1)).alias("n"))


@R.add("orders_without_items", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orders_without_items(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").select("o_orderkey").join(load(spark, sf, "lineitem").select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


@R.add("events_cube", "SELECT event_type, date_trunc('month', ts) AS month, grouping_id(event_type, date_trunc('month', ts)) AS level, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY CUBE (event_type, date_trunc('month', ts))")
def events_cube(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").select("event_type", F.date_trunc("month", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("month"), "user_id")
    return e.cube("event_type", "month").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@R.add("events_running", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS last7 FROM events")
def events_running(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-6, 0)
    return load(spark, sf, "events").select("event_id", F.round(F.sum("value").over(w), 4).alias("last7"))


@R.add(
    "customer_sets",
    "SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'",
)
def customer_sets(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders")
    return load(spark, sf, "customer").select("c_custkey").intersect(o.where("o_orderstatus = 'F'").select("o_custkey")).subtract(o.where("o_orderpriority = '1-URGENT'").select("o_custkey"))
