"""Merging a run into the snapshot before it: what is new, what changed, what stayed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postmill.runtime import _drop


def differs(left: str, right: str, fields: list[str]) -> Column:
    """Whether any field differs; NULL equals NULL only."""
    out = F.lit(False)
    for f in fields:
        out = out | ~F.col(f"{left}.{f}").eqNullSafe(F.col(f"{right}.{f}"))
    return out


def merge(old: DataFrame, new: DataFrame, *, key: str, fields: list[str], seen: str = "last_seen_at", first: str = "first_seen_at", changed: str = "last_updated_at") -> DataFrame:
    """The next snapshot with ``action``: 'inserted', 'updated', 'unchanged', or 'kept' for rows the run has not.

    Both sides need ``key``, unique, the ``fields`` and the three times. First sightings stay, last ones advance, the
    time of change moves with a change only. One full outer join; running it twice with the same run changes nothing
    but the action. NULL keys never meet.
    """
    o, n = old.alias("o"), new.alias("n")
    j = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    is_new, is_kept = F.col(f"o.{key}").isNull(), F.col(f"n.{key}").isNull()
    diff = differs("o", "n", fields)
    action = F.when(is_new, "inserted").when(is_kept, "kept").when(diff, "updated").otherwise("unchanged")
    pick = [F.coalesce(F.col(f"n.{key}"), F.col(f"o.{key}")).alias(key)]
    pick += [F.when(is_kept, F.col(f"o.{f}")).otherwise(F.col(f"n.{f}")).alias(f) for f in fields]
    pick += [
        F.coalesce(F.col(f"o.{first}"), F.col(f"n.{first}")).alias(first),
        F.greatest(F.col(f"o.{seen}"), F.col(f"n.{seen}")).alias(seen),
        F.when(is_new, F.coalesce(F.col(f"n.{changed}"), F.col(f"n.{seen}"))).when(is_kept | ~diff, F.col(f"o.{changed}")).otherwise(F.col(f"n.{seen}")).alias(changed),
        action.alias("action"),
    ]
    return j.select(*pick)


def match_existing(new: DataFrame, old: DataFrame, *, seq: str, row_id: str) -> DataFrame:
    """(seq, row_id): for each new row the existing row that its identities find, strongest identity first, smallest
    id among equals. Both sides carry ``candidates`` (array of struct(priority, kind, key)); the old side is known by
    all of its own. An equality join on (kind, key); candidates are three at most."""
    a = new.select(seq, F.explode("candidates").alias("c")).select(seq, "c.priority", "c.kind", "c.key")
    b = old.select(row_id, F.explode("candidates").alias("c")).select(F.col("c.kind").alias("kind"), F.col("c.key").alias("key"), row_id).groupBy("kind", "key").agg(F.min(row_id).alias(row_id))
    hit = a.join(b, ["kind", "key"])
    return hit.groupBy(seq).agg(F.min_by(row_id, "priority").alias(row_id))


def assign_ids(df: DataFrame, start: int, *order: Column) -> DataFrame:
    """Dense ids after ``start`` in ``order``: counts per range of the order, then positions inside; no single task."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    laid = laid.withColumn("_p", F.shiftright("_m", 33).cast("int")).withColumn("_i", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    from postmill.runtime import materialize

    laid = materialize(laid, "ids")
    sizes = laid.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))  # one row per task
    base = sizes.select("_p", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return laid.join(F.broadcast(base), "_p").withColumn("id", F.lit(start) + F.col("_b") + F.col("_i") + 1).drop("_m", "_p", "_i", "_b")


class Snapshots:
    """Versions of a table in folders, with a pointer to the current one; a reader never sees half a version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, name: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        p, fs = self._file("CURRENT")
        if not fs.exists(p):
            return 0
        stream = fs.open(p)
        try:
            return int(stream.readLine())
        finally:
            stream.close()

    def read(self) -> DataFrame | None:
        v = self.version()
        return self.spark.read.parquet(f"{self.path}/v{v}") if v else None

    def commit(self, df: DataFrame) -> int:
        """The next version. Of two writers that began from the same version, the later one to finish fails: a version is
        taken by making its marker, which exists once. The pointer is written aside and renamed, so no reader meets half of it."""
        v = self.version() + 1
        marker, fs = self._file(f"v{v}.taken")
        if not fs.createNewFile(marker):
            raise RuntimeError(f"version {v} is being written by another run; remove {marker} if that run is dead")
        try:
            df.write.mode("overwrite").parquet(f"{self.path}/v{v}")
        except Exception:
            fs.delete(marker, False)
            raise
        aside, _ = self._file(f"CURRENT.{v}")
        out = fs.create(aside, True)
        out.writeBytes(f"{v}\n")
        out.close()
        p, _ = self._file("CURRENT")
        jvm = self.spark.sparkContext._jvm
        over = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        option = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = option
        over.rename(aside, p, options)
        return v

    def drop_before(self, version: int) -> None:
        for v in range(1, version):
            _drop(self.spark, f"{self.path}/v{v}")
