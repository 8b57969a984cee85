"""Session, table access and the few places where a plan is cut.

Everything that has to outlive an executor goes to the folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "postmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings all operators assume (UTC, adaptive execution)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data set; a file or a folder of Parquet parts."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only where none is configured a local one is made (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    got = sc.getCheckpointDir()
    if got is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="postmill-"))
        got = sc.getCheckpointDir()
    return got.rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:
        pass


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/postmill/{label}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Cuts the lineage durably: a lost executor costs a re-read, not a recomputation. The table is removed when the
    driver ends.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint only after counting that ``df`` has at most ``max_rows`` rows; otherwise the plain frame."""
    small = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if small else df
