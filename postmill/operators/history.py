"""Validity periods of changing attributes, by presence bitmaps.

For each entity and attribute value one bit is set per moment at which the entity was seen with it; runs of
consecutive bits are the periods of validity. Moments are laid out by range of (entity, time), so an entity of any
size is spread over tasks; bitmaps are kept in words of 64 moments, and runs that touch across words or tasks are
joined by a table of task edges, a few rows per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.runtime import materialize

_RUN = "entity {0}, task int, nth bigint, attribute string, from_us bigint, next_us bigint, of_task bigint"


def word_runs(hashes: list[str]) -> list[tuple[int, int, str]]:
    """(first, last, attribute) of the runs among consecutive moments, by bitmaps of 64 bits per attribute."""
    runs: list[tuple[int, int, str]] = []
    for base in range(0, len(hashes), 64):
        masks: dict[str, int] = {}
        for bit, h in enumerate(hashes[base : base + 64]):
            masks[h] = masks.get(h, 0) | (1 << bit)
        found = []
        for h, m in masks.items():
            while m:
                low = (m & -m).bit_length() - 1
                length = (~(m >> low) & ((m >> low) + 1)).bit_length() - 1
                found.append((base + low, base + low + length - 1, h))
                m &= ~(((1 << length) - 1) << low)
        found.sort()
        if runs and runs[-1][2] == found[0][2]:
            found[0] = (runs.pop()[0], found[0][1], found[0][2])
        runs += found
    return runs


def _task_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    held: list = []  # of the entity that may go on in the next batch: key, times, hashes
    out: list[tuple] = []

    def close() -> None:
        key, times, hashes = held
        runs = word_runs(hashes)
        for k, (a, b, h) in enumerate(runs):
            out.append((key, task, k, h, times[a], times[b + 1] if b + 1 < len(times) else None, len(runs)))

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out))
        types = [key_type, pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        names = ["entity", "task", "nth", "attribute", "from_us", "next_us", "of_task"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    key_type = pa.int64()
    for batch in batches:
        key_type = batch.schema.field(0).type
        keys, times, hashes = (batch.column(i).to_pylist() for i in range(3))
        n = len(keys)
        if not n:
            continue
        change = [0, *[i for i in range(1, n) if keys[i] != keys[i - 1]], n]
        for a, b in zip(change, change[1:]):
            if held and held[0] == keys[a]:
                held[1] += times[a:b]
                held[2] += hashes[a:b]
            else:
                if held:
                    close()
                held = [keys[a], times[a:b], hashes[a:b]]
        if len(out) >= 20_000:
            yield flush()
            out = []
    if held:
        close()
    if out:
        yield flush()


def validity(rows: DataFrame, *, entity: str, attribute: str, seen_at: str, ingested_at: str, tiebreak: str, tasks: int | None = None) -> DataFrame:
    """(entity, version_no, attribute, valid_from_us, valid_to_us): one row per version.

    Rows without entity, attribute or ``seen_at`` say nothing. Of several rows of one entity and moment the latest
    ``ingested_at`` holds (NULL is earliest; then the greatest ``tiebreak``). Attributes compare without letter case.
    A version ends where the next starts; 0 if none follows. Exact copies of rows change nothing; no rows, no versions.
    """
    spark = rows.sparkSession
    base = rows.select(
        F.col(entity).alias("entity"),
        F.unix_micros(F.col(seen_at).cast("timestamp")).alias("at"),
        F.lower(F.col(attribute)).alias("attribute"),
        F.struct(F.unix_micros(F.col(ingested_at).cast("timestamp")).alias("i"), F.col(tiebreak).alias("t")).alias("rank"),
    ).where("entity is not null and at is not null and attribute is not null")
    key_type = base.schema["entity"].dataType.simpleString()
    moments = base.groupBy("entity", "at").agg(F.max_by("attribute", "rank").alias("attribute"))
    n = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = moments.repartitionByRange(n, "entity", "at").sortWithinPartitions("entity", "at")
    runs = laid.select("entity", "at", "attribute").mapInArrow(_task_runs, _RUN.format(key_type))
    # written once: the bounds of a range layout may differ if it is made twice
    runs = materialize(runs, "runs")

    # Edges of tasks: one row per task, whatever the data.
    order = F.struct("entity", "nth")
    edges = (
        runs.where("nth = 0 or nth = of_task - 1")
        .groupBy("task")
        .agg(F.min_by(F.struct("entity", "attribute", "from_us", "next_us", "of_task"), order).alias("head"), F.max_by(F.struct("entity", "attribute", "of_task"), order).alias("tail"))
    )
    side = spark.createDataFrame(
        _stitch(sorted(edges.collect(), key=lambda r: r.task)),
        f"s_task int, s_head {key_type}, s_shift bigint, s_same boolean, s_tail {key_type}, s_next bigint",
    )
    j = runs.join(F.broadcast(side), F.col("task") == F.col("s_task"), "left")
    head = F.col("entity") == F.col("s_head")
    tail = (F.col("entity") == F.col("s_tail")) & (F.col("nth") == F.col("of_task") - 1)
    return j.where(~(head & F.col("s_same") & (F.col("nth") == 0))).select(
        F.col("entity").alias(entity),
        (F.col("nth") + 1 + F.when(head, F.col("s_shift")).otherwise(0)).cast("int").alias("version_no"),
        "attribute",
        F.col("from_us").alias("valid_from_us"),
        F.coalesce("next_us", F.when(tail, F.col("s_next")), F.lit(0)).alias("valid_to_us"),
    )


def _stitch(edges: list) -> list[tuple]:
    """Per task: its first entity with the shift of that entity's version numbers and whether the first run only goes
    on the one before; its last entity with the start of what follows there."""
    n = len(edges)
    goes = [k > 0 and edges[k - 1].tail.entity == e.head.entity for k, e in enumerate(edges)]
    same = [goes[k] and edges[k - 1].tail.attribute == e.head.attribute for k, e in enumerate(edges)]
    shift, total = [0] * n, 0
    for k, e in enumerate(edges):
        shift[k] = total - same[k] if goes[k] else 0
        total = shift[k] + e.head.of_task if e.head.entity == e.tail.entity else e.tail.of_task
    follows = [0] * n
    for k in range(n - 2, -1, -1):
        e = edges[k + 1]
        if not goes[k + 1]:
            continue
        if not same[k + 1]:
            follows[k] = e.head.from_us
        elif e.head.next_us is not None:
            follows[k] = e.head.next_us
        elif e.head.entity == e.tail.entity:
            follows[k] = follows[k + 1]
    return [(e.task, e.head.entity, shift[k], bool(same[k]), e.tail.entity, follows[k]) for k, e in enumerate(edges)]
