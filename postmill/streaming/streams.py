"""The same semantics over streams: counts in windows, repeats within a watermark, failure streaks, merging batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from postmill.operators.identity import with_identity
from postmill.operators.merge import Snapshots, merge


def window_counts(events: DataFrame, *, at: str, kind: str, length: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Events per window and kind; a window is final once the watermark has passed it."""
    return events.withWatermark(at, late).groupBy(F.window(at, length), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), kind, "n")


def sessions(events: DataFrame, *, at: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def first_sightings(postings: DataFrame, *, at: str, late: str = "14 days") -> DataFrame:
    """Postings of which no row with the same identity came within the watermark before."""
    keyed = with_identity(postings, "_id").withColumns({"identity_kind": F.col("_id.kind"), "identity_key": F.col("_id.key")}).drop("_id")
    return keyed.withWatermark(at, late).dropDuplicatesWithinWatermark(["identity_kind", "identity_key"])


def failure_streaks(events: DataFrame, *, key: str, at: str, order: str, fails: Column, succeeds: Column) -> DataFrame:
    """(key, order, consecutive_failures, last_success_us) after each event, with state per key.

    Events of one key are taken in order of time and ``order`` within a micro-batch; batches must not overlap in time.
    State is three numbers a key.
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, ok = state.get if state.exists else (0, -1)
        rows = pd.concat(list(batches)).sort_values(["_at", "_order"])
        out = []
        for t, o, bad, good in zip(rows["_at"], rows["_order"], rows["_bad"], rows["_good"]):
            n = n + 1 if bad else 0
            ok = t if good else ok
            out.append((k[0], o, n, ok if ok >= 0 else None))
        state.update((int(n), int(ok)))
        yield pd.DataFrame(out, columns=[key, order, "consecutive_failures", "last_success_us"])

    kinds = dict(events.dtypes)
    src = events.select(key, F.unix_micros(F.col(at).cast("timestamp")).alias("_at"), F.col(order).alias("_order"), F.coalesce(fails, F.lit(False)).alias("_bad"), F.coalesce(succeeds, F.lit(False)).alias("_good"))
    return src.groupBy(key).applyInPandasWithState(
        run, f"{key} {kinds[key]}, {order} {kinds[order]}, consecutive_failures int, last_success_us bigint", "n int, ok bigint", "append", GroupStateTimeout.NoTimeout
    )


def merge_into(snapshots: Snapshots, *, key: str, fields: list[str], prepare: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: each micro-batch is one run, merged into the current snapshot.

    A batch that is delivered again finds its rows unchanged, so the result is the same.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        new = prepare(batch) if prepare else batch
        old = snapshots.read()
        base = new.select(key, *fields, "first_seen_at", "last_seen_at", "last_updated_at")
        if old is None:
            snapshots.commit(base.withColumn("action", F.lit("inserted")))
        else:
            snapshots.commit(merge(old.drop("action"), base, key=key, fields=fields))

    return run
