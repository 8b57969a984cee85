"""One run over landed boards, from their answers to the next snapshot and the figures of the run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.operators.identity import content_hash, keep_first, with_identity
from postmill.operators.listing import probable_posting
from postmill.operators.merge import Snapshots, merge
from postmill.operators.scoring import Phrases, score
from postmill.runtime import materialize
from postmill.sources import feeds

FIELDS = [
    "company_name", "source_name", "ats_type", "board_slug", "external_job_id", "title", "location", "job_url", "apply_url", "description", "date_posted",
    "content_hash", "match_score", "match_reasons", "risk_flags", "relevance_tier",
]


@dataclass
class Run:
    snapshot: DataFrame
    by_source: DataFrame
    outcomes: DataFrame
    version: int


def daily_run(spark: SparkSession, landed: DataFrame, phrases: Phrases, snapshots: Snapshots, at: str) -> Run:
    """Read, normalize, keep the first of each identity, score, keep what is relevant and looks like a posting, merge.

    ``at`` is the time of the run as text, so a run can be repeated. ``landed`` is read once. A second run over the same
    answers inserts and updates nothing. Boards that cannot be read keep their rows.
    """
    raw = feeds.normalize(feeds.read_boards(landed))
    raw = materialize(with_identity(raw.where("company_name <> '' and title <> ''"), "i"), "raw")
    order = [F.asc("source_name"), F.asc_nulls_last("external_job_id"), F.asc_nulls_last("job_url"), F.asc("title")]
    first = keep_first(raw, [F.col("i.kind"), F.col("i.key")], *order)
    c = F.col
    fine = probable_posting(c("title"), c("job_url"), c("description"), c("location"), c("external_job_id"), c("ats_type"), c("board_slug"))
    scored = materialize(score(first.withColumn("fine", fine), phrases).withColumn("content_hash", content_hash()), "scored")
    now = F.lit(at).cast("timestamp")
    new = scored.where("fine and is_relevant").select(
        F.concat_ws(":", "i.kind", "i.key").alias("identity"), *FIELDS, now.alias("first_seen_at"), now.alias("last_seen_at"), now.alias("last_updated_at")
    )
    old = snapshots.read()
    empty = new.limit(0) if old is None else old.drop("action")
    version = snapshots.commit(merge(empty, new, key="identity", fields=FIELDS))
    snapshot = snapshots.read()
    counts = raw.groupBy("source_name").agg(F.count(F.lit(1)).alias("discovered"))
    kept = scored.groupBy("source_name").agg(F.count(F.lit(1)).alias("scored"), F.count_if("is_relevant").alias("relevant"))
    acted = snapshot.where("action <> 'kept'").groupBy("source_name").pivot("action", ["inserted", "updated", "unchanged"]).count()
    by_source = counts.join(kept, "source_name", "left").join(acted, "source_name", "left").fillna(0)
    by_source = by_source.withColumn("duplicates_skipped", F.greatest(F.lit(0), F.col("discovered") - F.col("scored")))
    return Run(snapshot, by_source, feeds.outcomes(landed, raw), version)
