"""Mixes of sources to target shares, as a curriculum.

Each source has a weight that changes over the training: w(t) = share * (1 + slope * (2t - 1)). Integrated over t it is
the source's cumulative demand; a document copy whose place in its source's stream of ids is c stands where that
demand reaches c. Places come from prefix sums over hash buckets of a source, so no source is ever in one task; a
range sort by position gives the order of training.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.tokens import DEFAULT_VOCABULARY, token_counts
from postmill.runtime import broadcast_if_small, materialize

#: Hash buckets of a source; each is one group of the prefix sum.
BUCKETS = 1024
#: The total of a mix that is as large as its sources together, each taken once.
AVAILABLE = "available"


def sized(docs: DataFrame, *, key: str, source: str, text: str, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens, before): documents with ids, and the ids of their source before them in hash order.

    Documents without source, and empty ones, have no part in a mix.
    """
    d = token_counts(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")).where("source is not null and text is not null"), "text", path=path)
    d = d.where("n_tokens > 0").withColumn("h", F.xxhash64("doc_id")).withColumn("bucket", F.shiftrightunsigned("h", 54).cast("int"))
    d = materialize(d, "sizes")
    sums = d.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("s"))
    by = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "bucket", F.coalesce(F.sum("s").over(by), F.lit(0)).alias("base"))  # BUCKETS rows a source at most
    within = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    d = d.join(sums, ["source", "bucket"])  # laid out by the keys of the window that follows
    return d.select("doc_id", "source", "n_tokens", (F.col("base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).alias("before"))


def plan(sizes: DataFrame, targets: DataFrame, total_tokens: int | str | None = None) -> DataFrame:
    """One row per mix and source: what it has, what it is to give, its slope.

    Without ``total_tokens`` a mix is as large as it can be with every source that is there at its target share and
    within its cap, so shares are met; with it, sources that reach their cap leave the rest to the others, in
    proportion of their shares, until nothing moves. ``AVAILABLE`` gives each mix the ids of the sources it lists as its
    total: small sources repeat to their cap and fall short, but never cut the others. Sources that are not there give
    nothing.
    """
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("available"), F.count(F.lit(1)).alias("n_docs"))
    t = targets.where("mix_name is not null and source is not null").groupBy("mix_name", "source").agg(
        F.max(F.coalesce("target_share", F.lit(0.0))).alias("share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("cap")
    )
    p = t.join(have, "source", "left").fillna(0, ["available", "n_docs"]).withColumn("most", F.col("available") * F.col("cap"))
    mix = Window.partitionBy("mix_name")
    live = (F.col("most") > 0) & (F.col("share") > 0)
    if total_tokens is None:
        fits = F.min(F.when(live, F.col("most") / F.col("share"))).over(mix)
        p = p.withColumn("demand", F.when(live, F.least(F.col("share") * fits, F.col("most").cast("double"))).otherwise(0.0))
    else:
        # a source is full from the size of mix on at which its share is all it may give; in that order, what a mix
        # gives at that size is the most of those before it and the shares of the others
        total = F.sum(F.when(live, F.col("available"))).over(mix).cast("double") if total_tokens == AVAILABLE else F.lit(float(total_tokens))
        order = mix.orderBy("full_at", "source")
        p = p.withColumn("full_at", F.when(live, F.col("most") / F.col("share"))).withColumn("total", total)
        before = F.coalesce(F.sum(F.when(live, F.col("most"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        others = F.sum(F.when(live, F.col("share"))).over(order.rowsBetween(0, Window.unboundedFollowing))
        p = p.withColumn("full", live & (before + F.col("full_at") * others <= F.col("total") * (1 + 1e-12)))
        left = F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(mix), F.lit(0))
        open_share = F.sum(F.when(live & ~F.col("full"), F.col("share"))).over(mix)
        given = F.least(left * F.try_divide(F.col("share"), open_share), F.col("most").cast("double"))
        p = p.withColumn("demand", F.when(F.col("full"), F.col("most").cast("double")).when(live, given).otherwise(0.0)).drop("full_at", "total", "full")
    # sources that may repeat come up towards the end, the others make room: weights add up at any time
    again = F.sum(F.when(F.col("cap") > 1, F.col("demand")).otherwise(0.0)).over(mix)
    once = F.sum(F.when(F.col("cap") <= 1, F.col("demand")).otherwise(0.0)).over(mix)
    rise = F.when((again > 0) & (once > 0), F.least(F.lit(0.5), F.try_divide(once, again))).otherwise(0.0)
    slope = F.when(F.col("cap") > 1, rise).otherwise(-F.coalesce(F.try_divide(rise * again, once), F.lit(0.0)))
    return p.withColumn("slope", slope)


def mix(sizes: DataFrame, planned: DataFrame) -> DataFrame:
    """(mix_name, doc_id, source, copy_no, n_tokens, position): the chosen copies, in order of training.

    A source gives whole passes over its documents, and in the last pass those whose middle lies within what is left
    of its demand, so it ends within half a document of it. ``position`` runs from 0 to 1 in its mix.
    """
    p = broadcast_if_small(planned.where("demand > 0").select("mix_name", "source", "demand", "available", "cap", "slope"), 100_000)
    middle = F.col("before") + F.col("n_tokens") / 2
    passes = F.floor(F.col("demand") / F.col("available") + 1e-9)
    copies = F.least(passes + F.when(middle <= F.col("demand") - passes * F.col("available"), 1).otherwise(0), F.col("cap")).cast("int")
    d = sizes.join(p, "source").withColumn("copies", copies).where("copies > 0")
    d = d.select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"))
    y = F.least(((F.col("copy_no") - 1) * F.col("available") + middle) / F.col("demand"), F.lit(1.0))
    a = F.col("slope")
    root = (F.sqrt((1 - a) * (1 - a) + 4 * a * y) - (1 - a)) / F.when(a == 0, F.lit(1.0)).otherwise(2 * a)
    position = F.least(F.when(F.abs(a) < 1e-9, y).otherwise(root), F.lit(1.0))
    out = d.select("mix_name", "doc_id", "source", "copy_no", "n_tokens", position.alias("position"))
    return out.orderBy("mix_name", "position", "doc_id", "copy_no")


def shares(chosen: DataFrame, planned: DataFrame) -> DataFrame:
    """Target and reached shares: one row per mix and source, with what it gave; 'absent', 'capped' or 'met'."""
    got = chosen.groupBy("mix_name", "source").agg(
        F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("copies"), F.count(F.when(F.col("copy_no") == 1, 1)).alias("documents"), F.max("copy_no").alias("most_repeats")
    )
    whole = Window.partitionBy("mix_name")
    j = planned.join(got, ["mix_name", "source"], "left").fillna(0, ["tokens", "copies", "documents", "most_repeats"])
    return j.select(
        "mix_name", "source", F.col("share").alias("target_share"),
        F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(whole)), F.lit(0.0)).alias("actual_share"),
        F.col("available").alias("available_tokens"), "tokens", "documents", "copies", "most_repeats", F.col("cap").alias("max_repeats"),
        F.when(F.col("available") == 0, "absent").when(F.col("demand") >= F.col("most") * (1 - 1e-9), "capped").otherwise("met").alias("state"),
    )
