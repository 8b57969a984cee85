"""Names to configured entries by their aliases, candidates for new sources, readiness of a list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.text import norm_key
from postmill.functions.urls import is_public
from postmill.operators.classify import is_restricted


def alias_keys(name: Column) -> Column:
    """Keys a name may be found by, strongest first, each once: the whole, without brackets, each bracketed alias,
    each part between slashes."""
    n = F.coalesce(name, F.lit(""))
    bare = F.regexp_replace(n, r"\([^)]*\)", " ")
    inside = F.regexp_extract_all(n, F.lit(r"\(([^)]*)\)"), F.lit(1))
    parts = F.when(n.contains("/"), F.split(bare, "/")).otherwise(F.array().cast("array<string>"))
    keys = F.transform(F.concat(F.array(n, bare), inside, parts), norm_key)
    return F.array_distinct(F.filter(keys, lambda k: k != ""))


def alias_join(inputs: DataFrame, entries: DataFrame, *, input_name: str, entry_name: str) -> DataFrame:
    """(input_name, entry_name, outcome): 'exact' by the whole name, else 'alias' by any key, 'ambiguous' if keys lead to
    several entries (then the entry is NULL), 'none'. An equality join on keys; one row per distinct input name."""
    i = inputs.select(F.col(input_name).alias("i")).distinct().withColumn("keys", alias_keys(F.col("i")))
    e = entries.select(F.col(entry_name).alias("e")).distinct().withColumn("keys", alias_keys(F.col("e")))
    ik = i.select("i", F.posexplode("keys").alias("at", "key"))
    ek = e.select("e", F.explode("keys").alias("key"), norm_key(F.col("e")).alias("whole"))
    hit = ik.join(ek, "key").withColumn("exact", (F.col("at") == 0) & (F.col("key") == F.col("whole")))
    g = hit.groupBy("i").agg(
        F.count_distinct(F.when(F.col("exact"), F.col("e"))).alias("n_exact"), F.min(F.when(F.col("exact"), F.col("e"))).alias("exact"),
        F.count_distinct("e").alias("n"), F.min("e").alias("any"),
    )
    outcome = F.when(F.col("n_exact") == 1, "exact").when((F.col("n_exact") > 1) | (F.col("n") > 1), "ambiguous").when(F.col("n") == 1, "alias").otherwise("none")
    j = i.select("i").join(g, "i", "left").withColumn("outcome", F.when(F.col("n").isNull(), "none").otherwise(outcome))
    entry = F.when(F.col("outcome") == "exact", F.col("exact")).when(F.col("outcome") == "alias", F.col("any"))
    return j.select(F.col("i").alias("input_name"), entry.alias("entry_name"), "outcome")


def best_url(*options: tuple[str, Column]) -> Column:
    """struct(url, source): the first option that is a public address, with where it is from."""
    made = [F.when(is_public(c), F.struct(F.trim(c).alias("url"), F.lit(name).alias("source"))) for name, c in options]
    return F.coalesce(*made)


def readiness_status(url: Column, system: Column, in_list: Column, outcome: Column) -> Column:
    """State of one line of a long list, first rule that holds."""
    return (
        F.when(outcome == "ambiguous", "ambiguous_match").when(url.isNull(), "needs_website").when(is_restricted(url), "restricted").when(in_list, "configured")
        .when(system.isin("greenhouse", "lever", "ashby"), "ready_api").when(system.isNotNull(), "known_system").otherwise("needs_review")
    )


def distribution(rows: DataFrame, column: str, seq: str) -> DataFrame:
    """(value, n, first_seq) in order of falling count, ties by first sight."""
    return rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min(seq).alias("first_seq")).orderBy(F.desc("n"), "first_seq")


def problem(status: Column, failures: Column, jobs: Column, url: Column) -> Column:
    """Why a source needs attention, first reason that holds; NULL if it does not."""
    return (
        F.when(~is_public(url), "no usable url").when(status.isin("error", "api_error", "parse_error"), "last run failed").when(status == "paused", "waits for a person")
        .when(failures >= 3, "fails repeatedly").when(F.coalesce(jobs, F.lit(0)) == 0, "finds nothing")
    )


def due(last_check: Column, now: Column, min_days: int, force: bool = False) -> Column:
    from postmill.functions.text import days_since

    d = days_since(now, last_check)
    return F.lit(force) | last_check.isNull() | (d >= min_days)


def apply_outcome(approved: Column, url: Column, exists: Column, same_url: Column) -> Column:
    """What becomes of a reviewed candidate."""
    return (
        F.when(~F.coalesce(approved, F.lit(False)), "not_approved").when(~is_public(url), "invalid_url").when(exists & same_url, "unchanged").when(exists, "updated").otherwise("added")
    )
