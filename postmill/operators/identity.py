"""Identity of postings, keeping the first of each, and hashes of their content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions.text import norm
from postmill.functions.urls import identity_url

#: Kinds of identity, strongest first. Fixed values.
KINDS = ("company_ats_board_external", "company_ats_external", "job_url", "company_title_location_source")


_PARTS = {"_co": "company_name", "_ats": "ats_type", "_board": "board_slug", "_ext": "external_job_id", "_ti": "title", "_lo": "location", "_so": "source_name"}


def _staged(df: DataFrame) -> DataFrame:
    """The normal forms as columns of their own: each is worked out once, however often the rules name it."""
    return df.withColumns({**{k: norm(F.col(v)) for k, v in _PARTS.items()}, "_url": identity_url(F.col("job_url"))})


def _pair(kind: str, *key: str) -> Column:
    return F.struct(F.lit(kind).alias("kind"), (F.concat_ws("|", *key) if len(key) > 1 else F.col(key[0])).alias("key"))


def _best() -> Column:
    strong = (F.col("_co") != "") & (F.col("_ats") != "") & (F.col("_ext") != "")
    return (
        F.when(strong & (F.col("_board") != ""), _pair(KINDS[0], "_co", "_ats", "_board", "_ext"))
        .when(strong, _pair(KINDS[1], "_co", "_ats", "_ext"))
        .when(F.col("_url").isNotNull(), _pair(KINDS[2], "_url"))
        .otherwise(_pair(KINDS[3], "_co", "_ti", "_lo", "_so"))
    )


def with_identity(df: DataFrame, out: str = "identity") -> DataFrame:
    """``df`` with struct(kind, key): the strongest identity that a posting has.

    The key joins its parts by a bar; NULL parts count as empty.
    """
    return _staged(df).withColumn(out, _best()).drop(*_PARTS, "_url")


def with_candidates(df: DataFrame, out: str = "candidates") -> DataFrame:
    """``df`` with an array of struct(priority, kind, key): the strongest identity, then the address, then company with
    title, place and source if the strongest is weak."""
    d = _staged(df).withColumn("_best", _best())
    kind = F.col("_best.kind")
    made = F.array_compact(
        F.array(
            F.col("_best"),
            F.when((kind != KINDS[2]) & F.col("_url").isNotNull(), _pair(KINDS[2], "_url")),
            F.when(kind == KINDS[2], _pair(KINDS[3], "_co", "_ti", "_lo", "_so")),
        )
    )
    d = d.withColumn("_made", made)
    return d.withColumn(out, F.transform("_made", lambda x, i: F.struct(i.alias("priority"), x["kind"].alias("kind"), x["key"].alias("key")))).drop(*_PARTS, "_url", "_best", "_made")


def keep_first(df: DataFrame, keys: list[Column], *order: Column) -> DataFrame:
    """One row per key, the first in ``order``; NULL keys are equal. Unlike dropDuplicates, always the same row."""
    named = {f"_k{i}": k for i, k in enumerate(keys)}
    w = Window.partitionBy(*named).orderBy(*order)
    return df.withColumns(named).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", *named)


def first_ids(df: DataFrame, keys: list[Column], seq: str) -> DataFrame:
    """The smallest ``seq`` of each key with the number of rows, by aggregation: combines before the shuffle, so one
    key may have any share of the rows."""
    named = [k.alias(f"k{i}") for i, k in enumerate(keys)]
    return df.groupBy(*named).agg(F.min(seq).alias(seq), F.count(F.lit(1)).alias("n_rows"))


def page_or_title() -> list[Column]:
    """Key of found records: the address as it stands, else title and place."""
    u = F.trim(F.coalesce(F.col("job_url"), F.lit("")))
    bare = u == ""
    return [u, F.when(bare, F.trim(F.coalesce(F.col("title"), F.lit("")))), F.when(bare, F.trim(F.coalesce(F.col("location"), F.lit(""))))]


def content_hash() -> Column:
    """SHA-256 over the normal form of what a reader sees: change of dress is no change of content.

    The text hashed is JSON with sorted keys and no blanks; keys of NULL parts are kept.
    """
    parts = {
        "ats_type": norm(F.col("ats_type")), "board_slug": norm(F.col("board_slug")), "description": norm(F.col("description")), "external_job_id": norm(F.col("external_job_id")),
        "job_url": identity_url(F.col("job_url")), "location": norm(F.col("location")), "title": norm(F.col("title")),
    }
    text = F.to_json(F.struct(*[v.alias(k) for k, v in parts.items()]), {"ignoreNullFields": "false"})
    return F.sha2(text, 256)


def external_id(candidates: list[Column], url: Column, rest: list[Column]) -> Column:
    """The first id that isn't blank, else the address, else a hash of the rest."""
    pick = [F.nullif(F.trim(c), F.lit("")) for c in [*candidates, url]]
    return F.coalesce(*pick, F.sha2(F.concat_ws("|", *[F.coalesce(r, F.lit("")) for r in rest]), 256))
