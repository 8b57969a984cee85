"""Copies that differ in their dress only: case, punctuation, white space, order of words.

Byte-identical rows are collapsed first, with their numbers; only the distinct survivors are brought into canonical
form and grouped again by the full canonical text, summing the numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(c: Column) -> Column:
    """The words of a text, lower case, in order of their characters, one blank between. NULL counts as empty."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))
    return F.array_join(F.array_sort(words), " ")


def groups(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row per distinct raw form: ``fields``, ``kept`` (smallest key of its set) and ``copies`` (rows of the set).

    Both aggregations combine before they shuffle, so a form that a third of the rows has is one row per task. The
    second one works on forms, and the sets of forms are joined back to the forms by canonical text.
    """
    raw = rows.groupBy(*fields).agg(F.min(key).alias("_first"), F.count(F.lit(1)).alias("_n"))
    names = [f"_c{i}" for i in range(len(fields))]
    forms = raw.select("*", *[canonical(F.col(f)).alias(n) for f, n in zip(fields, names)])
    sets = forms.groupBy(*names).agg(F.min("_first").alias("kept"), F.sum("_n").alias("copies"))
    return forms.join(sets, names).select(*fields, "kept", "copies", "_n")


def collapse(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One record per set: (kept, copies, forms), where ``copies`` counts all rows and ``forms`` the distinct raw ones.

    NULL fields count as empty; rows without any word are one set. Empty input gives no rows; ``key`` may repeat.
    """
    return groups(rows, key, fields).groupBy("kept").agg(F.first("copies").alias("copies"), F.count(F.lit(1)).alias("forms"))


def copies(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(kept, key): each row other than the kept one of its set. ``key`` must be unique.

    Rows meet the sets by their raw form; a form with many rows lies on the side that adaptive execution may split.
    Sets of one row are dropped before that join.
    """
    many = groups(rows, key, fields).where("copies > 1").select(*[F.col(f).alias(f"_g_{f}") for f in fields], "kept")
    same = None
    for f in fields:
        c = rows[f].eqNullSafe(F.col(f"_g_{f}"))
        same = c if same is None else same & c
    return rows.select(key, *fields).join(many, same).where(F.col(key) != F.col("kept")).select("kept", key)
