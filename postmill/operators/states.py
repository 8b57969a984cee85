"""Updates of kept state as the next snapshot: upserts, transitions, episodes, migration, and lookups by precedence.

A table of state is a DataFrame with one row per key. Every update gives the next table; none changes rows in place, and
each is one join or one aggregation on the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.functions.text import blank_to_null


def upsert(old: DataFrame, new: DataFrame, *, key: str, overwrite: list[str], preserve: list[str] = (), add: list[str] = ()) -> DataFrame:
    """The next state with ``action`` ('inserted', 'updated', 'unchanged', 'kept').

    ``overwrite`` columns take the new value, ``preserve`` columns the new one only where it says something (not NULL, no
    blank text), ``add`` columns are counters that sum up. Keys are unique on both sides and not NULL; rows with a NULL key
    never meet.
    """
    o, n = old.alias("o"), new.alias("n")
    j = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    is_new, is_kept = F.col(f"o.{key}").isNull(), F.col(f"n.{key}").isNull()

    def said(c: str) -> Column:
        x = F.col(f"n.{c}")
        return blank_to_null(x) if isinstance(new.schema[c].dataType, T.StringType) else x

    cols = {c: F.when(is_kept, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")) for c in overwrite}
    cols |= {c: F.coalesce(said(c), F.col(f"o.{c}")) for c in preserve}
    cols |= {c: F.coalesce(F.col(f"o.{c}"), F.lit(0)) + F.coalesce(F.col(f"n.{c}"), F.lit(0)) for c in add}
    changed = F.lit(False)
    for c, x in cols.items():
        changed = changed | ~x.eqNullSafe(F.col(f"o.{c}"))
    action = F.when(is_new, "inserted").when(is_kept, "kept").when(changed, "updated").otherwise("unchanged")
    return j.select(F.coalesce(F.col(f"n.{key}"), F.col(f"o.{key}")).alias(key), *[x.alias(c) for c, x in cols.items()], action.alias("action"))


def fold(events: DataFrame, *, key: str, order: list[str], last_said: list[str], sums: list[str], at: str) -> DataFrame:
    """One row per key: the last value that says something of each of ``last_said``, sums, the first and last ``at``, rows."""
    rank = F.struct(*order)
    value = lambda c: blank_to_null(F.col(c)) if isinstance(events.schema[c].dataType, T.StringType) else F.col(c)
    return events.groupBy(key).agg(
        *[F.max_by(value(c), F.when(value(c).isNotNull(), rank)).alias(c) for c in last_said],
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in sums],
        F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count(F.lit(1)).alias("n_rows"),
    )


def episodes(events: DataFrame, *, keys: list[str], order: list[str], opened: str, closed: str, count: str) -> DataFrame:
    """(keys, episode, first_at, last_at, closed_at, occurrences): events of a key that come before it is closed are one episode.

    An event at or after the latest closing time before it opens the next one. NULL counts, and those below 1, are 1.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.max(closed).over(w.rowsBetween(Window.unboundedPreceding, -1))
    e = events.withColumn("_before", before).withColumn("_new", (F.lag(F.lit(1)).over(w).isNull() | (F.col(opened) >= F.col("_before"))).cast("int"))
    # a closing that an earlier episode has been left by does not open another
    e = e.withColumn("_seen", F.max(F.when(F.col("_new") == 1, F.col("_before"))).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    e = e.withColumn("_new", F.when(F.col("_seen").isNotNull() & (F.col("_before") <= F.col("_seen")), 0).otherwise(F.coalesce("_new", F.lit(0))))
    e = e.withColumn("episode", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return e.groupBy(*keys, "episode").agg(
        F.min(opened).alias("first_at"), F.max(opened).alias("last_at"), F.max(closed).alias("closed_at"), F.sum(F.greatest(F.lit(1), F.coalesce(count, F.lit(1)))).cast("bigint").alias("occurrences")
    )


def transition(state: DataFrame, *, when: Column, changes: dict[str, Column]) -> DataFrame:
    """``state`` with ``changes`` where ``when`` holds, and ``changed``; a NULL condition changes nothing."""
    hit = F.coalesce(when, F.lit(False))
    return state.withColumns({"changed": hit}).withColumns({c: F.when(F.col("changed"), x).otherwise(F.col(c)) for c, x in changes.items()})


def migrate(rows: DataFrame, schema: str, backfill: dict[str, Column]) -> DataFrame:
    """``rows`` in ``schema``: missing columns added as NULL, then filled from ``backfill``; further columns stay."""
    want = T._parse_datatype_string(schema)
    out = rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in want.fields if f.name not in rows.columns})
    return out.withColumns({c: F.coalesce(F.col(c), x).cast(want[c].dataType) for c, x in backfill.items()})


def missing_columns(rows: DataFrame, expected: list[str]) -> list[str]:
    return [c for c in expected if c not in rows.columns]


def orphans(rows: DataFrame, parents: DataFrame, *, key: str, parent_key: str) -> DataFrame:
    """Rows whose key is there but leads to no parent."""
    p = parents.select(F.col(parent_key).alias("_parent")).distinct()
    return rows.where(F.col(key).isNotNull()).join(p, F.col(key) == F.col("_parent"), "left_anti")


def by_precedence(keys: DataFrame, key: str, *found: tuple[str, DataFrame, str, str]) -> DataFrame:
    """``keys`` with ``value`` and ``origin``: of the tables (origin, rows, key, value) the first that says something.

    Several rows of one key in one table: the smallest value. One aggregation over the union, one join.
    """
    all_ = None
    for rank, (origin, rows, k, v) in enumerate(found):
        one = rows.select(F.col(k).alias("_k"), F.lit(rank).alias("_rank"), F.lit(origin).alias("_origin"), blank_to_null(F.col(v)).alias("_v")).where("_v is not null and _k is not null")
        all_ = one if all_ is None else all_.union(one)
    best = all_.groupBy("_k").agg(F.min(F.struct("_rank", "_v", "_origin")).alias("_b"))
    return keys.join(best, F.col(key) == F.col("_k"), "left").select(*keys.columns, F.col("_b._v").alias("value"), F.coalesce("_b._origin", F.lit("none")).alias("origin"))


def counts_of(names: DataFrame, key: str, **tables: tuple[DataFrame, Column]) -> DataFrame:
    """``names`` with the number of rows each table has for it, 0 where it has none."""
    out = names
    for name, (rows, k) in tables.items():
        c = rows.groupBy(k.alias(f"_{name}")).agg(F.count(F.lit(1)).alias(name))
        out = out.join(c, F.col(key) == F.col(f"_{name}"), "left").drop(f"_{name}").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def action_text(reason: Column, texts: dict[str, str], default: str) -> Column:
    """The text of a reason, or the default."""
    t = F.create_map(*[F.lit(x) for kv in texts.items() for x in kv]) if texts else F.lit(None)
    return F.coalesce(t[reason], F.lit(default)) if texts else F.lit(default)


def listed(text: str | None) -> list[str]:
    """A comma list as its trimmed members, without blanks."""
    return [x.strip() for x in (text or "").split(",") if x.strip()]


#: 'City, Province, Country' as postings write it.
_AREA = r"(\p{Lu}[\p{L}.'’-]+(?: \p{Lu}[\p{L}.'’-]+){0,3}, ?(?:[A-Z]{2,3}|\p{Lu}[\p{L} ]{2,30}))"


def place_in(text: Column, hints: list[str], most: int = 160) -> Column:
    """The place a text names: the first 'City, Region', else the text itself if it is short and has a hint."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    m = F.nullif(F.regexp_extract(t, _AREA, 1), F.lit(""))
    has = F.lit(False)
    for h in hints:
        has = has | F.contains(F.lower(t), F.lit(h.lower()))
    return F.coalesce(m, F.when(has & (F.length(t) <= most), t))
