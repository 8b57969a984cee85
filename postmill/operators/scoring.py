"""Scores of postings by configured phrases, with the reasons in order.

Everything is a native expression over literal arrays, so a score is one projection: no shuffle, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.text import clamp, first_hit, hits, hits_by_name, search_text

#: Points of each rule. Fixed values of the model; pass others to change it.
WEIGHTS = {
    "role_in_title": 45, "role_in_text": 20, "skill_per_match": 4, "skill_cap": 24, "location_per_match": 4, "location_cap": 12,
    "support_signal_bonus": 8, "support_signal_cap": 8, "adjacent_role_in_title": 24, "adjacent_role_in_text": 12,
    "conditional_adjacent_role_bonus": 18, "negative_penalty": 15, "negative_cap": 45,
}


@dataclass(frozen=True)
class Phrases:
    """The dictionaries. ``gated`` skills count only in the company of other skills, support titles or context."""

    target_roles: list[str] = field(default_factory=list)
    skills: dict[str, list[str]] = field(default_factory=dict)
    locations: list[str] = field(default_factory=list)
    support: list[str] = field(default_factory=list)
    adjacent_roles: list[str] = field(default_factory=list)
    conditional_roles: list[str] = field(default_factory=list)
    adjacent_context: list[str] = field(default_factory=list)
    negatives: list[str] = field(default_factory=list)
    gated: list[str] = field(default_factory=lambda: ["support", "troubleshooting"])
    support_titles: list[str] = field(default_factory=lambda: ["support analyst", "support engineer", "support administrator", "support specialist", "it support"])
    support_context: list[str] = field(default_factory=list)


def score(df: DataFrame, phrases: Phrases, *, title: str = "title", location: str = "location", fields: tuple[str, ...] = ("title", "location", "description"), weights: dict[str, int] | None = None) -> DataFrame:
    """``df`` with ``match_score``, ``match_reasons``, ``risk_flags``, ``relevance_tier`` and ``is_relevant``.

    Phrases match as substrings, without letter case. NULL and empty fields match nothing; such rows score 0 and are
    'not_relevant'.
    """
    return _finish(df, _analysis(df, phrases, weights or WEIGHTS, title, location, fields), ("match_score", "match_reasons", "risk_flags", "relevance_tier", "is_relevant"))


def explain(df: DataFrame, phrases: Phrases, *, title: str = "title", location: str = "location", fields: tuple[str, ...] = ("title", "location", "description"), weights: dict[str, int] | None = None) -> DataFrame:
    """As ``score``, with what matched where and a sentence on why."""
    names = ("match_score", "match_reasons", "risk_flags", "relevance_tier", "is_relevant", "positive_matches", "negative_matches", "title_matches", "text_matches", "location_signals", "support_matches", "summary")
    return _finish(df, _analysis(df, phrases, weights or WEIGHTS, title, location, fields), names)


def _finish(df: DataFrame, made: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return made.select(*[F.col(f"`{c}`") for c in df.columns if c not in names], *[F.col(f"_{n}").alias(n) for n in names])


def _analysis(df: DataFrame, p: Phrases, w: dict[str, int], title: str, location: str, fields: tuple[str, ...]) -> DataFrame:
    """``df`` with the results under names with an underscore. In stages, so that each text is built once and not once
    per phrase: a lambda evaluates what it holds for every element."""
    c = F.col
    none = F.array().cast("array<string>")
    some = lambda x: F.size(x) > 0
    one = lambda x: F.array_compact(F.array(x))
    join = lambda x: F.array_join(x, ", ")
    t, full, loc = c("_t"), c("_x"), c("_l")
    places = F.filter(F.array(*[F.lit(x) for x in p.locations]), lambda x: loc.contains(F.lower(F.trim(x))) | full.contains(F.lower(F.trim(x)))) if p.locations else none
    d = df.withColumns({"_t": F.lower(F.trim(F.coalesce(c(title), F.lit("")))), "_x": search_text(*[c(f) for f in fields]), "_l": F.lower(F.trim(F.coalesce(c(location), F.lit(""))))})
    d = d.withColumns({
        "_rt": first_hit(t, p.target_roles), "_rx": first_hit(full, p.target_roles), "_sk": hits_by_name(full, p.skills),
        "_titled": some(hits(t, p.support_titles)), "_ctx": some(hits(full, p.support_context)), "_pl": places, "_su": hits(full, p.support),
        "_at": first_hit(t, p.adjacent_roles), "_ax": first_hit(full, p.adjacent_roles), "_ac": hits(full, p.adjacent_context),
        "_ct": first_hit(t, p.conditional_roles), "_cx": first_hit(full, p.conditional_roles), "_ng": hits(full, p.negatives),
    })
    d = d.withColumn("_free", F.filter("_sk", lambda s: ~s.isin(*p.gated)) if p.gated else c("_sk"))
    d = d.withColumn("_sk", F.when(c("_titled") | some("_free") | c("_ctx"), c("_sk")).otherwise(c("_free")))
    may = some("_ac") | some("_sk") | some("_su")
    d = d.withColumns({
        "_rx": F.when(c("_rt").isNull(), c("_rx")), "_ax": F.when(c("_at").isNull(), c("_ax")), "_ct": F.when(may, c("_ct")),
        "_cx": F.when(may & c("_ct").isNull(), c("_cx")), "_sup": some("_su") & (c("_titled") | some("_sk") | c("_ctx")),
    })
    points = lambda x, n: F.when(c(x).isNotNull(), w[n]).otherwise(0)
    capped = lambda x, n, cap: F.least(F.size(x) * w[n], F.lit(w[cap]))
    total = (
        points("_rt", "role_in_title") + points("_rx", "role_in_text")
        + capped("_sk", "skill_per_match", "skill_cap") + capped("_pl", "location_per_match", "location_cap")
        + F.when(c("_sup"), capped("_su", "support_signal_bonus", "support_signal_cap")).otherwise(0)
        + points("_at", "adjacent_role_in_title") + points("_ax", "adjacent_role_in_text")
        + points("_ct", "conditional_adjacent_role_bonus") + points("_cx", "adjacent_role_in_text")
        - capped("_ng", "negative_penalty", "negative_cap")
    )
    near = "adjacent customer-facing technical fit: "
    reasons = F.array_compact(
        F.array(
            F.concat(F.lit("title matches target role: "), c("_rt")),
            F.concat(F.lit("description mentions target role: "), c("_rx")),
            F.when(some("_sk"), F.concat(F.lit("matched skills: "), join(c("_sk")))),
            F.when(some("_pl"), F.concat(F.lit("location signals: "), join(c("_pl")))),
            F.when(c("_sup"), F.concat(F.lit("support/ops signals: "), join(c("_su")))),
            F.concat(F.lit(near), c("_at")),
            F.concat(F.lit(near), c("_ax")),
            F.concat(F.lit(near), c("_ct"), F.lit(" (technical context)")),
            F.concat(F.lit(near), c("_cx"), F.lit(" (technical context)")),
        )
    )
    core = c("_rt").isNotNull() | c("_rx").isNotNull()
    adjacent = F.coalesce("_at", "_ax", "_ct", "_cx").isNotNull()
    second = some("_sk") | c("_sup")
    d = d.withColumns({"_match_score": clamp(total).cast("bigint"), "_match_reasons": reasons, "_risk_flags": F.transform("_ng", lambda x: F.concat(F.lit("negative signal: "), x))})
    tier = (
        F.when(c("_match_score") <= 0, "not_relevant").when(core, "core_target_fit").when(adjacent, "adjacent_customer_facing_technical_fit").when(second, "core_target_fit").otherwise("not_relevant")
    )
    both = F.when(F.coalesce("_ct", "_cx").isNotNull(), c("_ac")).otherwise(none)
    sup = F.when(c("_sup"), c("_su")).otherwise(none)
    d = d.withColumns({
        "_relevance_tier": tier, "_is_relevant": (c("_match_score") > 0) & (core | adjacent | second),
        "_positive_matches": F.array_distinct(F.concat(one(c("_rt")), one(c("_rx")), c("_sk"), sup, one(c("_at")), one(c("_ax")), one(c("_ct")), one(c("_cx")), both)),
        "_negative_matches": c("_ng"), "_title_matches": F.concat(one(c("_rt")), one(c("_at")), one(c("_ct"))),
        "_text_matches": F.array_distinct(F.concat(one(c("_rx")), c("_sk"), sup, one(c("_ax")), one(c("_cx")), both)),
        "_location_signals": c("_pl"), "_support_matches": sup,
    })
    summary = (
        F.when(c("_relevance_tier") == "core_target_fit", "relevant: a positive score and a core signal")
        .when(c("_relevance_tier") == "adjacent_customer_facing_technical_fit", "relevant: an adjacent role")
        .when(c("_match_score") <= 0, "not relevant: nothing positive is left after penalties")
        .when(some("_match_reasons"), "not relevant: weak or location signals only")
        .otherwise("not relevant: nothing matched")
    )
    return d.withColumn("_summary", summary)


def top_per_group(df: DataFrame, group: str, n: int, *order: Column) -> DataFrame:
    """The first ``n`` (1 at least) rows of each group in ``order``; a filter on row numbers, which Spark turns into a
    limit per group before the shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= max(1, n)).drop("_rank")

