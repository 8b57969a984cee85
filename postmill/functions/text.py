"""Text functions as native expressions. Three normal forms exist; they are not interchangeable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"(?U)[\s\p{Z}]+"


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def clean(c: Column) -> Column:
    """Runs of white space to one blank, outer ones off; letter case kept. NULL gives ''."""
    return F.trim(F.regexp_replace(_or_empty(c), _SPACE, " "))


def norm(c: Column) -> Column:
    """First normal form: lower case, white space squeezed. NULL gives ''."""
    return clean(F.lower(_or_empty(c)))


def norm_alnum(c: Column) -> Column:
    """Second normal form: as the first, then everything but a-z and 0-9 to one blank."""
    return F.trim(F.regexp_replace(norm(c), "[^a-z0-9]+", " "))


def norm_key(c: Column) -> Column:
    """Third normal form, for names: '&' is read as 'and', then as the second."""
    return F.trim(F.regexp_replace(F.replace(F.lower(_or_empty(c)), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))


def blank_to_null(c: Column) -> Column:
    """Outer white space off; blank becomes NULL."""
    return F.nullif(F.regexp_replace(c, r"(?U)^[\s\p{Z}]+|[\s\p{Z}]+$", ""), F.lit(""))


def strip_tags(c: Column) -> Column:
    """Markup to blanks, squeezed; NULL stays NULL."""
    return F.when(c.isNotNull(), clean(F.regexp_replace(c, "<[^>]+>", " ")))


def search_text(*fields: Column) -> Column:
    """All fields that are there, without markup, lower case, in order."""
    return F.lower(F.concat_ws(" ", *[strip_tags(f) for f in fields]))


def split_values(c: Column, pattern: str) -> Column:
    """Parts between matches of ``pattern``, trimmed, without blank ones."""
    return F.filter(F.transform(F.split(_or_empty(c), pattern), clean), lambda x: x != "")


def parse_bool(c: Column) -> Column:
    """TRUE, FALSE or NULL for neither."""
    n = norm(c)
    return F.when(n.isin("true", "yes", "1", "y"), True).when(n.isin("false", "no", "0", "n"), False)


def parse_boolish(c: Column) -> Column:
    return norm(c).isin("true", "yes", "1", "y")


def days_since(now: Column, then: Column) -> Column:
    """Whole days that have gone by, never below 0; NULL-safe. Not the calendar's days."""
    return F.greatest(F.lit(0), F.floor((F.unix_micros(now) - F.unix_micros(then)) / F.lit(86_400_000_000))).cast("bigint")


def epoch_text(c: Column) -> Column:
    """A number of seconds, or milliseconds beyond 1e12, as ISO text; other text unchanged."""
    n = c.try_cast("double")
    t = F.timestamp_micros((F.when(n > 1e12, n * 1000).otherwise(n * 1_000_000)).cast("bigint"))
    return F.when(n.isNotNull(), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(c)


def stamp(c: Column) -> Column:
    """A time as 19 characters, '-' for none."""
    return F.coalesce(F.nullif(F.substring(F.replace(c, F.lit("T"), F.lit(" ")), 1, 19), F.lit("")), F.lit("-"))


def list_text(c: Column, sep: str = ", ") -> Column:
    return F.coalesce(F.nullif(F.array_join(c, sep), F.lit("")), F.lit("-"))


def slug(c: Column) -> Column:
    """Letters and digits kept, the rest to single hyphens; 'company' if nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(_or_empty(c), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", ""), F.lit("")), F.lit("company"))


def cell(c: Column) -> Column:
    """For a table cell: bars escaped, line breaks to blanks, '-' for none."""
    t = F.replace(F.replace(F.trim(_or_empty(c)), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    return F.coalesce(F.nullif(t, F.lit("")), F.lit("-"))


def yes_no(c: Column) -> Column:
    return F.when(c, "Yes").otherwise("No")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def clamp(c: Column, low: int = 0, high: int = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def merge_notes(old: Column, new: Column) -> Column:
    """``new`` after a blank line, unless ``old`` holds it; NULL if both are blank."""
    o, n = blank_to_null(old), blank_to_null(new)
    return F.when(n.isNull(), o).when(o.isNull(), n).when(o.contains(n), o).otherwise(F.concat(o, F.lit("\n\n"), n))


def title_text(c: Column) -> Column:
    """A title without the wording of forms around it: 'Job Title X Location ...' and 'Apply Now X'."""
    t = clean(c)
    low = F.lower(t)
    cut = F.split(F.substring(t, 11, 1_000_000), r"(?i)\s+(?:location|category|posted)\s+", 2)[0]
    return clean(F.when(low.startswith("job title "), cut).when(low.startswith("apply now "), F.substring(t, 11, 1_000_000)).otherwise(t))


def place_text(parts: Column, sep: str = ", ") -> Column:
    """Parts of an address, trimmed, each once, in order; NULL if none."""
    return F.nullif(F.array_join(F.array_distinct(F.filter(F.transform(parts, clean), lambda x: x != "")), sep), F.lit(""))


def first_hit(text: Column, phrases: list[str]) -> Column:
    """The first phrase, in the list's order, that the text holds; NULL if none."""
    return F.get(hits(text, phrases), F.lit(0))


def hits(text: Column, phrases: list[str]) -> Column:
    """All phrases that the text holds, in the list's order. The list is one literal of the plan."""
    kept = [p for p in phrases if p.strip()]
    if not kept:
        return F.array().cast("array<string>")
    pairs = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(p.strip().lower()).alias("n")) for p in kept])
    return F.transform(F.filter(pairs, lambda x: text.contains(x["n"])), lambda x: x["p"])


def hits_by_name(text: Column, lookup: dict[str, list[str]]) -> Column:
    """Names of which at least one pattern is in the text, in the lookup's order."""
    kept = {k: [p.strip().lower() for p in v if p.strip()] for k, v in lookup.items()}
    kept = {k: v for k, v in kept.items() if v}
    if not kept:
        return F.array().cast("array<string>")
    rows = F.array(*[F.struct(F.lit(k).alias("name"), F.array(*[F.lit(p) for p in v]).alias("any")) for k, v in kept.items()])
    return F.transform(F.filter(rows, lambda r: F.exists(r["any"], lambda p: text.contains(p))), lambda r: r["name"])
