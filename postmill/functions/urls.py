"""Addresses, read by patterns so that broken ones give NULL instead of an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_URL = r"^\s*([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#\s]+)([^?#]*)(?:\?([^#]*))?"


def part(c: Column, i: int) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), _URL, i), F.lit(""))


def scheme(c: Column) -> Column:
    return F.lower(part(c, 1))


def host(c: Column) -> Column:
    return F.lower(part(c, 2))


def path(c: Column) -> Column:
    return part(c, 3)


def query(c: Column) -> Column:
    return part(c, 4)


def sorted_query(q: Column) -> Column:
    """Pairs in order of name, then value; blank values kept, escapes as they stand."""
    pairs = F.filter(F.split(F.coalesce(q, F.lit("")), "&"), lambda p: p != "")
    keyed = F.transform(pairs, lambda p: F.regexp_replace(p, "^([^=]*)=?", "$1\u0001"))
    return F.array_join(F.transform(F.array_sort(keyed), lambda p: F.replace(p, F.lit("\u0001"), F.lit("="))), "&")


def identity_url(c: Column) -> Column:
    """The form in which postings' addresses compare: scheme and host lower case, no trailing slash, sorted query, no
    fragment. Blank is NULL; what has no scheme or host is taken as it is, trimmed."""
    t = F.trim(F.coalesce(c, F.lit("")))
    p = F.coalesce(F.nullif(F.regexp_replace(F.coalesce(path(t), F.lit("")), "/+$", ""), F.lit("")), F.lit("/"))
    q = sorted_query(query(t))
    made = F.concat(scheme(t), F.lit("://"), host(t), p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    return F.when(t == "", None).when(host(t).isNull(), t).otherwise(made)


def crawl_url(c: Column) -> Column:
    """http(s) only, host lower case, query in its order, no fragment, no trailing slash; else NULL."""
    p = F.coalesce(F.nullif(F.regexp_replace(F.coalesce(path(c), F.lit("")), "/+$", ""), F.lit("")), F.lit("/"))
    q = query(c)
    return F.when(scheme(c).isin("http", "https"), F.concat(scheme(c), F.lit("://"), host(c), p, F.coalesce(F.concat(F.lit("?"), q), F.lit(""))))


def root_url(c: Column) -> Column:
    return F.when(scheme(c).isin("http", "https"), F.concat(scheme(c), F.lit("://"), host(c)))


def is_public(c: Column) -> Column:
    return F.coalesce(scheme(c).isin("http", "https"), F.lit(False))


def registrable(h: Column) -> Column:
    """The last two labels of a host."""
    labels = F.filter(F.split(F.lower(h), r"\."), lambda x: x != "")
    return F.when(F.size(labels) >= 2, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(F.lower(h))


def segments(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(path(c), F.lit("")), "/"), lambda x: x != "")


def without_locale(s: Column) -> Column:
    """Path segments without a leading language like 'en' or 'en-ca'."""
    return F.when(F.get(s, F.lit(0)).rlike("(?i)^[a-z]{2}(-[a-z]{2})?$"), F.slice(s, 2, 1_000_000)).otherwise(s)


def parameter(c: Column, name: str) -> Column:
    """First value of a query parameter; NULL if it is missing or empty."""
    hit = F.filter(F.split(F.coalesce(query(c), F.lit("")), "&"), lambda p: p.startswith(name + "=") & (F.length(p) > len(name) + 1))
    return F.substring(F.get(hit, F.lit(0)), len(name) + 2, 1_000_000)


def posting_ids(c: Column) -> Column:
    """struct(query_id, requisition_id, page): what says that two addresses are the same posting, strongest first."""
    req = F.upper(F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?i)(R_\d+(?:-\d+)?|JR-?\d+(?:-\d+)?)", 1), F.lit("")))
    page = F.when(host(c).isNotNull(), F.concat(scheme(c), F.lit("://"), host(c), F.regexp_replace(F.coalesce(path(c), F.lit("")), "/+$", "")))
    return F.struct(parameter(c, "jobId").alias("query_id"), req.alias("requisition_id"), page.alias("page"))


def resolve(base: Column, link: Column) -> Column:
    """A link of a page as an absolute http(s) address; NULL for fragments, other schemes and blanks. Dot segments are
    not folded."""
    t = F.trim(F.coalesce(link, F.lit("")))
    own = F.lower(F.regexp_extract(t, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    root = F.concat(scheme(base), F.lit("://"), host(base))
    folder = F.regexp_extract(F.coalesce(path(base), F.lit("/")), r"^(.*/)", 1)
    made = (
        F.when((t == "") | t.startswith("#"), None)
        .when(own.isin("http", "https"), t)
        .when(own != "", None)
        .when(t.startswith("//"), F.concat(scheme(base), F.lit(":"), t))
        .when(t.startswith("/"), F.concat(root, t))
        .when(t.startswith("?"), F.concat(root, F.coalesce(path(base), F.lit("/")), t))
        .otherwise(F.concat(root, F.coalesce(F.nullif(folder, F.lit("")), F.lit("/")), t))
    )
    return F.when(is_public(made), made)


def board_token(c: Column, hosts: list[str], api_marker: str | None = None) -> Column:
    """The board's name in an address of one of ``hosts``: its first path segment, or the one after ``api_marker``."""
    s = segments(c)
    known = F.lit(False)
    for h in hosts:
        known = known | (host(c) == h) | host(c).endswith("." + h)
    first = F.get(s, F.lit(0))
    if api_marker:
        at = F.array_position(s, api_marker)
        first = F.when(at > 0, F.get(s, at.cast("int"))).otherwise(first)
    return F.when(known, first)
