"""Pieces of SQL that say in DuckDB what the column functions say in Spark; for the oracles."""

from __future__ import annotations

_SPACE = r"[\s\p{Z}\x0b\x{85}]+"
_URL = r"^\s*([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#\s]+)([^?#]*)(?:\?([^#]*))?"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def clean(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), {lit(_SPACE)}, ' ', 'g'))"


def norm(x: str) -> str:
    return clean(f"lower({x})")


def norm_alnum(x: str) -> str:
    return f"trim(regexp_replace({norm(x)}, '[^a-z0-9]+', ' ', 'g'))"


def norm_key(x: str) -> str:
    return f"trim(regexp_replace(replace(lower(coalesce({x}, '')), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"


def strip_tags(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN {clean(f'regexp_replace({x}, {lit("<[^>]+>")}, {lit(" ")}, {lit("g")})')} END"


def search_text(*xs: str) -> str:
    return f"lower(concat_ws(' ', {', '.join(strip_tags(x) for x in xs)}))"


def part(x: str, i: int) -> str:
    return f"nullif(regexp_extract(coalesce({x}, ''), {lit(_URL)}, {i}), '')"


def scheme(x: str) -> str:
    return f"lower({part(x, 1)})"


def host(x: str) -> str:
    return f"lower({part(x, 2)})"


def path(x: str) -> str:
    return part(x, 3)


def query(x: str) -> str:
    return part(x, 4)


def _bare_path(x: str) -> str:
    return f"coalesce(nullif(regexp_replace(coalesce({path(x)}, ''), '/+$', ''), ''), '/')"


def identity_url(x: str) -> str:
    t = f"trim(coalesce({x}, ''))"
    pairs = f"list_filter(str_split(coalesce({query(t)}, ''), '&'), lambda p: p <> '')"
    keyed = f"list_sort(list_transform({pairs}, lambda p: regexp_replace(p, '^([^=]*)=?', '\\1' || chr(1))))"
    q = f"array_to_string(list_transform({keyed}, lambda p: replace(p, chr(1), '=')), '&')"
    return f"CASE WHEN {t} = '' THEN NULL WHEN {host(t)} IS NULL THEN {t} ELSE {scheme(t)} || '://' || {host(t)} || {_bare_path(t)} || CASE WHEN {q} <> '' THEN '?' || {q} ELSE '' END END"


def crawl_url(x: str) -> str:
    return f"CASE WHEN {scheme(x)} IN ('http', 'https') THEN {scheme(x)} || '://' || {host(x)} || {_bare_path(x)} || coalesce('?' || {query(x)}, '') END"


def root_url(x: str) -> str:
    return f"CASE WHEN {scheme(x)} IN ('http', 'https') THEN {scheme(x)} || '://' || {host(x)} END"


def is_public(x: str) -> str:
    return f"coalesce({scheme(x)} IN ('http', 'https'), false)"


def registrable(h: str) -> str:
    labels = f"list_filter(str_split(lower({h}), '.'), lambda x: x <> '')"
    return f"CASE WHEN len({labels}) >= 2 THEN array_to_string({labels}[-2:], '.') ELSE lower({h}) END"


def blank_to_null(x: str) -> str:
    return f"nullif(regexp_replace({x}, '^[\\s\\p{{Z}}\\x0b\\x{{85}}]+|[\\s\\p{{Z}}\\x0b\\x{{85}}]+$', '', 'g'), '')"


def title_text(x: str) -> str:
    t = clean(x)
    cut = f"str_split_regex(substr({t}, 11), '(?i)\\s+(?:location|category|posted)\\s+')[1]"
    return clean(f"CASE WHEN starts_with(lower({t}), 'job title ') THEN {cut} WHEN starts_with(lower({t}), 'apply now ') THEN substr({t}, 11) ELSE {t} END")


def identity_cte(table: str = "jobs") -> str:
    """CTE body: id, kind, key, url and the parts of a posting's identity."""
    cols = ", ".join(f"{norm(c)} AS {a}" for c, a in (("company_name", "co"), ("ats_type", "ats"), ("board_slug", "board"), ("external_job_id", "ext"), ("title", "ti"), ("location", "lo"), ("source_name", "so")))
    return f"""
        SELECT id, url, co, ti, lo, so,
          CASE WHEN co <> '' AND ats <> '' AND ext <> '' AND board <> '' THEN 'company_ats_board_external'
               WHEN co <> '' AND ats <> '' AND ext <> '' THEN 'company_ats_external'
               WHEN url IS NOT NULL THEN 'job_url' ELSE 'company_title_location_source' END AS kind,
          CASE WHEN co <> '' AND ats <> '' AND ext <> '' AND board <> '' THEN concat_ws('|', co, ats, board, ext)
               WHEN co <> '' AND ats <> '' AND ext <> '' THEN concat_ws('|', co, ats, ext)
               WHEN url IS NOT NULL THEN url ELSE concat_ws('|', co, ti, lo, so) END AS key
        FROM (SELECT id, {identity_url('job_url')} AS url, {cols} FROM {table})"""


def in_list(words) -> str:
    return "(" + ", ".join(lit(w) for w in words) + ")"


def text_list(words) -> str:
    return "[" + ", ".join(lit(w) for w in words) + "]"


def hits(text: str, words) -> str:
    """Phrases that a text holds, in order."""
    return f"list_filter({text_list(words)}, lambda p: contains({text}, lower(p)))" if words else "CAST([] AS VARCHAR[])"


def hits_by_name(text: str, lookup: dict[str, list[str]]) -> str:
    parts = ", ".join(f"CASE WHEN {' OR '.join(f'contains({text}, {lit(p.lower())})' for p in v)} THEN {lit(k)} END" for k, v in lookup.items())
    return f"list_filter([{parts}], lambda x: x IS NOT NULL)"
