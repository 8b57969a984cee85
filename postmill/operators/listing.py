"""Whether a found record looks like a posting, and what is odd about it."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.text import clean, title_text
from postmill.functions.urls import host, is_public, path, registrable


@dataclass(frozen=True)
class ListingRules:
    """Word lists of the tests. The defaults are fixed values of usage on career pages."""

    noise_urls: tuple[str, ...] = ("/privacy", "/terms", "/contact", "/about", "/benefits", "/signin", "/login")
    noise_starts: tuple[str, ...] = ("back to", "learn more", "view all", "show all", "apply now", "browse opportunities", "you belong here", "showing search results")
    url_hints: tuple[str, ...] = ("job", "jobs", "jobdetail", "job-detail", "requisition", "reqid", "position", "posting", "vacancy", "opening")
    title_hints: tuple[str, ...] = (
        "engineer", "developer", "analyst", "administrator", "admin", "consultant", "specialist", "architect", "coordinator", "technician",
        "representative", "associate", "manager", "lead", "support", "operations", "operator", "platform", "infrastructure", "cloud", "devops", "reliability", "systems",
    )
    marketing_starts: tuple[str, ...] = ("why work at", "working at", "life at", "helping ", "our culture", "benefits", "meet ", "students and graduates", "students and grads", "join our talent community")
    generic_titles: tuple[str, ...] = (
        "filter results", "search results", "job search", "careers home", "view all jobs", "all jobs", "departments", "locations", "job category", "category",
        "business area", "employment type", "remote", "hybrid", "on-site", "onsite", "manage consent preferences",
    )
    generic_starts: tuple[str, ...] = ("filter results", "search results", "job search", "careers home")
    index_paths: tuple[str, ...] = ("/careers", "/jobs", "/search", "/job-search", "/job-search-results", "/life-at", "/benefits", "/culture", "/teams", "/locations")
    posting_words: tuple[str, ...] = ("posted", "apply", "job id", "job req", "requisition", "req id")
    context_words: tuple[str, ...] = ("posted", "full-time", "part-time", "contract", "requisition", "job")
    outside_hosts: tuple[str, ...] = (
        "workdayjobs.com", "myworkdayjobs.com", "greenhouse.io", "jobs.lever.co", "ashbyhq.com", "smartrecruiters.com", "njoyn.com",
        "ultipro.com", "ukg.com", "successfactors.com", "oraclecloud.com", "icims.com", "phenompeople.com",
    )


def _holds(c: Column, words: tuple[str, ...]) -> Column:
    return c.rlike("|".join(re.escape(w) for w in words))


def _starts(c: Column, words: tuple[str, ...]) -> Column:
    return c.rlike("^(?:" + "|".join(re.escape(w) for w in words) + ")")


def marketing_title(t: Column, r: ListingRules) -> Column:
    return _starts(t, r.marketing_starts) | t.endswith(" careers") | t.endswith("?")


def generic_title(t: Column, r: ListingRules) -> Column:
    return t.isin(*r.generic_titles) | _starts(t, r.generic_starts) | t.rlike(r"\b\d+\s+available jobs?\b")


def facet_title(t: Column) -> Column:
    return t.rlike(r"^[a-z0-9/&,\- ]+\(\d+\)$")


def index_url(u: Column, r: ListingRules) -> Column:
    p = F.regexp_replace(F.lower(F.coalesce(path(u), F.lit(""))), "/+$", "")
    ends = F.lit(False)
    for x in r.index_paths:
        ends = ends | p.endswith(x)
    return (p != "") & (ends | p.rlike(r"/c/[^/]+-jobs$"))


def title_hint(t: Column, r: ListingRules) -> Column:
    return t.rlike(r"\b(?:" + "|".join(re.escape(w) for w in r.title_hints) + r")\b")


def _external(ext: Column, system: Column, board: Column) -> Column:
    return (clean(ext) != "") & ((clean(system) != "") | (clean(board) != ""))


def allowed_host(u: Column, base: Column, r: ListingRules) -> Column:
    """On the page's own host or domain, or on a known posting system."""
    h, b = host(u), host(base)
    known = _holds(F.lower(F.concat(h, F.coalesce(path(u), F.lit("")))), r.outside_hosts)
    return F.coalesce(h.isNull() | b.isNull() | (h == b) | (registrable(h) == registrable(b)) | known, F.lit(True))


def probable_posting(title: Column, url: Column, description: Column, location: Column, ext: Column, system: Column, board: Column, base: Column | None = None, rules: ListingRules | None = None) -> Column:
    """TRUE for records to keep: a title that is none of the usual other things, a usable address or an id of its
    own, and a sign of a posting in address, title or text. NULL fields count as empty."""
    r = rules or ListingRules()
    base = base if base is not None else F.lit(None).cast("string")
    t = F.lower(title_text(title))
    u, d, loc = F.trim(F.coalesce(url, F.lit(""))), F.lower(clean(description)), clean(location)
    own = _external(ext, system, board)
    low = F.lower(u)
    noise = _holds(low, r.noise_urls) | d.contains("footer") | d.contains("navigation") | _starts(t, r.noise_starts) | low.contains("/apply") | (low.contains("search-results?") & ~d.contains("read full job description"))
    fine_url = (u == "") | (is_public(u) & allowed_host(u, base, r))
    jobish = _holds(low, r.url_hints)
    signal = (F.length(t) >= 4) & (jobish | _holds(d, r.posting_words) | ((loc != "") & title_hint(t, r)))
    context = (loc != "") | _holds(d, r.context_words)
    return (
        (t != "") & ~marketing_title(t, r) & ~generic_title(t, r) & ~facet_title(t) & fine_url & ~noise
        & ~((u != "") & ~own & index_url(u, r)) & ((u != "") | own) & (own | jobish | (title_hint(t, r) & (signal | context)))
    )


def quality_signals(title: Column, url: Column, ext: Column, system: Column, board: Column, mode: Column, rules: ListingRules | None = None) -> Column:
    """Names of what is odd about a record, in a fixed order; empty if nothing is."""
    r = rules or ListingRules()
    t, u = F.lower(title_text(title)), F.trim(F.coalesce(url, F.lit("")))
    own = _external(ext, system, board)
    found = F.array_compact(
        F.array(
            F.when(t == "", "missing_title"), F.when(generic_title(t, r), "generic_title"), F.when(facet_title(t), "facet_count_title"),
            F.when(marketing_title(t, r), "marketing_title"), F.when((u == "") & ~own, "missing_url"), F.when((u != "") & ~is_public(u), "non_actionable_url"),
            F.when((u != "") & ~own & index_url(u, r), "index_or_category_url"),
        )
    )
    browser = clean(mode).isin("browser_allowed", "human_in_loop") & ~own & (F.size(found) > 0)
    return F.concat(found, F.when(browser, F.array(F.lit("browser_without_external_id"))).otherwise(F.array().cast("array<string>")))
