"""Sources: which system serves them, how they may be read, which collector takes them, what state they are in.

All rules are ordered CASE expressions; tables of hosts and words are arguments with the usual values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.urls import host, is_public

#: Public boards that are never read by machine. Fixed values.
RESTRICTED = ("linkedin.com", "indeed.com", "glassdoor.com")
#: Hosts of posting systems. Fixed values.
SYSTEM_HOSTS: dict[str, tuple[str, ...]] = {
    "greenhouse": ("boards.greenhouse.io", "job-boards.greenhouse.io", "boards-api.greenhouse.io"),
    "lever": ("jobs.lever.co", "api.lever.co"),
    "ashby": ("ashbyhq.com", "jobs.ashbyhq.com"),
    "smartrecruiters": ("smartrecruiters.com", "jobs.smartrecruiters.com"),
    "workday": ("myworkdayjobs.com", "workdayjobs.com"),
    "successfactors": ("successfactors.com", "sapsf.com"),
    "oracle_hcm": ("oraclecloud.com", "fa-ext.oraclecloud.com"),
    "icims": ("icims.com",),
    "phenom": ("phenompeople.com",),
}
#: Words that name a system in a hint. Fixed values.
SYSTEM_WORDS: dict[str, tuple[str, ...]] = {
    "greenhouse": ("greenhouse",),
    "lever": ("lever",),
    "ashby": ("ashby", "ashbyhq"),
    "smartrecruiters": ("smartrecruiters", "smart recruiters", "smart_recruiters"),
    "workday": ("workday",),
    "successfactors": ("successfactors", "success factors", "success_factors", "sapsf"),
    "oracle_hcm": ("oracle", "oraclecloud", "oracle cloud", "oracle_hcm"),
    "icims": ("icims",),
    "phenom": ("phenom",),
}
#: Other spellings of a system's name. Fixed values.
SYSTEM_ALIASES = {
    "ashbyhq": "ashby", "greenhouseio": "greenhouse", "oraclecloud": "oracle_hcm", "oracle_hcm": "oracle_hcm", "oracle": "oracle_hcm",
    "sapsf": "successfactors", "smart_recruiters": "smartrecruiters", "success_factors": "successfactors",
}
API_SYSTEMS = ("greenhouse", "lever", "ashby", "smartrecruiters")
HUMAN_SYSTEMS = ("workday", "successfactors", "oracle_hcm", "icims", "phenom", "ultipro")
#: Outcomes of a run. Fixed values.
SUCCESS = ("success", "completed", "no_jobs_found")
ERROR = ("error", "api_error", "parse_error", "unsupported_source_mode")
SKIPPED = ("manual_only", "needs_url", "api_collector_not_implemented", "avoid", "skipped")
API_COLLECTORS = ("greenhouse_api", "lever_api", "ashby_api")
BROWSER_COLLECTORS = ("browser", "browser_after_jsonld", "browser_fallback")


def _low(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def _any(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for x in words:
        out = out | c.contains(x)
    return out


def _chain(pairs: list[tuple[Column, Column | str]], otherwise: Column | None = None) -> Column:
    out = None
    for cond, value in pairs:
        v = F.lit(value) if isinstance(value, str) else value
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return out.otherwise(otherwise if otherwise is not None else F.lit(None).cast("string"))


def is_restricted(url: Column) -> Column:
    """Whether the host holds the name of a restricted board, anywhere in it."""
    return is_public(url) & _any(host(url), RESTRICTED)


def system_of_host(h: Column) -> Column:
    """The posting system that a host belongs to: its own name or one under it; 'restricted_board' for those boards.
    Give a column that holds the host, so it is read from the address once."""

    def under(names: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for n in names:
            out = out | (h == n) | h.endswith("." + n)
        return out

    return _chain([(_any(h, RESTRICTED), "restricted_board"), *[(under(n), s) for s, n in SYSTEM_HOSTS.items()]])


def normal_hint(hint: Column) -> Column:
    """The system a hint names exactly, by its own or another spelling; else NULL."""
    t = F.replace(F.replace(_low(hint), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))
    known = F.create_map(*[F.lit(x) for kv in SYSTEM_ALIASES.items() for x in kv])
    t = F.coalesce(F.try_element_at(known, t), t)
    return F.when(t.isin(*SYSTEM_WORDS, "restricted_board", "ultipro"), t)


def _from_hint(hint: Column) -> Column:
    low = _low(hint)
    return F.coalesce(
        F.when(_any(low, ("linkedin", "indeed", "glassdoor")), "restricted_board"), normal_hint(hint), _chain([(_any(low, w), s) for s, w in SYSTEM_WORDS.items()])
    )


def detect_system(url: Column, hint: Column, category: Column) -> Column:
    """Restricted host, then the hint, then the category, then the host itself or a host above it; else NULL."""
    h = host(url)

    def under(names: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for n in names:
            out = out | (h == n) | h.endswith("." + n)
        return out

    by_host = F.when(is_public(url), _chain([(under(n), s) for s, n in SYSTEM_HOSTS.items()]))
    return F.coalesce(F.when(is_restricted(url), "restricted_board"), _from_hint(hint), _from_hint(category), by_host)


def select_mode(url: Column, system: Column, current: Column) -> Column:
    """How a source may be read; a set 'manual_only' or 'avoid' stands."""
    now = _low(current)
    return _chain(
        [(now.isin("manual_only", "avoid"), now), (~is_public(url), "needs_url"), (system == "restricted_board", "manual_only"), (system.isin(*API_SYSTEMS), "api_allowed"), (system.isin(*HUMAN_SYSTEMS), "human_in_loop")],
        F.lit("browser_allowed"),
    )


def route(mode: Column, system: Column, api_status: Column, page_status: Column, fallback: bool, api_ready: tuple[str, ...] = ("greenhouse", "lever", "ashby")) -> Column:
    """struct(collector, status, fallback_used, intervention_required) from the recorded outcomes of an API call and of
    the check for structured data in the page; a NULL outcome counts as failed."""
    has_api = system.isin(*api_ready)
    api_fine = F.coalesce(api_status.isin("success", "no_jobs_found"), F.lit(False))
    api = mode == "api_allowed"
    waiting = api & ~F.coalesce(has_api, F.lit(False)) & F.coalesce(system.isin(*API_SYSTEMS), F.lit(False)) & F.lit(not fallback)
    page_fine = F.coalesce(page_status == "success", F.lit(False))
    collector = _chain(
        [
            (mode == "manual_only", "manual_only"), (mode == "needs_url", "needs_url"),
            (api & has_api & (api_fine | F.lit(not fallback)), F.concat(system, F.lit("_api"))), (waiting, "api_not_implemented"),
            (api & (has_api | F.lit(fallback)), "browser_fallback"), (api, "browser"),
            ((mode == "browser_allowed") & page_fine, "static_jsonld"), (mode == "browser_allowed", "browser_after_jsonld"), (mode == "human_in_loop", "browser"),
        ],
        F.lit("needs_url"),
    )
    status = _chain(
        [(collector == "manual_only", "manual_only"), ((mode == "needs_url"), "needs_url"), (collector.endswith("_api"), F.coalesce(api_status, F.lit("api_error"))), (waiting, "api_collector_not_implemented"), (collector == "static_jsonld", "success"), (collector.startswith("browser"), "completed")],
        F.lit("unsupported_source_mode"),
    )
    used = collector.isin("browser_fallback", "browser_after_jsonld")
    return F.struct(collector.alias("collector"), status.alias("status"), used.alias("fallback_used"), (mode == "manual_only").alias("intervention_required"))


def readiness(status: Column, mode: Column, collector: Column, intervention: Column) -> Column:
    """The state of a source, first rule that holds."""
    st, m, c = F.trim(F.coalesce(status, F.lit(""))), F.trim(F.coalesce(mode, F.lit(""))), F.trim(F.coalesce(collector, F.lit("")))
    fine = st.isin(*SUCCESS)
    return _chain(
        [
            (st.isin(*ERROR), "error"), (st == "api_collector_not_implemented", "api_not_implemented"), ((st == "needs_url") | (m == "needs_url"), "needs_url"),
            ((st == "manual_only") | (m == "manual_only"), "manual_only"), ((st == "paused") | F.coalesce(intervention, F.lit(False)), "needs_human"),
            ((c == "static_jsonld") & fine, "ready_static_jsonld"), (c.isin(*BROWSER_COLLECTORS) & fine, "ready_browser"), (m == "api_allowed", "ready_api"),
            (m == "browser_allowed", "ready_browser"), (m == "human_in_loop", "needs_human"),
        ],
        F.lit("ready_browser"),
    )


def remediation(reason: Column, status: Column, mode: Column, ready: Column, by_reason: dict[str, str]) -> Column:
    """What to do next: by the reason of an open issue, else by the state."""
    st, m, r = F.trim(F.coalesce(status, F.lit(""))), F.trim(F.coalesce(mode, F.lit(""))), F.trim(F.coalesce(reason, F.lit("")))
    listed = F.try_element_at(F.create_map(*[F.lit(x) for kv in by_reason.items() for x in kv]), r) if by_reason else F.lit(None).cast("string")
    rest = _chain(
        [
            ((ready == "needs_url") | (st == "needs_url") | (m == "needs_url"), "source_url_review"), ((ready == "manual_only") | (st == "manual_only") | (m == "manual_only"), "manual_tracking"),
            ((ready == "api_not_implemented") | (st == "api_collector_not_implemented"), "api_pending"), ((ready == "error") | st.isin(*ERROR), "source_error"),
            ((ready == "needs_human") | (st == "paused"), "human_review"), (st.isin(*SUCCESS), "monitor_only"),
        ],
        F.lit("review_needed"),
    )
    return F.coalesce(listed, rest)


def barriers(text: Column, rules: dict[str, tuple[str, ...]]) -> Column:
    """Names of the rules of which a phrase stands in a page's text, in the rules' order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(_any(low, words), name) for name, words in rules.items()]))
