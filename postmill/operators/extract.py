"""Postings out of landed pages.

One parse per page in Arrow batches: links outside navigation, list items, cards, table rows and structured data come
out as rows with the strategy that found them; what is kept is decided by native expressions afterwards.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions.text import clean
from postmill.operators.listing import ListingRules, probable_posting

#: Strategies in the order in which their records count. Fixed values.
STRATEGIES = ("json_ld", "table_row", "card", "list_item", "link")
_SKIP = {"nav", "footer", "header", "aside"}
_BLOCKS = {"article": "card", "section": "card", "li": "list_item", "tr": "table_row"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_TITLES = {"h1", "h2", "h3", "h4", "h5"}
FOUND = "strategy string, position int, title string, href string, location string, text string, date_posted string"


class _Page(HTMLParser):
    """Collects links, blocks, scripts and text in one pass."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.open: list[dict] = []  # blocks that are open
        self.blocks: list[dict] = []
        self.links: list[dict] = []
        self.scripts: list[str] = []
        self.text: list[str] = []
        self.link: dict | None = None
        self.script: list[str] | None = None
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag == "script":
            self.script = [] if "ld+json" in (a.get("type") or "") else None
            self.hidden += 1
        elif tag == "style":
            self.hidden += 1
        if tag in _VOID:
            return
        self.stack.append(tag)
        inside = any(t in _SKIP for t in self.stack)
        css = f"{a.get('class') or ''} {a.get('id') or ''}".lower()
        kind = _BLOCKS.get(tag) or ("card" if tag == "div" and any(x in css for x in ("job", "posting", "position", "opening", "vacancy", "card")) else None)
        if kind and not inside:
            self.open.append({"kind": kind, "depth": len(self.stack), "title": None, "href": None, "location": None, "text": [], "links": 0, "cells": 0})
        if tag == "td" and self.open:
            self.open[-1]["cells"] += 1
        if tag == "a" and a.get("href") is not None:
            self.link = {"href": a["href"], "text": [], "inside": inside, "block": self.open[-1] if self.open else None}
            if self.open:
                self.open[-1]["links"] += 1
                if self.open[-1]["href"] is None:
                    self.open[-1]["href"] = a["href"]
        if self.open and "location" in css:
            self.open[-1]["location"] = ["@", len(self.stack)]

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style") and self.hidden:
            self.hidden -= 1
            if tag == "script" and self.script is not None:
                self.scripts.append("".join(self.script))
                self.script = None
        if tag == "a" and self.link is not None:
            self.links.append(self.link)
            self.link = None
        if tag not in self.stack:
            return
        while self.stack:
            top = self.stack.pop()
            while self.open and self.open[-1]["depth"] > len(self.stack):
                self.blocks.append(self.open.pop())
            if top == tag:
                break

    def handle_data(self, data: str) -> None:
        if self.script is not None:
            self.script.append(data)
        if self.hidden:
            return
        self.text.append(data)
        if self.link is not None:
            self.link["text"].append(data)
        for b in self.open:
            b["text"].append(data)
        if self.open and data.strip():
            b = self.open[-1]
            if b["title"] is None and any(t in _TITLES for t in self.stack[b["depth"] :]):
                b["title"] = " ".join(data.split())
            if isinstance(b["location"], list):
                b["location"] = " ".join(data.split()) if len(self.stack) >= b["location"][1] else None

    def close(self) -> None:
        super().close()
        while self.open:
            self.blocks.append(self.open.pop())


def _squeeze(parts: list[str]) -> str:
    return " ".join(" ".join(parts).split())


def _absolute(base: str, href: str | None) -> str | None:
    t = (href or "").strip()
    if not t or t.startswith("#"):
        return None
    try:
        if urlsplit(t).scheme.lower() not in ("", "http", "https"):
            return None
        made = urljoin(base or "", t)
        return made if urlsplit(made).scheme in ("http", "https") else None
    except ValueError:
        return None


def _structured(text: str) -> Iterator[dict]:
    """JobPosting objects of one script, in lists and graphs too; broken JSON has none."""
    try:
        todo = [json.loads(text)]
    except (ValueError, RecursionError):
        return
    while todo:
        x = todo.pop(0)
        if isinstance(x, list):
            todo = x + todo
        elif isinstance(x, dict):
            kind = x.get("@type")
            if kind == "JobPosting" or (isinstance(kind, list) and "JobPosting" in kind):
                yield x
            if "@graph" in x:
                todo.insert(0, x["@graph"])


def _place(x: object) -> str | None:
    """Places of a structured posting: parts of an address by comma, places by bar, each once."""
    out: list[str] = []
    for p in x if isinstance(x, list) else [x]:
        if isinstance(p, str):
            made = p.strip()
        elif isinstance(p, dict):
            a = p.get("address", p)
            parts = [a] if isinstance(a, str) else [a.get(k) for k in ("addressLocality", "addressRegion", "addressCountry", "name")] if isinstance(a, dict) else []
            parts = [q.get("name") if isinstance(q, dict) else q for q in parts]
            made = ", ".join(dict.fromkeys(str(q).strip() for q in parts if q and str(q).strip()))
        else:
            made = ""
        if made and made not in out:
            out.append(made)
    return " | ".join(out) or None


def parse_page(html: str | None, base: str | None) -> tuple[list[tuple], list[tuple[str, str]], str]:
    """(records, links as (absolute address, text), text) of one page; empty for NULL."""
    if not html:
        return [], [], ""
    p = _Page()
    try:
        p.feed(html)
        p.close()
    except (AssertionError, ValueError):
        pass
    base = base or ""
    rows: list[tuple] = []
    for s in p.scripts:
        for x in _structured(s):
            t = x.get("title") or x.get("name")
            rows.append(("json_ld", str(t) if t else None, _absolute(base, x.get("url") if isinstance(x.get("url"), str) else None), _place(x.get("jobLocation")), str(x.get("description") or "") or None, x.get("datePosted") if isinstance(x.get("datePosted"), str) else None))
    for b in p.blocks:
        text = _squeeze(b["text"])
        if b["href"] is None or not text or (b["kind"] == "card" and b["links"] > 3) or (b["kind"] == "table_row" and b["cells"] < 2):
            continue
        link = next((x for x in p.links if x["block"] is b and x["href"] == b["href"]), None)
        title = b["title"] or (_squeeze(link["text"]) if link else None)
        rows.append((b["kind"], title, _absolute(base, b["href"]), b["location"] if isinstance(b["location"], str) else None, text, None))
    links = []
    for x in p.links:
        u, t = _absolute(base, x["href"]), _squeeze(x["text"])
        if u:
            links.append((u, t))
        if not x["inside"] and t:
            rows.append(("link", t, u, None, _squeeze(x["block"]["text"]) if x["block"] else None, None))
    order = {s: i for i, s in enumerate(STRATEGIES)}
    rows.sort(key=lambda r: order[r[0]])
    return [(r[0], i, r[1], r[2], r[3], r[4], r[5]) for i, r in enumerate(rows)], links, _squeeze(p.text)


def records(pages: DataFrame, *, key: str, url: str, html: str) -> DataFrame:
    """(key, url, strategy, position, title, href, location, text, date_posted): every record of every page, in order
    of strategy. NULL and empty pages have none; broken markup gives what can be read."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, cols = [], [[] for _ in range(7)]
            for r, (u, h) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                for row in parse_page(h, u)[0]:
                    at.append(r)
                    for c, x in zip(cols, row):
                        c.append(x)
            take = pa.array(at, pa.int32())
            types = [pa.string(), pa.int32(), *[pa.string()] * 5]
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *[pa.array(c, t) for c, t in zip(cols, types)]], ["_key", "_url", "strategy", "position", "title", "href", "location", "text", "date_posted"])

    out = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(html).alias("_html")).mapInArrow(run, f"_key {kind}, _url string, {FOUND}")
    return out.withColumnRenamed("_key", key).withColumnRenamed("_url", "page_url")


def links(pages: DataFrame, *, key: str, url: str, html: str) -> DataFrame:
    """(key, position, link, text): absolute http(s) links of every page in order."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, pos, ln, tx = [], [], [], []
            for r, (u, h) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                for i, (x, t) in enumerate(parse_page(h, u)[1]):
                    at.append(r)
                    pos.append(i)
                    ln.append(x)
                    tx.append(t)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(pos, pa.int32()), pa.array(ln, pa.string()), pa.array(tx, pa.string())], ["_key", "position", "link", "text"])

    out = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(html).alias("_html")).mapInArrow(run, f"_key {kind}, position int, link string, text string")
    return out.withColumnRenamed("_key", key)


def page_text(pages: DataFrame, *, key: str, html: str) -> DataFrame:
    """(key, text): what a reader sees, white space squeezed; scripts and styles left out."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([parse_page(h, None)[2] for h in b.column(1).to_pylist()], pa.string())], ["_key", "text"])

    return pages.select(F.col(key).alias("_key"), F.col(html).alias("_html")).mapInArrow(run, f"_key {kind}, text string").withColumnRenamed("_key", key)


def postings(pages: DataFrame, *, key: str, url: str, html: str, max_cards: int = 10_000, rules: ListingRules | None = None, zero_jobs_anywhere: bool = False) -> DataFrame:
    """Records that look like postings, the first of each address (or title and place), at most ``max_cards`` a page.

    A page that says it has no results yields none; '0 jobs' counts as a word by default, ``zero_jobs_anywhere`` takes
    '10 jobs' for it too.
    """
    empty = r"(?i)(no jobs found|no matching jobs|didn't find any relevant jobs|try modifying search|" + ("0 jobs?" if zero_jobs_anywhere else r"\b0 jobs?\b") + ")"
    full = pages.where(~F.coalesce(F.col(html).rlike(empty), F.lit(False)))
    r = records(full, key=key, url=url, html=html)
    none = F.lit(None).cast("string")
    kept = r.where(probable_posting(F.col("title"), F.col("href"), F.col("text"), F.col("location"), none, none, none, F.col("page_url"), rules))
    same = F.coalesce(F.col("href"), F.concat_ws("|", clean(F.col("title")), clean(F.col("location"))))
    w = Window.partitionBy(key, "_same").orderBy("position")
    first = kept.withColumn("_same", same).withColumn("_n", F.row_number().over(w)).where("_n = 1")
    rank = Window.partitionBy(key).orderBy("position")
    return first.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= max_cards).drop("_same", "_n", "_r")


def pagination(found: DataFrame, *, site: str, page_no: str, identity: str, max_pages: int) -> DataFrame:
    """(site, pages_used, stop_reason): pages count in order until one adds no identity not seen before.

    ``found`` has one row per record, or one with NULL identity for a page without any. Reasons: 'no_new_job_urls',
    'max_pages_reached', 'next_disabled_or_missing' (the last page there is), 'single_page_only'.
    """
    first = found.where(F.col(identity).isNotNull()).groupBy(site, identity).agg(F.min(page_no).alias("first"))
    new = first.groupBy(site, F.col("first").alias(page_no)).agg(F.count(F.lit(1)).alias("n_new"))
    pages = found.select(site, page_no).distinct().join(new, [site, page_no], "left").fillna(0, ["n_new"])
    g = pages.groupBy(site).agg(F.max(page_no).alias("last"), F.min(page_no).alias("start"), F.min(F.when(F.col("n_new") == 0, F.col(page_no))).alias("barren"))
    stop = F.least(F.coalesce("barren", F.lit(2**30)), F.col("start") + max_pages - 1, F.col("last"))
    reason = (
        F.when(F.col("barren") == stop, "no_new_job_urls").when((F.col("last") == F.col("start")), "single_page_only").when((stop == F.col("start") + max_pages - 1) & (F.col("last") > stop), "max_pages_reached").otherwise("next_disabled_or_missing")
    )
    return g.select(site, (stop - F.col("start") + 1).cast("int").alias("pages_used"), reason.alias("stop_reason"))
