"""Bounded walk over landed pages: which careers pages and boards a site leads to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions.urls import crawl_url, host, is_public, registrable, segments, without_locale
from postmill.operators.classify import system_of_host
from postmill.runtime import materialize

#: Words of path segments that lead to postings. Fixed values of usage.
CAREERS = ("careers", "career", "jobs", "join-us", "work-with-us", "vacancies", "opportunities", "emplois", "carrieres", "karriere", "empleo")


def careers_page(url: Column) -> Column:
    """Whether a path, language aside, begins with a careers word."""
    s = F.transform(without_locale(segments(url)), F.lower)
    return F.coalesce(F.get(s, F.lit(0)).isin(*CAREERS) | host(url).rlike(r"^(careers|jobs|karriere|emplois)\."), F.lit(False))


def classify_links(links: DataFrame) -> DataFrame:
    """``links(url)``, distinct, with ``kind``, ``system`` and ``confidence``; those of no interest are left out."""
    d = links.withColumn("_h", F.when(is_public(F.col("url")), host(F.col("url")))).withColumn("_s", system_of_host(F.col("_h")))
    kind = F.when(F.col("_s") == "restricted_board", "restricted").when(F.col("_s").isNotNull(), "board").when(careers_page(F.col("url")), "careers_page")
    sure = F.when(F.col("_s") == "restricted_board", "low").when(F.col("_s").isNotNull(), "high").otherwise("medium")
    return d.select("url", kind.alias("kind"), F.col("_s").alias("system"), sure.alias("confidence")).where("kind is not null")


def walk(starts: DataFrame, edges: DataFrame, *, max_depth: int = 2, max_pages: int = 8) -> DataFrame:
    """(site, url, depth, arrival): pages visited from each start, level by level in order of arrival, on the start's own
    domain, at most ``max_pages`` a site over all levels.

    ``starts(site, url)``, ``edges(url, position, link)``. Each level is one equality join with the edges and one
    anti-join with what is visited; a level is written before the next begins.
    """
    made = edges.select(crawl_url(F.col("url")).alias("url"), "position", crawl_url(F.col("link")).alias("link"))
    made = materialize(made, "edges").where("url is not null and link is not null")
    edges = materialize(made.where(registrable(host(F.col("link"))) == registrable(host(F.col("url")))), "edges")  # a walk stays on its domain
    seen = starts.select("site", crawl_url(F.col("url")).alias("url")).where("url is not null").groupBy("site").agg(F.min("url").alias("url"))
    seen = materialize(seen.select("site", "url", F.lit(0).alias("depth"), F.lit(1).cast("bigint").alias("arrival")), "walk")
    level = seen
    for depth in range(1, max_depth + 1):
        out = level.alias("l").join(edges.alias("e"), F.col("l.url") == F.col("e.url"))
        cand = out.select(F.col("l.site").alias("site"), F.col("e.link").alias("url"), F.struct(F.col("l.arrival").alias("a"), F.col("e.position").alias("p")).alias("order"))
        cand = cand.groupBy("site", "url").agg(F.min("order").alias("order")).join(seen.select("site", "url"), ["site", "url"], "left_anti")
        have = seen.groupBy("site").agg(F.count(F.lit(1)).alias("n"))
        w = Window.partitionBy("site").orderBy("order", "url")
        new = cand.withColumn("k", F.row_number().over(w)).where(F.col("k") <= max_pages).join(have, "site").where(F.col("n") + F.col("k") <= max_pages)
        level = materialize(new.select("site", "url", F.lit(depth).alias("depth"), (F.col("n") + F.col("k")).alias("arrival")), "walk")
        seen = materialize(seen.union(level), "walk")
        if not level.limit(1).count():
            break
    return seen


def findings(visited: DataFrame, edges: DataFrame) -> DataFrame:
    """(site, url, kind, system, confidence, found_on): the first sighting of each link of interest on visited pages."""
    e = edges.select(crawl_url(F.col("url")).alias("found_on"), "position", crawl_url(F.col("link")).alias("url"))
    j = materialize(visited.select("site", F.col("url").alias("found_on"), "arrival").join(e, "found_on"), "links")
    known = materialize(classify_links(j.select("url").distinct()), "findings")
    order = F.struct("arrival", "position")
    first = j.join(known, "url").groupBy("site", "url").agg(F.min_by(F.struct("kind", "system", "confidence", "found_on"), order).alias("x"))
    return first.select("site", "url", "x.kind", "x.system", "x.confidence", "x.found_on")
