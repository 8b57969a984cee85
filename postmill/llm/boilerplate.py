"""Page wording mixed with the text of a posting.

Wrapper induction over the pages of a host. A page is the tree of its lines and of the items inside them; pages of a
host are aligned node by node, equal nodes (company name, numbers and markup aside) being constant. With flat trees
simple tree matching is the matching of equal nodes, so the alignment of all pages with all is the support of each
node in its host: no pairs of pages are formed. Constant nodes become template, varying nodes between them content,
in three refinements that the data need:

* a posting's own headings are constant too, but also on pages that carry no template at all. A node is template only
  if (nearly) all pages that hold it hold other template nodes, significantly more often than its hosts' pages do;
* the slot that follows a list heading ("recently viewed") holds other postings' titles: it varies, but is no content.
  Headings of slots are the template nodes that varying lines which are no sentences follow as a rule;
* the words of those slots are what titles look like without page wording: words that titles of postings hold at
  their edges, but slots never, are page wording.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.runtime import broadcast_if_small, materialize

_TAG = r"</?[A-Za-z][^<>\n]*>"
_ITEMS = r"\s*[|/>·]\s*|\s{2,}"
LABEL, CONTENT, HEAD = 1, 2, 3
#: Least pages a node is on, to be judged at all.
LEAST_PAGES = 8
#: Codes are looked up in the Python workers' memory up to so many nodes (16 bytes each), by a join beyond.
IN_MEMORY = 4_000_000


def _node(c: Column) -> Column:
    """A line's node: markup to bars, numbers to 0, outer blanks and bars off."""
    c = F.regexp_replace(c, _TAG, "|")
    c = F.regexp_replace(c, r"\d+(?:[.,]\d+)*", "0")
    c = F.regexp_replace(c, r"\|[ \t\r\x{a0}|]*\|", "|")
    return F.regexp_replace(c, r"(?md)^[ \t\r\x{a0}|]+|[ \t\r\x{a0}|]+$", "")


def pages(rows: DataFrame, *, key: str, text: str, host: str, company: str, lang: str) -> DataFrame:
    """(row, id, host, lang, nodes, n_lines, part_of, kinds, loose): the nodes of a page; lines first, then items of lines.

    ``row`` is a number of the row's own, good once the table is written; ids may repeat. ``nodes`` are hashes, 0 for a line without one; ``part_of`` names the line of each item. ``kinds`` per line: 0
    blank, 1 markup alone, 2 a sentence, 3 other. ``loose`` has the text of lines of kind 3, for slots.
    """
    named = F.when(F.trim(F.coalesce(F.col(company), F.lit(""))) != "", F.replace(F.col(text), F.col(company), F.lit("{c}"))).otherwise(F.col(text))
    src = rows.where(F.col(text).isNotNull()).select(
        F.col(key).alias("id"),
        F.xxhash64(F.coalesce(F.col(host), F.lit(""))).alias("host"),
        F.coalesce(F.col(lang), F.lit("")).alias("lang"),
        F.split(F.col(text), "\n", -1).alias("raw"),
        F.split(_node(named), "\n", -1).alias("lines"),
    )
    lower_words = lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: w.rlike(r"^\p{Ll}")))
    words = lambda x: F.size(F.split(x, r"\s+"))
    sentence = lambda x: x.endswith(".") & (words(x) >= 5) & (lower_words(x) * 5 >= words(x) * 2)
    kind = lambda x, i: (
        F.when(~F.get(F.col("raw"), i).rlike(r"[^\s\x{a0}]"), 0).when(x == "", 1).when(sentence(x), 2).otherwise(3).cast("tinyint")
    )
    items = lambda x: F.filter(F.split(x, _ITEMS), lambda p: p != "")
    own = lambda x, i: F.when(x.rlike(r"[|/>·]|\s{2,}"), items(x)).otherwise(F.array().cast("array<string>"))
    many = lambda x, i: F.when(F.size(own(x, i)) >= 2, F.transform(own(x, i), lambda p: F.struct(i.alias("line"), F.xxhash64(p).alias("node")))).otherwise(F.array().cast("array<struct<line:int,node:bigint>>"))
    src = src.select(
        "id", "host", "lang",
        F.transform("lines", lambda x: F.when(x == "", F.lit(0).cast("bigint")).otherwise(F.xxhash64(x))).alias("line_nodes"),
        F.flatten(F.transform("lines", many)).alias("parts"),
        F.transform("lines", kind).alias("kinds"),
        "raw",
    )
    return src.select(
        F.monotonically_increasing_id().alias("row"), "id", "host", "lang",
        F.concat(F.col("line_nodes"), F.col("parts.node")).alias("nodes"),
        F.size("line_nodes").alias("n_lines"),
        F.col("parts.line").alias("part_of"),
        "kinds",
        F.transform("raw", lambda x, i: F.when(F.get(F.col("kinds"), i) == 3, F.regexp_replace(x, _TAG, " "))).alias("loose"),
    )


def with_codes(p: DataFrame, codes: DataFrame) -> DataFrame:
    """``p`` with ``codes`` aligned to ``nodes``, from the table ``codes(node, code)``; 0 where it has none.

    Beyond ``IN_MEMORY`` codes they are joined, and come together by ``row``; without it the rows are written and numbered.
    """
    rest = [c for c in p.columns]
    some = codes.limit(IN_MEMORY + 1).toArrow() if codes.limit(IN_MEMORY + 1).count() <= IN_MEMORY else None
    if some is None:
        if "row" not in rest:
            p = materialize(p.withColumn("row", F.monotonically_increasing_id()), "rows")
        one = p.select("row", F.posexplode("nodes").alias("at", "node")).join(codes, "node", "left")
        got = one.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("code", F.lit(0)).cast("tinyint").alias("code")))).alias("_c"))
        return p.join(got, "row", "left").select(*rest, F.coalesce("_c.code", F.array().cast("array<tinyint>")).alias("codes"))
    keys = some.column("node").to_numpy().astype(np.int64)
    order = np.argsort(keys)
    keys, vals = keys[order], some.column("code").to_numpy().astype(np.int8)[order]
    schema = ", ".join([*[f"{c} {p.schema[c].dataType.simpleString()}" for c in rest], "codes array<tinyint>"])
    at = rest.index("nodes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(at)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            if len(keys):
                k = np.minimum(np.searchsorted(keys, flat), len(keys) - 1)
                c = np.where(keys[k] == flat, vals[k], 0).astype(np.int8)
            else:
                c = np.zeros(len(flat), np.int8)
            offsets = lists.offsets.to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(c, pa.int8()))], [*rest, "codes"])

    return p.mapInArrow(run, schema)


def _judge(p: DataFrame, codes: DataFrame, *, least: int, share: float, score: float, pages_at_least: int) -> DataFrame:
    """(node, code) of the nodes of ``codes``, by the pages that hold ``least`` template nodes besides.

    A node is template if ``share`` of its pages are such, and these are ``score`` standard deviations above what the
    rate of such pages would give: the rate of the language for nodes on three hosts or more, else that of the host.
    """
    coded = with_codes(p.select("row", "host", "lang", "nodes", "n_lines"), codes)
    u = F.array_distinct(F.arrays_zip("nodes", "codes"))
    per_page = coded.select("host", "lang", u.alias("u")).select("host", "lang", "u", F.size(F.filter("u", lambda x: x.codes == LABEL)).alias("m"))
    # the page itself goes along as node 0
    itself = F.array(F.struct(F.lit(0).cast("bigint").alias("nodes"), F.lit(-1).cast("tinyint").alias("codes")))
    every = F.concat(itself, F.filter("u", lambda x: (x.codes > 0) & (x.nodes != 0)))
    seen = per_page.select("host", "lang", "m", F.explode(every).alias("x")).select(
        "host", "lang", F.col("x.nodes").alias("node"), (F.col("m") - F.when(F.col("x.codes") == LABEL, 1).otherwise(0) >= least).cast("int").alias("c")
    )
    counts = materialize(seen.groupBy("host", "lang", "node").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c")), "nodes")
    own = counts.where("node = 0")
    rate = lambda k: ((F.sum("c") + 0.5) / (F.sum("n") + 1)).alias(k)
    by_host, by_lang = own.groupBy("host").agg(rate("host_rate")), own.groupBy("lang").agg(rate("lang_rate"))
    j = counts.where("node <> 0").join(broadcast_if_small(by_host, 1_000_000), "host").join(broadcast_if_small(by_lang, 1_000_000), "lang")
    n, hr, lr = F.col("n"), F.col("host_rate"), F.col("lang_rate")
    by = j.groupBy("node").agg(
        F.sum("n").alias("n"), F.sum("c").alias("c"), F.count(F.lit(1)).alias("hosts"),
        F.sum(n * hr).alias("eh"), F.sum(n * hr * (1 - hr)).alias("vh"), F.sum(n * lr).alias("el"), F.sum(n * lr * (1 - lr)).alias("vl"),
    )
    z = F.when(F.col("hosts") >= 3, (F.col("c") - F.col("el")) / F.sqrt(F.col("vl") + 0.25)).otherwise((F.col("c") - F.col("eh")) / F.sqrt(F.col("vh") + 0.25))
    template = (F.col("n") >= pages_at_least) & (F.col("c") >= share * F.col("n")) & (z >= score)
    return by.select("node", F.when(template, LABEL).when(F.col("c") < 0.93 * F.col("n"), CONTENT).otherwise(4).cast("tinyint").alias("code"))


def induce(p: DataFrame) -> DataFrame:
    """(node, code) of the nodes on LEAST_PAGES pages or more: LABEL for template, CONTENT for surely not, 4 between."""
    hosts = p.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    hosts = materialize(hosts, "hosts")
    n_hosts = hosts.count()
    support = p.select("host", F.explode(F.array_distinct("nodes")).alias("node")).where("node <> 0").groupBy("host", "node").agg(F.count(F.lit(1)).alias("n"))
    j = support.join(broadcast_if_small(hosts, 1_000_000), "host")
    seeds = j.groupBy("node").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("hosts"), F.max(((F.col("host_pages") >= LEAST_PAGES) & (F.col("n") >= 0.2 * F.col("host_pages"))).cast("int")).alias("often")
    )
    # what most hosts have is what postings are like; what some have on many of their pages is a first guess
    first = seeds.where(F.col("n") >= LEAST_PAGES).select("node", F.when((F.col("often") == 1) & (F.col("hosts") < max(2, 0.45 * n_hosts)), LABEL).otherwise(4).cast("tinyint").alias("code"))
    codes = materialize(first, "seeds")
    codes = materialize(_judge(p, codes, least=2, share=0.85, score=4.0, pages_at_least=15), "codes1")
    return materialize(_judge(p, codes, least=1, share=0.965, score=3.0, pages_at_least=LEAST_PAGES), "codes2")


def _heads(coded: DataFrame) -> DataFrame:
    """Template lines that varying lines which are no sentences follow as a rule: of the lines that follow, two thirds
    are of kind 3, not surely content, and none of them follows more than one time in twenty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: dict[tuple[int, int], int] = {}
            for nodes, n_lines, kinds, codes in zip(*(b.column(i).to_pylist() for i in range(4))):
                last = 0
                for i in range(n_lines):
                    k = nodes[i]
                    if not k:
                        continue
                    c = codes[i]
                    if last:
                        x = (last, k if c != CONTENT and kinds[i] == 3 else 0)
                        n[x] = n.get(x, 0) + 1
                    last = k if c == LABEL else 0
            if n:
                cols = [pa.array([x[0] for x in n], pa.int64()), pa.array([x[1] for x in n], pa.int64()), pa.array(list(n.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["node", "follow", "n"])

    got = coded.select("nodes", "n_lines", "kinds", "codes").mapInArrow(run, "node bigint, follow bigint, n bigint")
    pairs = materialize(got.groupBy("node", "follow").agg(F.sum("n").alias("n")), "pairs")
    whole = pairs.groupBy("node").agg(F.sum("n").alias("all")).where("all >= 12")
    loose = pairs.where("follow <> 0").join(whole, "node").where("n <= greatest(2, 0.05 * all)")
    return loose.groupBy("node").agg(F.sum("n").alias("n"), F.first("all").alias("all")).where("n >= 0.65 * all").select("node")


def page_lines(rows: DataFrame, *, key: str, text: str, host: str, company: str, lang: str) -> DataFrame:
    """(id, line_no, why, loose): one row per line that is page wording, lines counted from 1.

    ``why`` is 'template', 'items' (a line of template items), 'markup' or 'slot' (then ``loose`` is its text). Blank
    lines are never page wording; NULL and empty texts have none; a page may be page wording as a whole. A node on
    fewer than ``LEAST_PAGES`` pages is judged by its items and place alone. Repeated rows each give their lines.
    """
    p = materialize(pages(rows, key=key, text=text, host=host, company=company, lang=lang), "pages")
    codes = induce(p)
    heads = materialize(_heads(with_codes(p, codes)), "heads")
    final = materialize(codes.where(F.col("code") != 4).join(heads.withColumn("_h", F.lit(True)), "node", "left").select("node", F.when(F.col("_h"), HEAD).otherwise(F.col("code")).cast("tinyint").alias("code")), "final")
    coded = with_codes(p.select("row", "id", "nodes", "n_lines", "part_of", "kinds", "loose"), final).drop("row")
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, at, line, why, loose = b.column(0), [], [], [], []
            for r, (n_lines, part_of, kinds, texts, codes) in enumerate(zip(*(b.column(i).to_pylist() for i in range(2, 7)))):
                parts: dict[int, bool] = {}
                for x, c in zip(part_of, codes[n_lines:]):
                    parts[x] = parts.get(x, True) and c in (LABEL, HEAD)
                on = False
                for i in range(n_lines):
                    k, c, w = kinds[i], codes[i], None
                    if k == 0:
                        continue
                    if c == HEAD:
                        on, w = True, "template"
                    elif c == LABEL:
                        w = "template"
                    elif k == 1:
                        w = "markup"
                    elif parts.get(i):
                        w = "items"
                    elif on and k == 3 and c != CONTENT:
                        w = "slot"
                    else:
                        on = False
                    if w:
                        at.append(r)
                        line.append(i + 1)
                        why.append(w)
                        loose.append(texts[i] if w == "slot" else None)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int32())), pa.array(line, pa.int32()), pa.array(why, pa.string()), pa.array(loose, pa.string())], ["id", "line_no", "why", "loose"])

    return coded.mapInArrow(run, f"id {kind}, line_no int, why string, loose string")


def _words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"\{c\}|[\p{L}]+"), F.lit(0))


def title_wording(rows: DataFrame, slots: DataFrame, *, key: str, title: str, company: str) -> DataFrame:
    """(id): titles that carry page wording.

    Candidates are the words that titles hold but slots (``slots(loose)``, titles as other pages show them) do not:
    at least 15 would be expected there, and at most 2 % of that are found. Of these, words are page wording that
    stand, with other candidates only, at an edge of the title in nine of ten cases. The company's name counts as one
    such word. NULL and empty titles carry none.
    """
    named = F.when(F.trim(F.coalesce(F.col(company), F.lit(""))) != "", F.replace(F.col(title), F.col(company), F.lit("{c}"))).otherwise(F.col(title))
    t = rows.where(F.col(title).isNotNull()).select(F.col(key).alias("id"), _words(named).alias("w"))
    n_titles, n_slots = t.count(), slots.count()
    if not n_slots or not n_titles:
        return t.select("id").limit(0)
    f = n_slots / n_titles
    in_titles = t.select(F.explode(F.array_distinct("w")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    in_slots = slots.select(F.explode(F.array_distinct(_words(F.col("loose")))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("s"))
    cand = in_titles.where(F.col("n") * f >= 15).join(in_slots, "word", "left").where(F.coalesce("s", F.lit(0)) <= 0.02 * f * F.col("n")).select("word")
    cand = materialize(cand.union(cand.sparkSession.createDataFrame([("{c}",)], "word string")).distinct(), "words")
    each = t.select("id", F.size("w").alias("n"), F.posexplode("w").alias("at", "word"))
    hit = each.join(broadcast_if_small(cand, 200_000), "word")
    # positions of candidates of a title; runs from either edge
    per = hit.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("h"))
    before = F.expr("filter(h, (x, i) -> x.at = i)")
    after = F.expr("filter(h, (x, i) -> n - 1 - x.at = size(h) - 1 - i)")
    per = materialize(per.select("id", F.col("h.word").alias("all"), F.array_union(F.transform(before, lambda x: x.word), F.transform(after, lambda x: x.word)).alias("edge")), "edges")
    total = per.select(F.explode(F.array_distinct("all")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    edge = per.select(F.explode("edge").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("e"))
    page = total.join(edge, "word").where("e >= 0.9 * n").select("word")
    return per.select("id", F.explode("edge").alias("word")).join(broadcast_if_small(page, 200_000), "word").select("id").distinct()
