"""Checking a system's results against verified ones: one-to-one linkage, precision and recall, recall by address,
validation of files."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions.text import norm, norm_alnum, parse_bool, ratio
from postmill.functions.urls import identity_url, posting_ids
from postmill.runtime import materialize

#: Tiers of a link with their confidence, first is tried first. Fixed values.
TIERS = (("external_job_id", "high"), ("url", "high"), ("title_location", "medium"))


def components(members: DataFrame) -> DataFrame:
    """(node, component) for ``members(node, key)``: nodes that share keys, directly or over others, are one component,
    named by its smallest node. Labels go from nodes to keys and back until none changes; no pairs are formed, and each
    round is written, so a lost executor costs one round."""
    m = materialize(members.select("node", "key").distinct(), "members")
    label = materialize(m.select("node").distinct().withColumn("component", F.col("node")), "label")
    while True:
        by_key = m.join(label, "node").groupBy("key").agg(F.min("component").alias("c"))
        nxt = m.join(by_key, "key").groupBy("node").agg(F.min("c").alias("new"))
        both = materialize(label.join(nxt, "node").select("node", F.least("component", "new").alias("component"), (F.col("new") < F.col("component")).alias("moved")), "label")
        label = both.select("node", "component")
        if not both.where("moved").limit(1).count():
            return label


def _link_keys(df: DataFrame, seq: str) -> DataFrame:
    """``df`` with the three keys of a link, each within the company; NULL where a tier does not apply."""
    co = norm_alnum(F.col("company_name"))
    ext, url = norm_alnum(F.col("external_job_id")), identity_url(F.col("job_url"))
    key = lambda tag, c: F.concat(F.lit(tag), co, F.lit("|"), c)
    return df.select(
        F.col(seq).alias("seq"), F.when(ext != "", key("0|", ext)).alias("k0"), key("1|", url).alias("k1"),
        key("2|", F.concat_ws("|", norm_alnum(F.col("title")), norm_alnum(F.col("location")))).alias("k2"),
    )


def link(system: DataFrame, manual: DataFrame, *, seq: str = "seq") -> DataFrame:
    """(system_seq, manual_seq, tier, confidence): system rows in order each take the first verified row that is still
    free, by id, else by address, else by title and place, all within the company in its normal form.

    The order matters, so rows that may compete are replayed in order; these are the rows connected by keys, found
    first, and never a whole company. Both sides need ``seq``, unique, and the five columns of a posting. Blank titles
    and places are equal to each other.
    """
    s, m = _link_keys(system, seq), _link_keys(manual, seq)
    both = s.select("seq", F.lit(0).alias("side"), "k0", "k1", "k2").union(m.select("seq", F.lit(1).alias("side"), "k0", "k1", "k2"))
    both = materialize(both.withColumn("node", F.col("seq") * 2 + F.col("side")), "sides")
    each = both.select("node", "side", F.explode(F.array_compact(F.array("k0", "k1", "k2"))).alias("key"))
    # keys that only one side has link nothing
    two = each.groupBy("key").agg(F.min("side").alias("a"), F.max("side").alias("b")).where("a <> b").select("key")
    label = components(each.join(two, "key").select("node", "key"))

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        free: list[dict] = [{}, {}, {}]
        ours = pdf[pdf.side == 1].sort_values("seq")
        for t in range(3):
            for q, k in zip(ours.seq, ours[f"k{t}"]):
                if k is not None:
                    free[t].setdefault(k, []).append(q)
        taken, out = set(), []
        for q, *keys in pdf[pdf.side == 0].sort_values("seq")[["seq", "k0", "k1", "k2"]].itertuples(index=False):
            for t, k in enumerate(keys):
                queue = free[t].get(k, []) if k is not None else []
                while queue and queue[0] in taken:
                    queue.pop(0)
                if queue:
                    taken.add(queue[0])
                    out.append((q, queue[0], TIERS[t][0], TIERS[t][1]))
                    break
        return pd.DataFrame(out, columns=["system_seq", "manual_seq", "tier", "confidence"])

    return both.join(label, "node").groupBy("component").applyInPandas(replay, "system_seq bigint, manual_seq bigint, tier string, confidence string")


def verdicts(system: DataFrame, manual: DataFrame, *, seq: str = "seq") -> DataFrame:
    """(company_name, system_seq, manual_seq, manual_relevant, audit_status, confidence): every system row, and every
    relevant verified row that nothing was linked to.

    Both sides carry ``manual_relevant`` and the system ``manual_found`` as texts. A link to a row that is not marked
    relevant is 'not_relevant'; without a link the system row's own marks decide.
    """
    l = materialize(link(system, manual, seq=seq), "links")
    s = system.select(F.col(seq).alias("system_seq"), "company_name", parse_bool(F.col("manual_found")).alias("found"), parse_bool(F.col("manual_relevant")).alias("own"))
    m = manual.select(F.col(seq).alias("manual_seq"), F.col("company_name").alias("m_company"), F.coalesce(parse_bool(F.col("manual_relevant")), F.lit(False)).alias("m_relevant"))
    j = s.join(l, "system_seq", "left").join(m.drop("m_company"), "manual_seq", "left")
    linked = F.col("manual_seq").isNotNull()
    status = (
        F.when(linked, F.when(F.col("m_relevant"), "matched").otherwise("not_relevant"))
        .when(~F.col("found"), "false_positive").when(~F.col("own"), "not_relevant").when(F.col("found") & F.col("own"), "matched").otherwise("unclear")
    )
    conf = F.when(linked, F.col("confidence")).when(status.isin("false_positive", "not_relevant"), "high").otherwise("low")
    ours = j.select("company_name", "system_seq", "manual_seq", F.when(linked, F.col("m_relevant")).otherwise(F.col("own")).alias("manual_relevant"), status.alias("audit_status"), conf.alias("confidence"))
    missing = m.where("m_relevant").join(l.select("manual_seq"), "manual_seq", "left_anti")
    theirs = missing.select(F.col("m_company").alias("company_name"), F.lit(None).cast("bigint").alias("system_seq"), "manual_seq", F.lit(True).alias("manual_relevant"), F.lit("missing").alias("audit_status"), F.lit("high").alias("confidence"))
    return ours.unionByName(theirs)


def metrics(v: DataFrame) -> DataFrame:
    """Counts, precision and recall per company and for 'Overall'; 0 where nothing is to divide by."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False))).alias
    st = F.col("audit_status")
    aggs = [
        F.count("system_seq").alias("saved"), n(F.col("manual_relevant"))("relevant"), n(st == "matched")("matched"), n(st.isin("false_positive", "not_relevant"))("false_positive"),
        n(st == "missing")("missing"), n(st == "unclear")("unclear"),
    ]
    g = v.withColumn("company_name", F.trim(F.coalesce("company_name", F.lit("")))).rollup("company_name").agg(F.grouping("company_name").alias("_all"), *aggs)
    g = g.withColumn("company_name", F.when(F.col("_all") == 1, "Overall").otherwise(F.col("company_name"))).drop("_all")
    return g.withColumns({"precision": ratio(F.col("matched"), F.col("saved")), "recall": ratio(F.col("matched"), F.col("relevant"))})


def verdict(m: DataFrame, at_least: float = 0.8) -> DataFrame:
    return m.withColumn("verdict", F.when((F.col("precision") >= at_least) & (F.col("recall") >= at_least), "ready").when(F.col("saved") == 0, "no data").otherwise("needs work"))


def match_expected(expected: DataFrame, rows: DataFrame) -> DataFrame:
    """(expected_id, row_id, how): for each expected address the first row that is the same posting, else the only row
    with its title.

    If both addresses have a query id, that decides alone; else if both have a requisition id, that; else the page. Three
    equality joins with guards, not one join on alternatives.
    """
    e = expected.select("expected_id", F.col("title").alias("e_title"), posting_ids(F.col("job_url")).alias("e"))
    r = rows.select("row_id", F.col("title").alias("r_title"), posting_ids(F.col("job_url")).alias("r"))
    both = lambda k: F.col(f"e.{k}").isNotNull() & F.col(f"r.{k}").isNotNull()
    a = e.join(r, F.col("e.query_id") == F.col("r.query_id")).select("expected_id", "row_id")
    b = e.join(r, (F.col("e.requisition_id") == F.col("r.requisition_id")) & ~both("query_id")).select("expected_id", "row_id")
    c = e.join(r, (F.col("e.page") == F.col("r.page")) & ~both("query_id") & ~both("requisition_id")).select("expected_id", "row_id")
    by_url = a.union(b).union(c).groupBy("expected_id").agg(F.min("row_id").alias("row_id")).withColumn("how", F.lit("url"))
    titles = r.groupBy(norm_alnum(F.col("r_title")).alias("t")).agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("row_id")).where("n = 1 and t <> ''")
    left = e.join(by_url.select("expected_id"), "expected_id", "left_anti").withColumn("t", norm_alnum(F.col("e_title")))
    return by_url.union(left.join(titles, "t").select("expected_id", "row_id", F.lit("title").alias("how")))


def validate(rows: DataFrame, *, line: str, required: list[str], booleans: list[str], unique: list[str]) -> DataFrame:
    """(line, rule, field): rows that break a rule: 'blank', 'not a boolean', 'duplicate' (all but the first)."""
    found = []
    for c in required:
        found.append(rows.where(norm(F.col(c)) == "").select(line, F.lit("blank").alias("rule"), F.lit(c).alias("field")))
    for c in booleans:
        found.append(rows.where((norm(F.col(c)) != "") & parse_bool(F.col(c)).isNull()).select(line, F.lit("not a boolean").alias("rule"), F.lit(c).alias("field")))
    if unique:
        keys = [norm_alnum(F.col(c)).alias(f"_u{i}") for i, c in enumerate(unique)]
        first = rows.groupBy(*keys).agg(F.min(line).alias("_first"))
        same = F.lit(True)
        for i, c in enumerate(unique):
            same = same & (norm_alnum(F.col(c)) == F.col(f"_u{i}"))
        found.append(rows.join(first, same).where(F.col(line) > F.col("_first")).select(line, F.lit("duplicate").alias("rule"), F.lit("+".join(unique)).alias("field")))
    out = found[0] if found else rows.select(line, F.lit("").alias("rule"), F.lit("").alias("field")).limit(0)
    for f in found[1:]:
        out = out.union(f)
    return out


def recent(rows: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    """Rows of the last ``days``; those without a time that can be read stay."""
    t = F.try_to_timestamp(F.col(at)) if dict(rows.dtypes)[at] == "string" else F.col(at).cast("timestamp")
    return rows.where(t.isNull() | (t >= now - F.expr(f"INTERVAL {days} DAYS")))


def top_sample(rows: DataFrame, company: str, n: int, *order: Column) -> DataFrame:
    w = Window.partitionBy(company).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max(1, n)).drop("_n")


