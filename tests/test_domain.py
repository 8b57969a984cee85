"""Operators on small inputs of our own: what the queries over the tables don't reach."""

import json
import random
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pytest
from pyspark.sql import functions as F

from postmill.catalog import Catalog
from postmill.functions import exact, urls
from postmill.operators import audit as A
from postmill.operators import classify as C
from postmill.operators import crawl as W
from postmill.operators import extract as E
from postmill.operators import listing as L
from postmill.operators import merge as M
from postmill.operators import onboarding as B
from postmill.operators.scoring import Phrases, score
from postmill.runtime import shared_dir
from postmill.sources import boards, feeds, files
from postmill.workflow import daily_run

JOB = "seq long, company_name string, external_job_id string, job_url string, title string, location string, manual_found string, manual_relevant string"


def test_link_replays_in_order(spark):
    rng = random.Random(3)
    side = lambda n: [(i, rng.choice(["A", "a ", "B"]), rng.choice([None, "1", "2", "3"]), rng.choice([None, "http://h/x", "http://h/y/", "HTTP://H/y"]), rng.choice(["t", "u"]), rng.choice([None, "p"]), None, None) for i in range(n)]
    s, m = side(60), side(50)

    def url(u):
        if not u:
            return None
        p = urlsplit(u)
        return urlunsplit((p.scheme.lower(), p.netloc.lower(), p.path.rstrip("/") or "/", urlencode(sorted(parse_qsl(p.query))), ""))

    low = lambda x: (x or "").strip().lower()
    want, taken = [], set()
    for r in s:
        for t in range(3):
            hit = next((q for q in m if q[0] not in taken and low(q[1]) == low(r[1]) and ((t == 0 and r[2] and q[2] == r[2]) or (t == 1 and url(r[3]) and url(q[3]) == url(r[3])) or (t == 2 and (q[4], q[5]) == (r[4], r[5])))), None)
            if hit:
                taken.add(hit[0])
                want.append((r[0], hit[0], A.TIERS[t][0]))
                break
    got = A.link(spark.createDataFrame(s, JOB), spark.createDataFrame(m, JOB))
    assert sorted((r.system_seq, r.manual_seq, r.tier) for r in got.collect()) == sorted(want)


def test_audit_metrics(spark):
    s = spark.createDataFrame([(1, "A", "1", None, "t", "p", None, None), (2, "A", None, None, "gone", "p", "no", None), (3, "A", None, None, "u", "p", None, "no"), (4, "B", None, None, "?", "p", None, None)], JOB)
    m = spark.createDataFrame([(1, "a", "1", None, "t", "p", None, "yes"), (2, "A", "9", None, "missing", "p", None, "yes")], JOB)
    r = {x.company_name: x for x in A.verdict(A.metrics(A.verdicts(s, m))).collect()}
    o = r["Overall"]
    assert (o.saved, o.relevant, o.matched, o.false_positive, o.missing, o.unclear) == (4, 2, 1, 2, 1, 1)
    assert (o.precision, o.recall) == (0.25, 0.5) and r["B"].recall == 0.0


def test_components(spark):
    edges = [(1, "a"), (2, "a"), (2, "b"), (9, "b"), (5, "c"), (6, "c"), (7, "d")]
    got = {r.node: r.component for r in A.components(spark.createDataFrame(edges, "node long, key string")).collect()}
    assert got == {1: 1, 2: 1, 9: 1, 5: 5, 6: 5, 7: 7}


def test_scores(spark):
    p = Phrases(target_roles=["cloud engineer"], skills={"linux": ["linux"], "support": ["support"]}, locations=["town"], support=["on call"], adjacent_roles=["consultant"], conditional_roles=["coordinator"], adjacent_context=["api"], negatives=["sales"], support_context=["software"])
    rows = [
        (1, "Cloud Engineer", "Town", "linux <b>on call</b>"), (2, "Chef", "Town", None), (3, "Support", None, "support"), (4, "Consultant", None, "sales sales"), (5, "Coordinator", None, "an api"),
        (6, "Coordinator", None, "nothing"), (7, None, None, None), (8, "x" * 100_000, "", "linux"),
    ]
    r = {x.id: x for x in score(spark.createDataFrame(rows, "id long, title string, location string, description string"), p).collect()}
    assert r[1].match_score == 45 + 4 + 4 + 8 and r[1].relevance_tier == "core_target_fit" and r[1].is_relevant
    assert r[2].match_score == 4 and r[2].relevance_tier == "not_relevant" and not r[2].is_relevant
    assert r[3].match_reasons == []  # a gated skill alone
    assert r[4].match_score == 9 and r[4].risk_flags == ["negative signal: sales"] and r[4].relevance_tier.startswith("adjacent")
    assert r[5].match_score == 18 and r[5].match_reasons == ["adjacent customer-facing technical fit: coordinator (technical context)"]
    assert r[6].match_score == r[7].match_score == 0 and r[8].match_score == 4
    assert all(0 <= x.match_score <= 100 for x in r.values())


def test_merge_is_idempotent_and_keeps_times(spark):
    cols = "k string, v string, first_seen_at string, last_seen_at string, last_updated_at string"
    old = spark.createDataFrame([("a", "1", "1", "1", "1"), ("b", None, "1", "1", "1"), ("c", "3", "1", "1", "1")], cols)
    new = spark.createDataFrame([("a", "1", "2", "2", "2"), ("b", "2", "2", "2", "2"), ("d", "4", "2", "2", "2")], cols)
    once = M.merge(old, new, key="k", fields=["v"])
    assert sorted(tuple(r) for r in once.collect()) == [("a", "1", "1", "2", "1", "unchanged"), ("b", "2", "1", "2", "2", "updated"), ("c", "3", "1", "1", "1", "kept"), ("d", "4", "2", "2", "2", "inserted")]
    again = M.merge(once.drop("action"), new, key="k", fields=["v"])
    assert {r.action for r in again.collect()} == {"unchanged", "kept"}
    ids = M.assign_ids(spark.range(1000).withColumnRenamed("id", "n"), 10, F.desc("n")).collect()
    assert sorted(r.id for r in ids) == list(range(11, 1011)) and all(r.id == 10 + 1000 - r.n for r in ids)


@pytest.mark.parametrize(
    "url, hint, category, system, mode",
    [
        ("https://boards.greenhouse.io/x", None, None, "greenhouse", "api_allowed"), ("https://x.wd3.myworkdayjobs.com/a", "", None, "workday", "human_in_loop"), ("https://notlinkedin.com/a", None, None, "restricted_board", "manual_only"),
        ("https://x.example", "Smart Recruiters", None, "smartrecruiters", "api_allowed"), ("https://x.example", None, "powered by lever", "lever", "api_allowed"), ("https://x.example", "ultipro", None, "ultipro", "human_in_loop"),
        (None, None, None, None, "needs_url"), ("ftp://x", None, None, None, "needs_url"), ("https://mygreenhouse.io.example", None, None, None, "browser_allowed"),
    ],
)
def test_classification(spark, url, hint, category, system, mode):
    df = spark.createDataFrame([(url, hint, category)], "u string, h string, c string").withColumn("s", C.detect_system(F.col("u"), F.col("h"), F.col("c")))
    r = df.withColumn("m", C.select_mode(F.col("u"), F.col("s"), F.lit(None).cast("string"))).first()
    assert (r.s, r.m) == (system, mode)


def test_listing(spark):
    rows = [
        ("Data Engineer", "https://h.example/jobs/1", "", True), ("Data Engineer", None, "", False), ("Our culture", "https://h.example/jobs/1", "", False), ("Remote", "https://h.example/jobs/1", "", False), ("Cloud (12)", "https://h.example/jobs/1", "", False),
        ("Data Engineer", "javascript:x", "", False), ("Data Engineer", "https://h.example/careers", "", False), ("Data Engineer", "https://h.example/x", "full-time", True), ("Gardener", "https://h.example/x", "full-time", False), (None, "https://h.example/jobs/1", "", False),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, u string, d string, ok boolean")
    n = F.lit(None).cast("string")
    got = df.withColumn("k", L.probable_posting(F.col("t"), F.col("u"), F.col("d"), n, n, n, n)).collect()
    assert all(r.k is r.ok for r in got), [r for r in got if r.k is not r.ok]


PAGE = """<html><nav><a href="/jobs/9">Nav Engineer</a></nav><ul><li><a href="/jobs/1">Data Engineer</a> <span class="location">Town</span></li></ul>
<table><tr><td><a href="/jobs/2">Cloud Analyst</a></td><td>City</td></tr></table><div class="job-card"><h3>Lead Planner</h3><a href="/jobs/3?x=1">more</a></div>
<a href="mailto:x@y">Mail Engineer</a><a href="#top">Top Engineer</a><script type="application/ld+json">{"@graph": [{"@type": ["JobPosting"], "title": "Platform Engineer", "url": "/jobs/4",
"jobLocation": [{"address": {"addressLocality": "A", "addressCountry": "B"}}, "C"]}]}</script><script type="application/ld+json">{broken</script></html>"""


def test_pages(spark):
    df = spark.createDataFrame([(1, "https://h.example/careers/", PAGE), (2, None, None), (3, "https://h.example", ""), (4, "https://h.example", "<a href='/jobs/5'>Ops Engineer<p>no jobs found"), (5, "https://h.example", "<div>" * 3000 + "x")], "id long, url string, html string")
    r = E.records(df, key="id", url="url", html="html").where("id = 1").collect()
    assert [(x.strategy, x.title, x.href) for x in r if x.strategy != "link"] == [
        ("json_ld", "Platform Engineer", "https://h.example/jobs/4"), ("table_row", "Cloud Analyst", "https://h.example/jobs/2"), ("card", "Lead Planner", "https://h.example/jobs/3?x=1"), ("list_item", "Data Engineer", "https://h.example/jobs/1"),
    ]
    assert r[0].location == "A, B | C" and not any("Nav" in (x.title or "") for x in r)
    p = E.postings(df, key="id", url="url", html="html").collect()
    assert {x.href.rsplit("/", 1)[1] for x in p} == {"1", "2", "3?x=1", "4"} and {x.id for x in p} == {1}
    assert {x.id: x.text for x in E.page_text(df, key="id", html="html").collect()}[2] == ""
    exact.register(spark)
    df.createOrReplaceTempView("landed_pages")
    assert spark.sql("select t.title from landed_pages, lateral extract_postings(html, url) t where id = 1 and t.strategy = 'card'").first().title == "Lead Planner"


LANDED = [
    ("Acme", "g", "greenhouse", "acme", json.dumps({"jobs": [{"id": 1, "title": " Cloud  Engineer ", "absolute_url": "https://h.example/jobs/1", "location": {"name": "Town"}, "content": "&lt;p&gt;linux&lt;/p&gt;", "updated_at": "2024-01-01"}]})),
    ("Acme", "l", "lever", "acme", json.dumps([{"id": "x", "text": "Cloud Engineer", "hostedUrl": "https://l.example/x", "categories": {"location": "Town"}, "descriptionPlain": "plain", "lists": [{"text": "Do", "content": "<li>a</li><li>b</li>"}], "createdAt": 1704351278839}])),
    ("Acme", "a", "ashby", "acme", json.dumps({"jobPostings": [{"jobPostingId": "p", "title": "Cook", "jobUrl": "https://a.example/p", "location": ["Town", {"name": "City"}], "secondaryLocations": [{"city": "X", "country": "Y"}]}]})),
    ("Acme", "bad", "greenhouse", "acme", "<html>503</html>"), ("Acme", "none", "lever", "acme", "[]"), ("Acme", "null", "lever", "acme", None),
]


def test_feeds_workflow_and_source(spark, tmp_path):
    cols = "company_name string, source_name string, ats_type string, board_slug string, payload string"
    with open(tmp_path / "x.jsonl", "w") as f:
        for r in LANDED:
            f.write(json.dumps(dict(zip([c.split()[0] for c in cols.split(", ")], r))) + "\n")
    boards.register(spark)
    landed = spark.read.format("postings").option("path", str(tmp_path)).load()
    got = {r.source_name: r for r in feeds.read_boards(landed).collect()}
    assert set(got) == {"g", "l", "a"}
    assert (got["g"].external_job_id, got["g"].title, got["g"].description) == ("1", "Cloud  Engineer", "linux")
    assert got["l"].description == "plain\n\nDo\na b" and got["l"].date_posted == "2024-01-04T06:54:38Z"
    assert got["a"].location == "Town | City | X, Y" and got["a"].external_job_id == "p"
    p = Phrases(target_roles=["cloud engineer"], skills={"linux": ["linux"]})
    kept = M.Snapshots(spark, f"{shared_dir(spark)}/daily-{random.random()}")
    one = daily_run(spark, landed, p, kept, "2024-01-02 00:00:00")
    assert {r.action for r in one.snapshot.collect()} == {"inserted"} and one.version == 1
    assert {r.source_name: r.status for r in one.outcomes.collect()} == {"g": "success", "l": "success", "a": "success", "bad": "parse_error", "none": "no_jobs_found", "null": "parse_error"}
    two = daily_run(spark, landed, p, kept, "2024-01-03 00:00:00")
    assert {r.action for r in two.snapshot.collect()} == {"unchanged"} and two.snapshot.count() == one.snapshot.count() == 2


def test_exact_address(spark):
    u = ["https://H.example/a/?b=2&a=%20x*~&c=", "plain", "", None, "HTTP://x.example", "https://h.example/ü?q=ü#f", "http://[bad"]
    got = spark.createDataFrame([(x,) for x in u], "u string").select(exact.address("u").alias("e"), urls.identity_url(F.col("u")).alias("n")).collect()
    assert got[0].e == "https://h.example/a?a=+x%2A~&b=2&c=" and got[1].e == got[1].n == "plain" and got[2].e is got[3].e is got[2].n is None and got[4].e == got[4].n == "http://x.example/"
    j = spark.createDataFrame([("T é", None, "d", None, None, None, "https://h.example/")], "title string, location string, description string, external_job_id string, ats_type string, board_slug string, job_url string")
    assert len(j.select(exact.content_hash_exact().alias("h")).first().h) == 64


def test_walk(spark):
    e = [("https://a.example/", i, f"https://a.example/p{i}") for i in range(12)] + [("https://a.example/p0", 0, "https://careers.a.example/x"), ("https://a.example/p0", 1, "https://jobs.lever.co/a"), ("https://a.example/p1", 0, "https://a.example/"), ("https://careers.a.example/x", 0, "https://a.example/deep")]
    edges = spark.createDataFrame(e, "url string, position long, link string")
    seen = W.walk(spark.createDataFrame([("s", "https://A.example"), ("none", None)], "site string, url string"), edges, max_depth=2, max_pages=8)
    got = seen.orderBy("arrival").collect()
    assert [r.url for r in got] == ["https://a.example/"] + [f"https://a.example/p{i}" for i in range(7)]
    f = {r.url: (r.kind, r.system) for r in W.findings(seen, edges).collect()}
    assert f == {"https://careers.a.example/x": ("careers_page", None), "https://jobs.lever.co/a": ("board", "lever")}


def test_aliases(spark):
    i = spark.createDataFrame([("ACME",), ("Bolt & Co",), ("Dup",), ("Zed",), ("Left",)], "n string")
    e = spark.createDataFrame([("Acme (AC)",), ("Bolt and Co",), ("Dup (X)",), ("Dup (Y)",), ("Left/Right",)], "m string")
    got = {r.input_name: (r.entry_name, r.outcome) for r in B.alias_join(i, e, input_name="n", entry_name="m").collect()}
    assert got == {"ACME": ("Acme (AC)", "alias"), "Bolt & Co": ("Bolt and Co", "exact"), "Dup": (None, "ambiguous"), "Zed": (None, "none"), "Left": ("Left/Right", "alias")}


def test_files(spark, tmp_path):
    (tmp_path / "w.yaml").write_text("companies:\n- name: Acme\n  keywords: [a, 1]\n  extra: x\n- nothing\nother: 1\n")
    (tmp_path / "e.yaml").write_text("")
    (tmp_path / "in.txt").write_text("# remark\nAcme | https://a.example |\n| x\n")
    (tmp_path / "in.csv").write_text('Company,Website\n"Acme ""Two""","https://a.example\nx"\n,y\n')
    w = files.watchlist(spark, str(tmp_path / "w.yaml")).collect()
    assert len(w) == 1 and w[0].name == "Acme" and w[0].keywords == ["a", "1"] and files.watchlist(spark, str(tmp_path / "e.yaml")).count() == 0
    assert [tuple(r) for r in files.company_inputs(spark, str(tmp_path / "in.txt")).collect()] == [("Acme", "https://a.example", None)]
    assert [r.company_name for r in files.company_inputs(spark, str(tmp_path / "in.csv")).collect()] == ['Acme "Two"']
    assert files.at_least_one("x", 3) == 3 and files.at_least_one(0, 3) == 1
    files.write_csv(spark.createDataFrame([(1, ["a", "b"])], "id int, l array<string>"), str(tmp_path / "out"))
    assert files.read_text_table(spark, str(tmp_path / "out")).first().l == '["a","b"]'
    assert "and 1 more" in files.markdown("t", {"s": spark.range(3)}, limit=2)


def test_catalog(spark, sf):
    c = Catalog(spark, sf)
    c.register("v_")
    assert spark.sql("select count(*) n from v_jobs").first().n == c.jobs().count()
    assert c.source_status().count() == c.table("sources").count()
    assert c.companies("api_allowed", limit=3).count() <= 3 and c.overview().count() == 1 and c.issues(None).count() > 0 and c.issue_history(5).count() == 5
