import random

import pytest

from postmill.llm import boilerplate as B

WORDS = "alpha bravo carbon delta ember falcon garnet harbor indigo jasmine kettle lumen marble nickel orchid pepper quartz russet saffron timber".split()


def corpus(seed=3):
    """Hosts with and without a template; which lines are page wording is known."""
    rng = random.Random(seed)
    rows, want, titles = [], set(), set()
    n = 0
    title = lambda: f"{rng.choice(['Senior', 'Junior', 'Lead'])} {rng.choice(WORDS).title()} {rng.choice(['Engineer', 'Planner', 'Analyst'])}, {rng.choice(WORDS).title()} {rng.choice(WORDS).title()}"
    heads = ["About the role", "Requirements", "Benefits"]
    foot = ["Privacy notice | Terms of use", "Subscribe to our newsletter", "Follow {c} on our channels", "<footer>Powered by Portal 4.2</footer>", "© 2024 {c}. All rights reserved."]
    for h in range(14):
        company, themed = f"Firm{h} {WORDS[h]} Ltd.", h % 3 != 0
        nav = rng.sample(["Home", "News", "Locations", "Press", "Contact", "Events"], 4)
        own = rng.sample(foot, 3)
        for _ in range(60):
            n += 1
            lines: list[tuple[str, bool]] = []
            if themed and rng.random() < 0.9:
                if h % 2:
                    lines += [(x, True) for x in nav]
                else:
                    lines.append((" / ".join(nav), True))
                lines.append(("Cookies help us remember your searches.", True))
            body = [("", False), (rng.choice(heads), False), (f"We need someone to {rng.choice(WORDS)} the {rng.choice(WORDS)} {rng.choice(WORDS)} by {rng.choice(WORDS)}.", False), (f"* At least {rng.randint(1, 9)} years of {rng.choice(WORDS)} {rng.choice(WORDS)} are expected.", False), (rng.choice(["Excel", "Welding", "First aid"]), False)]
            if lines and rng.random() < 0.3:
                body.insert(rng.randint(0, len(body)), ("Live chat is offline", True))
            lines = lines + body if themed else body
            if themed and lines[0][1]:
                if rng.random() < 0.7:
                    lines.append(("Recently viewed", True))
                    lines += [(title(), True) for _ in range(rng.randint(1, 3))]
                lines += [(x.replace("{c}", company), True) for x in own]
            t = title()
            if rng.random() < 0.12:
                t = rng.choice([f"Back to results {t}", f"{t} - Apply Today", f"{t} | Jobs at {company}"])
                titles.add(n)
            rows.append((n, f"https://h{h}.example", company, "en", t, "\n".join(x for x, _ in lines), 0))
            want |= {(n, i) for i, (x, bad) in enumerate(lines, 1) if bad and x.strip()}
    return rows, want, titles


SCHEMA = "id long, host string, company string, lang string, title string, description string, line_no int"


@pytest.fixture(scope="module")
def found(spark):
    rows, want, titles = corpus()
    extra = [(9001, None, None, None, None, None, 0), (9002, "https://h1.example", "x", "en", "", "", 0), (9003, "https://h1.example", "", None, None, "word " * 60_000, 0), (9003, "https://h1.example", "", None, None, "\n\n \n", 0)]
    df = spark.createDataFrame(rows + extra, SCHEMA)
    lines = B.page_lines(df, key="id", text="description", host="host", company="company", lang="lang").cache()
    t = B.title_wording(df, lines.where("why = 'slot'").select("loose"), key="id", title="title", company="company")
    return lines.collect(), {r.id for r in t.collect()}, want, titles


def test_lines(found):
    got = {(r.id, r.line_no) for r in found[0]}
    want = found[2]
    hit = len(got & want)
    assert hit / len(want) > 0.97 and hit / len(got) > 0.99, (len(want - got), len(got - want))
    assert not {r.id for r in found[0]} & {9001, 9002, 9003}


def test_titles(found):
    assert found[1] == found[3]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    lines = B.page_lines(df, key="id", text="description", host="host", company="company", lang="lang")
    assert lines.count() == 0
    assert B.title_wording(df, lines.select("loose"), key="id", title="title", company="company").count() == 0


def test_codes_by_join_are_the_same(spark, monkeypatch):
    rows, _, _ = corpus(4)
    df = spark.createDataFrame(rows[:80], SCHEMA)
    p = B.pages(df, key="id", text="description", host="host", company="company", lang="lang").cache()
    from pyspark.sql import functions as F

    codes = p.select(F.explode("nodes").alias("node")).where("node <> 0").distinct().withColumn("code", (F.pmod("node", F.lit(3)) + 1).cast("tinyint")).cache()
    a = {r.id: tuple(r.codes) for r in B.with_codes(p.select("id", "nodes"), codes).collect()}
    monkeypatch.setattr(B, "IN_MEMORY", 1)
    b = {r.id: tuple(r.codes) for r in B.with_codes(p.select("id", "nodes"), codes).collect()}
    assert a == b and len(a) == 80


def test_lines_by_join_are_the_same(spark, monkeypatch):
    rows, _, _ = corpus(5)
    rows = rows + rows[:5] + [(rows[0][0], *r[1:]) for r in rows[60:65]]  # equal rows, and other pages under one id
    df = spark.createDataFrame(rows, SCHEMA)
    lines = lambda: sorted(tuple(map(str, r)) for r in B.page_lines(df, key="id", text="description", host="host", company="company", lang="lang").collect())
    a = lines()
    monkeypatch.setattr(B, "IN_MEMORY", 1)
    assert lines() == a and len(a) > len(set(a))
