import random
import re

from postmill.llm import dress

F3 = ["company_name", "title", "location"]
SCHEMA = "id long, company_name string, title string, location string, kept long, copies string"


def canon(t):
    return " ".join(sorted(re.findall(r"[^\W_]+", (t or "").lower())))


def test_against_brute_force(spark):
    rng = random.Random(2)
    forms = ["Ünder Ground", "ground, ÜNDER", "a b", "b  A!", "", None, "1 a", "x" * 100_000, "日本 語", "\t", "a_b"]
    rows = [(i, *[rng.choice(forms) if rng.random() < 0.6 else "Hot" for _ in range(3)], 0, "") for i in range(1, 700)]
    df = spark.createDataFrame(rows, SCHEMA)
    sets = {}
    for r in rows:
        sets.setdefault(tuple(canon(x) for x in r[1:4]), []).append(r[0])
    want = sorted((min(v), i) for v in sets.values() for i in v if i != min(v))
    assert sorted((r.kept, r.id) for r in dress.copies(df, "id", F3).collect()) == want
    assert sorted((r.kept, r.copies) for r in dress.collapse(df, "id", F3).collect()) == sorted((min(v), len(v)) for v in sets.values())


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert dress.copies(df, "id", F3).count() == dress.collapse(df, "id", F3).count() == 0
    one = spark.createDataFrame([(1, None, None, None, 1, "")], SCHEMA)
    assert dress.copies(one, "id", F3).count() == 0 and dress.collapse(one, "id", F3).first().copies == 1
