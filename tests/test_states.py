from datetime import datetime

from pyspark.sql import functions as F

from postmill.operators import states as T


def test_upsert(spark):
    old = spark.createDataFrame([("a", "x", "u", 1), ("b", "x", "u", None), ("c", "x", None, 5), (None, "n", "n", 1)], "k string, mode string, url string, n int")
    new = spark.createDataFrame([("a", None, " ", 2), ("b", "x", None, None), ("d", "y", "w", 3), (None, "m", "m", 1)], "k string, mode string, url string, n int")
    got = [(str(r.k), r.mode, r.url, r.n, r.action) for r in T.upsert(old, new, key="k", overwrite=["mode"], preserve=["url"], add=["n"]).collect()]
    by = {g[0]: g[1:] for g in got if g[0] != "None"}
    assert by["a"] == (None, "u", 3, "updated") and by["c"] == ("x", None, 5, "kept") and by["d"] == ("y", "w", 3, "inserted")
    assert sum(g[0] == "None" for g in got) == 2
    assert T.upsert(old.limit(0), new.limit(0), key="k", overwrite=["mode"]).count() == 0


def test_episodes(spark):
    d = lambda n: datetime(2024, 1, n)
    rows = [(1, "a", d(1), None, 2), (2, "a", d(2), d(4), None), (3, "a", d(3), None, 0), (4, "a", d(5), None, 1), (5, "a", d(6), None, 1), (6, "a", d(9), d(10), 1), (7, "a", d(10), None, 1), (8, "b", d(1), None, 1)]
    e = T.episodes(spark.createDataFrame(rows, "id int, k string, at timestamp, done timestamp, n int"), keys=["k"], order=["at", "id"], opened="at", closed="done", count="n")
    got = sorted((r.k, r.episode, r.first_at, r.last_at, r.occurrences) for r in e.collect())
    assert got == [("a", 1, d(1), d(3), 4), ("a", 2, d(5), d(9), 3), ("a", 3, d(10), d(10), 1), ("b", 1, d(1), d(1), 1)]


def test_fold_and_transition(spark):
    rows = [("s", 1, "u1", 2), ("s", 2, " ", 3), ("s", 3, None, None), ("t", 1, None, None)]
    f = T.fold(spark.createDataFrame(rows, "k string, at int, url string, n int"), key="k", order=["at"], last_said=["url"], sums=["n"], at="at")
    assert sorted((r.k, r.url, r.n, r.first_at, r.last_at, r.n_rows) for r in f.collect()) == [("s", "u1", 5, 1, 3, 3), ("t", None, 0, 1, 1, 1)]
    t = T.transition(f.select("k", "url"), when=F.col("url") == "u1", changes={"url": F.lit("z")})
    assert sorted((r.k, r.url, r.changed) for r in t.collect()) == [("s", "z", True), ("t", None, False)]


def test_migrate_and_lookups(spark):
    r = spark.createDataFrame([(1, "x"), (2, None)], "id int, name string")
    m = T.migrate(r, "name string, label string, n bigint", {"label": F.coalesce("name", F.lit("-"))})
    assert sorted((x.id, x.name, x.label, x.n) for x in m.collect()) == [(1, "x", "x", None), (2, None, "-", None)]
    assert T.missing_columns(r, ["id", "zone"]) == ["zone"]
    assert [x.id for x in T.orphans(r, spark.createDataFrame([("y",)], "name string"), key="name", parent_key="name").collect()] == [1]
    a, b = spark.createDataFrame([("x", " "), ("x", None)], "k string, v string"), spark.createDataFrame([("x", "2"), ("x", "1")], "k string, v string")
    got = T.by_precedence(r, "name", ("a", a, "k", "v"), ("b", b, "k", "v")).collect()
    assert sorted((x.id, x.value, x.origin) for x in got) == [(1, "1", "b"), (2, None, "none")]
    assert T.listed(" a, ,b ,") == ["a", "b"] and T.listed(None) == []


def test_place_in(spark):
    rows = [("We hire in  Toronto, ON, Canada now",), ("remote anywhere",), ("remote " + "x" * 300,), ("nothing",), (None,), ("São Paulo, SP",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(T.place_in(F.col("t"), ["remote"])).collect()]
    assert got == ["Toronto, ON", "remote anywhere", None, None, None, "São Paulo, SP"]


def test_two_writers_of_one_version(spark, tmp_path):
    import pytest

    from postmill.operators.merge import Snapshots

    a, b = Snapshots(spark, str(tmp_path / "s")), Snapshots(spark, str(tmp_path / "s"))
    assert (a.version(), a.read()) == (0, None) and a.commit(spark.range(3)) == 1 and a.commit(spark.range(5)) == 2
    b.version = lambda: 1  # began before the last commit
    with pytest.raises(RuntimeError):
        b.commit(spark.range(1))
    assert a.version() == 2 and a.read().count() == 5
