import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postmill.operators import flatten as N


def brute(v, path="$", parent="$"):
    out = []
    if isinstance(v, dict):
        for k, x in v.items():
            out += brute(x, f"{path}.{k}", parent)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            p = f"{path}[{i}]"
            out.append((p, parent))
            out += brute(x, p, p)
    return out


values = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=3), x, max_size=4), max_leaves=25)


@settings(max_examples=200, deadline=None)
@given(values)
def test_visit_agrees_with_recursion(v):
    assert sorted((r[1], r[2]) for r in N.visit(v)) == sorted(brute(v))


@settings(max_examples=200, deadline=None)
@given(values)
def test_own_parser_agrees(v):
    assert N._parse_deep(json.dumps(v)) == v


@pytest.mark.parametrize("text", ["", " ", "{", "[1,", "[1,]", "{'a': [1]}", "[NaN]", "[1] x", '{"a" [1]}', "<html>[]</html>"])
def test_malformed(text):
    with pytest.raises(N.Malformed):
        N.parse(text)


def test_rows(spark, tmp_path):
    deep = "[" * 50_000 + "]" * 50_000
    rows = [
        (1, '{"a": [{"b": {"c": [1, {"d": 2}]}}, []], "e": [null]}'), (2, json.dumps(json.dumps({"a": [1]}))), (3, '"[1"'), (4, None), (5, ""), (6, "[]"), (7, '{"a": "[1]"}'),
        (8, '["\\ud800"]'), (9, "  [true]\n"), (9, "[true]"), (10, "[" + ",".join(["1"] * 60_000) + "]"),
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "id long, raw string, path string")
    out = N.flatten(df, "id", "raw")
    got = sorted((r.id, r.path, r.parent_path) for r in out.where("id < 10").collect())
    assert got == sorted([
        (1, "$.a[0]", "$"), (1, "$.a[0].b.c[0]", "$.a[0]"), (1, "$.a[0].b.c[1]", "$.a[0]"), (1, "$.a[1]", "$"), (1, "$.e[0]", "$"), (2, "$.a[0]", "$"), (8, "$[0]", "$"), (9, "$[0]", "$"), (9, "$[0]", "$"),
    ])
    assert out.where("id = 10").count() == 60_000
    assert len(list(N.visit(N.parse(deep), False))) == 49_999
    N.write_tables(N.flatten(spark.createDataFrame([(1, '{"x": [{"k": "v", "o": {"n": 3}}, {"k": null}]}')], "id long, raw string"), "id", "raw"), str(tmp_path / "t"))
    t = N.table(spark, str(tmp_path / "t"), "$.x[]", "k string, `o.n` int")
    assert sorted((r.path, r.k, r["o.n"]) for r in t.collect()) == [("$.x[0]", "v", 3), ("$.x[1]", None, None)]
    assert N.flatten(df.limit(0), "id", "raw").count() == 0


def test_written_tables_are_read_back(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(1, '{"x": [{"k": 1.5, "path": "p", "y": [{"z": true}, 7]}, {"k": 2}]}'), (2, '{"x": [{"k": 3, "y": []}]}'), (2, '{"x": []}')]
    N.write_tables(N.flatten(spark.createDataFrame(rows, "id long, raw string"), "id", "raw"), path)
    assert N.tags(spark, path) == ["$.x[]", "$.x[].y[]"]
    assert N.infer(spark, path, "$.x[]") == "`k` double, `path` string" and N.infer(spark, path, "$.x[].y[]") == "`z` boolean"
    x = N.table(spark, path, "$.x[]", N.infer(spark, path, "$.x[]"))
    y = N.table(spark, path, "$.x[].y[]", N.infer(spark, path, "$.x[].y[]"))
    assert sorted((r.id, r.path, r.k, r["_path"]) for r in x.collect()) == [(1, "$.x[0]", 1.5, "p"), (1, "$.x[1]", 2.0, None), (2, "$.x[0]", 3.0, None)]
    assert y.join(x, [y.id == x.id, y.parent_path == x.path]).count() == y.count() == 2
    assert N.tables(spark, str(tmp_path / "none"), "bigint", "id").count() == 0
