"""Every query with SQL beside it gives the same rows in DuckDB; every other one runs."""

from collections import Counter

import duckdb
import pytest

from postmill.plans import all_registries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings companies sources jobs job_snapshots source_observations interventions "
    "places tz_abbrevs mix_targets split_limits"
).split()
QUERIES = {n: q for r in all_registries() for n, q in r.queries.items()}
SQL = {n: q for r in all_registries() for n, q in r.sql.items()}


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def value(x):
    return round(x, 6) if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    assert len(set(df.columns)) == len(df.columns)
    rows = [tuple(r) for r in df.collect()]
    if name not in SQL:
        return
    got = duck.execute(SQL[name])
    cols = [d[0] for d in got.description]
    assert sorted(cols) == sorted(df.columns)
    expected = Counter(tuple(value(r[cols.index(c)]) for c in sorted(cols)) for r in got.fetchall())
    found = Counter(tuple(value(r[df.columns.index(c)]) for c in sorted(cols)) for r in rows)
    assert found == expected
