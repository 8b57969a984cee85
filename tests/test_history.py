import datetime as dt
import random

import pytest

from postmill.operators.history import validity, word_runs

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "snapshot_id long, job_id long, h string, seen timestamp_ntz, ingested timestamp_ntz, entity string"


def brute(rows):
    best = {}
    for sid, job, h, seen, ing, *_ in rows:
        if job is None or h is None or seen is None:
            continue
        rank = (ing is not None, ing or DAY, sid)
        if (job, seen) not in best or rank > best[job, seen][0]:
            best[job, seen] = (rank, h.lower())
    out = {}
    for (job, seen), (_, h) in sorted(best.items(), key=lambda x: x[0]):
        v = out.setdefault(job, [])
        if not v or v[-1][0] != h:
            v.append((h, seen))
    us = lambda t: int((t - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))
    return sorted((j, k + 1, us(t), us(v[k + 1][1]) if k + 1 < len(v) else 0) for j, v in out.items() for k, (_, t) in enumerate(v))


def run(spark, rows, tasks):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    out = validity(df, entity="job_id", attribute="h", seen_at="seen", ingested_at="ingested", tiebreak="snapshot_id", tasks=tasks)
    return sorted((r.job_id, r.version_no, r.valid_from_us, r.valid_to_us) for r in out.collect())


@pytest.mark.parametrize("tasks", [1, 3, 9])
def test_against_brute_force(spark, tasks):
    rng = random.Random(tasks)
    rows = []
    for i in range(1500):
        job = 7 if rng.random() < 0.5 else rng.randint(1, 40)  # one entity has half of all rows
        h = rng.choice(["a", "A", "b", None]) if job != 7 or i % 3 else "a"
        seen = None if rng.random() < 0.02 else DAY + dt.timedelta(minutes=rng.randint(0, 900))
        rows.append((i, job if rng.random() > 0.01 else None, h, seen, None if rng.random() < 0.1 else DAY + dt.timedelta(days=rng.randint(0, 3))))
    assert run(spark, rows, tasks) == brute(rows)


def test_one_entity_one_value_over_many_tasks(spark):
    rows = [(i, 1, "x" if i < 900 else "y", DAY + dt.timedelta(minutes=i), DAY) for i in range(1000)]
    assert run(spark, rows, 8) == brute(rows)
    rows = [(i, 1, str(i), DAY + dt.timedelta(minutes=i), DAY) for i in range(500)]
    assert run(spark, rows, 8) == brute(rows)


def test_empty_and_repeated(spark):
    assert run(spark, [], 2) == []
    row = (1, 1, "a", DAY, DAY)
    assert run(spark, [row, row, row], 2) == brute([row])


def test_word_runs():
    rng = random.Random(0)
    for n in (1, 63, 64, 65, 200):
        h = [rng.choice("ab") for _ in range(n)]
        runs = word_runs(h)
        assert [x for a, b, v in runs for x in [v] * (b - a + 1)] == h
        assert all(p[2] != q[2] for p, q in zip(runs, runs[1:]))
