import datetime as dt
from zoneinfo import ZoneInfo

import pytest

from postmill.operators.timestamps import offset_changes, posting_instants, read_instants

US = 1_000_000


def utc(*a):
    return int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp()) * US


@pytest.fixture(scope="module")
def side(spark):
    s = spark.createDataFrame([("ny", "America/New_York", "MDY"), ("be", "Europe/Berlin", "DMY"), ("no", None, None), ("odd", "Mars/Base", "DMY")], "source_name string, time_zone string, date_order string")
    a = spark.createDataFrame([("EST", -300), ("CET", 60), ("UTC", 0)], "abbrev string, utc_offset_minutes int")
    return s, a


CASES = [
    ("ny", "2024-07-01 12:00:00", utc(2024, 7, 1, 16), "zone"),
    ("ny", "2024-11-03 01:30:00", utc(2024, 11, 3, 5, 30), "ambiguous"),  # first pass
    ("ny", "2024-03-10 02:30:00", utc(2024, 3, 10, 7, 30), "nonexistent"),  # offset before the change
    ("be", "03.01.2024", utc(2024, 1, 2, 23), "zone"),
    ("be", "03/01/2024 15:25", utc(2024, 1, 3, 14, 25), "zone"),
    ("ny", "03/01/2024 15:25", utc(2024, 3, 1, 20, 25), "zone"),
    ("be", "15. September 2025 7:05", utc(2025, 9, 15, 5, 5), "zone"),
    ("be", "25 de septiembre de 2025", utc(2025, 9, 24, 22), "zone"),
    ("ny", "Sep 1, 2025 12:34 PM EST", utc(2025, 9, 1, 17, 34), "abbreviation"),
    ("ny", "2025/04/06 12:24:29 am", utc(2025, 4, 6, 4, 24, 29), "zone"),
    ("ny", "Thu, 28 Aug 2025 22:18:51 -0330", utc(2025, 8, 29, 1, 48, 51), "offset"),
    ("ny", "2024-01-30T18:17:22-06:00[America/Regina]", utc(2024, 1, 31, 0, 17, 22), "offset"),
    ("ny", "2025-09-03 16:36:03 America/Regina", utc(2025, 9, 3, 22, 36, 3), "zone"),
    ("no", "2024-01-01T00:00:00.1234569Z", utc(2024, 1, 1) + 123456, "offset"),
    ("no", "20250829T071640Z", utc(2025, 8, 29, 7, 16, 40), "offset"),
    ("no", "1704934167", 1704934167 * US, "number"),
    ("no", "1704934167207", 1704934167207000, "number"),
    ("no", "1704934167207462", 1704934167207462, "number"),
    ("no", "1704934167.5", 1704934167500000, "number"),
    ("no", "  2024-01-01t00:00:00z\n", utc(2024, 1, 1), "offset"),
]
NONE = [
    ("ny", "13/31/2024"), ("ny", "2025-02-30"), ("ny", "0000-00-00 00:00:00"), ("ny", "2024-01-01 25:00"), ("ny", "Posted 3 days ago"), ("ny", ""), ("ny", "   "), ("ny", "soon"),
    ("ny", "2024-01-01 10:00 XYZ"), ("no", "2024-01-01 10:00"), ("odd", "2024-01-01"), ("no", "03/04/2024"), ("ny", "9" * 400), ("ny", "x" * 200_000), ("ny", "2024-13-01"), (None, "2024-01-01"),
]


def test_texts(spark, side):
    rows = [(i, *c[:2]) for i, c in enumerate([*CASES, *NONE])]
    out = {r.n: r for r in read_instants(spark.createDataFrame(rows, "n int, source_name string, value string"), *side).collect()}
    assert len(out) == len(rows)
    for i, (_, text, us, basis) in enumerate(CASES):
        assert (out[i].utc_micros, out[i].basis) == (us, basis), text
    for i, (_, text) in enumerate(NONE, len(CASES)):
        assert out[i].utc_micros is None and out[i].basis is None, text


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/St_Johns", "Asia/Kolkata", "Australia/Lord_Howe"])
def test_intervals_agree_with_the_zone(zone):
    z = ZoneInfo(zone)
    changes = offset_changes(zone)
    for k, (at, off) in enumerate(changes):
        if k:
            for s, expected in ((at - 1, changes[k - 1][1]), (at, off)):
                assert dt.datetime.fromtimestamp(s, z).utcoffset().total_seconds() == expected


def test_rows_and_clashing_columns(spark, side):
    jobs = spark.createDataFrame(
        [(1, "be", "2024-01-01T00:00:00Z", None, "01.02.2024"), (1, "be", None, "2024-01-01T00:00:00Z\n", "?"), (2, None, None, None, None)],
        "id long, source_name string, date_posted string, first_seen_at string, last_seen string",
    )
    out = posting_instants(jobs.withColumn("time_zone", jobs.id).withColumn("value", jobs.id), *side)
    got = sorted((r.job_id, r.field, r.utc_micros) for r in out.collect() if r.utc_micros is not None)
    assert got == [(1, "first_seen_at", utc(2024, 1, 1)), (1, "last_seen", utc(2024, 1, 31, 23))]
    assert posting_instants(jobs.limit(0), *side).count() == 0


def test_years_beyond_the_table(spark):
    """Wall times of far years against the zone's own rule."""
    from datetime import datetime, timedelta, timezone
    from zoneinfo import ZoneInfo

    from postmill.operators.timestamps import read_instants

    rows = [(f"{y}-{m:02d}-{d:02d} {h:02d}:30:00", z) for y in (1500, 1799, 1850, 1901, 2037, 2087, 2100, 2101, 2128, 2129, 2150, 2200, 2399, 2400, 2401, 9998) for m, d in ((1, 1), (3, 9), (3, 29), (7, 1), (10, 28), (11, 4), (12, 31)) for h in (0, 12, 23) for z in ("America/Toronto", "Europe/Berlin", "Australia/Sydney", "Africa/Casablanca")]
    values = spark.createDataFrame([(i, t, z) for i, (t, z) in enumerate(rows)], "n long, value string, source_name string")
    sources = spark.createDataFrame([(z, z, "DMY") for z in sorted({r[1] for r in rows})], "source_name string, time_zone string, date_order string")
    abbrevs = spark.createDataFrame([], "abbrev string, utc_offset_minutes int")
    got = {r.n: (r.utc_micros, r.basis) for r in read_instants(values, sources, abbrevs).collect()}
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)
    for i, (t, z) in enumerate(rows):
        want = (datetime.fromisoformat(t).replace(tzinfo=ZoneInfo(z)) - epoch) // timedelta(microseconds=1)
        assert got[i][0] == want, (t, z, got[i])
    assert got[next(i for i, r in enumerate(rows) if r == ("2150-07-01 12:30:00", "America/Toronto"))][1] == "zone"
