"""Mixed timestamp texts to one UTC instant.

Local times are joined as of their zone's offset intervals: two intervals that hold the wall time mean it is
ambiguous, none means it never was, one gives the offset. The interval table is exploded by zone and year, so the
join is an equality on two short keys against a table of fixed size; the text work is native expressions.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.timetext import days_from_civil, days_in_month, month_number, parts, squeeze
from postmill.runtime import broadcast_if_small

#: Years the table of offsets holds. Before, no zone has changed yet; the last 28 hold each kind of year (by its first
#: weekday and length), and stand for all later years of their kind, since zones follow yearly rules by then.
FIRST_YEAR, LAST_YEAR = 1800, 2128
EXACT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z\z"
_IANA = r"([A-Za-z]+/[A-Za-z0-9_+\-]+(?:/[A-Za-z0-9_+\-]+)?)"
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


@lru_cache(maxsize=None)
def offset_changes(zone: str) -> tuple[tuple[int, int], ...]:
    """(UTC second from which it holds, offset in seconds) of one IANA zone from FIRST_YEAR - 1 to LAST_YEAR + 1."""
    z = ZoneInfo(zone)

    def off(s: int) -> int:
        return int((_EPOCH + timedelta(seconds=s)).astimezone(z).utcoffset().total_seconds())

    lo = int((datetime(FIRST_YEAR - 1, 1, 1, tzinfo=timezone.utc) - _EPOCH).total_seconds())
    hi = int((datetime(LAST_YEAR + 1, 12, 31, tzinfo=timezone.utc) - _EPOCH).total_seconds())
    out, at, now, step = [(lo, off(lo))], lo, off(lo), 20 * 86400
    while at < hi:
        nxt = min(at + step, hi)
        o = off(nxt)
        if o != now:
            a, b = at, nxt
            while b - a > 1:
                mid = (a + b) // 2
                if off(mid) == now:
                    a = mid
                else:
                    b = mid
            now = off(b)
            out.append((b, now))
            at = b
        else:
            at = nxt
    return tuple(out)


def _kind_of_year(y: int) -> int:
    return date(y, 1, 1).weekday() * 2 + (y % 4 == 0 and (y % 100 != 0 or y % 400 == 0))


def table_year(y: Column) -> tuple[Column, Column]:
    """(year of the table whose offsets hold in ``y``, days from that year to ``y``)."""
    jan1 = days_from_civil(y, F.lit(1), F.lit(1))
    weekday = F.pmod(jan1 + 3, F.lit(7))  # 1970-01-01 was a Thursday; 0 is Monday
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    kind = (weekday * 2 + leap.cast("int")).cast("int")
    like = {_kind_of_year(x): x for x in range(LAST_YEAR - 27, LAST_YEAR + 1)}
    late = F.get(F.array(*[F.lit(like[k]) for k in range(14)]), kind)
    days = F.get(F.array(*[F.lit((date(like[k], 1, 1) - date(1970, 1, 1)).days) for k in range(14)]), kind)
    return F.when(y > LAST_YEAR, late).otherwise(F.greatest(y, F.lit(FIRST_YEAR))).cast("int"), F.when(y > LAST_YEAR, jan1 - days).otherwise(F.lit(0))


def zone_intervals(spark: SparkSession, zones: list[str]) -> DataFrame:
    """zone, year -> the offset intervals that can hold a wall time of that year (with two days' halo).

    At most 600 zones times 329 years; a few thousand rows for the zones in use.
    """
    rows, us = [], 1_000_000
    for zone in zones:
        if zone not in available_timezones():
            continue
        ch = offset_changes(zone)
        spans = []
        for k, (start, off) in enumerate(ch):
            end = ch[k + 1][0] if k + 1 < len(ch) else 2**40
            begin = start if k else -(2**40)
            spans.append((begin + off, end + off, off))
        first = 0
        for year in range(FIRST_YEAR, LAST_YEAR + 1):
            a = int((datetime(year, 1, 1, tzinfo=timezone.utc) - _EPOCH).total_seconds()) - 2 * 86400
            b = int((datetime(year + 1, 1, 1, tzinfo=timezone.utc) - _EPOCH).total_seconds()) + 2 * 86400
            while first < len(spans) - 1 and spans[first][1] <= a:
                first += 1
            held = []
            for s in spans[first:]:
                if s[0] >= b:
                    break
                held.append((s[0] * us, s[1] * us, s[2] * us))
            rows.append((zone, year, held))
    schema = "zone string, zone_year int, spans array<struct<from_us:bigint,to_us:bigint,off_us:bigint>>"
    return spark.createDataFrame(rows, schema)


def read_instants(values: DataFrame, sources: DataFrame, abbrevs: DataFrame, *, source_key: str = "source_name", text: str = "value") -> DataFrame:
    """Add ``utc_micros``, ``basis`` and ``zone_used`` to ``values(…, source_key, text)``.

    ``basis`` is 'number', 'offset', 'abbreviation', 'zone', 'ambiguous' (first pass taken) or 'nonexistent' (offset
    before the change taken). NULL, blank, relative or impossible texts, unknown abbreviations and wall times without
    a known zone get NULL in all three. Rows are kept one to one; other columns pass unchanged (columns of the
    operator start with ``_ts_`` inside, so a column named as a source column does not clash). ``sources`` needs
    ``source_name, time_zone, date_order`` and one row per name; ``abbrevs`` ``abbrev, utc_offset_minutes``.
    """
    spark = values.sparkSession
    src = sources.select(F.col("source_name").alias("_ts_key"), F.col("time_zone").alias("_ts_zone"), F.col("date_order").alias("_ts_order")).dropDuplicates(["_ts_key"])
    abb = abbrevs.select(F.upper("abbrev").alias("_ts_abb"), F.col("utc_offset_minutes").cast("long").alias("_ts_abb_min")).dropDuplicates(["_ts_abb"])
    # zones in use: bounded by the list of IANA names, whatever the data
    iana = sorted(available_timezones())
    named = (
        values.select(F.regexp_extract(F.col(text), _IANA, 1).alias("z"))
        .union(sources.select("time_zone"))
        .where(F.col("z").isin(iana))
        .distinct()
    )
    zones = [r[0] for r in named.collect()]
    table = zone_intervals(spark, zones).select(F.col("zone").alias("_ts_z"), F.col("zone_year").alias("_ts_y"), F.col("spans").alias("_ts_spans"))

    t = squeeze(F.col(text))
    df = values.join(broadcast_if_small(src, 50_000), values[source_key] == F.col("_ts_key"), "left")
    df = df.withColumn("_ts_t", t)
    df = df.withColumn("_ts_p", F.when(F.col("_ts_t").rlike(r"\d"), parts(F.col("_ts_t"))))
    p = lambda i: F.nullif(F.get(F.col("_ts_p"), F.lit(i)), F.lit(""))
    num = lambda i: p(i).try_cast("long")
    swap = (F.get(F.col("_ts_p"), F.lit(0)) == "xxy") & (F.col("_ts_order") == "DMY")
    named_form = F.get(F.col("_ts_p"), F.lit(0)).isin("dmy", "mdy")
    month = F.when(named_form, month_number(p(2))).when(swap, num(3)).otherwise(num(2)).cast("long")
    day = F.when(swap, num(2)).otherwise(num(3))
    order_known = (F.get(F.col("_ts_p"), F.lit(0)) != "xxy") | F.col("_ts_order").isin("DMY", "MDY")
    half = F.lower(p(8))
    hour = F.when(half.isNull(), F.coalesce(num(4), F.lit(0))).when(num(4).between(1, 12), num(4) % 12 + F.when(half == "p", 12).otherwise(0))
    df = df.select(
        "*",
        num(1).alias("_ts_year"), month.alias("_ts_month"), day.alias("_ts_day"), hour.alias("_ts_hour"),
        F.coalesce(num(5), F.lit(0)).alias("_ts_min"), F.coalesce(num(6), F.lit(0)).alias("_ts_sec"),
        F.coalesce(F.rpad(F.substring(p(7), 1, 6), 6, "0").try_cast("long"), F.lit(0)).alias("_ts_frac"),
        p(9).alias("_ts_ztext"), order_known.alias("_ts_known"),
    )
    y, m, d = F.col("_ts_year"), F.col("_ts_month"), F.col("_ts_day")
    h, mi, s = F.col("_ts_hour"), F.col("_ts_min"), F.col("_ts_sec")
    valid = F.col("_ts_known") & (y >= 1) & m.between(1, 12) & (d >= 1) & (d <= days_in_month(y, m)) & (mi <= 59) & (s <= 59) & ((h <= 23) | ((h == 24) & (mi == 0) & (s == 0)))
    local = F.when(valid, (days_from_civil(y, m, d) * 86400 + h * 3600 + mi * 60 + s) * 1_000_000 + F.col("_ts_frac"))
    df = df.withColumn("_ts_local", local)
    z = F.col("_ts_ztext")
    off = F.regexp_extract(z, r"^(?i:utc|gmt)?\s?([+\-−])(\d{1,2}):?(\d{2})?(?:\s*\[[^\]]*\])?$", 1)
    oh = F.regexp_extract(z, r"^(?i:utc|gmt)?\s?[+\-−](\d{1,2}):?(\d{2})?(?:\s*\[[^\]]*\])?$", 1).try_cast("long")
    om = F.coalesce(F.regexp_extract(z, r"^(?i:utc|gmt)?\s?[+\-−]\d{1,2}:?(\d{2})(?:\s*\[[^\]]*\])?$", 1).try_cast("long"), F.lit(0))
    off_min = F.when(z.isin("Z", "z"), F.lit(0)).when((off != "") & (oh <= 18) & (om <= 59), (oh * 60 + om) * F.when(off == "+", 1).otherwise(-1))
    zone = F.when(z.isNull(), F.col("_ts_zone")).otherwise(F.nullif(F.regexp_extract(z, r"^\[?" + _IANA + r"\]?$", 1), F.lit("")))
    df = df.withColumns({
        "_ts_off": off_min,
        "_ts_named": zone,
        "_ts_a": F.when(off_min.isNull() & z.rlike("^[A-Za-z]{1,6}$"), F.upper(z)),
        "_ts_yk": table_year(y)[0],
        # the wall time in the year of the table; made before the joins, or every lambda below would make it anew
        "_ts_at": F.col("_ts_local") - table_year(y)[1] * 86_400_000_000,
    })
    df = df.join(broadcast_if_small(abb, 10_000), F.col("_ts_a") == F.col("_ts_abb"), "left")
    df = df.join(F.broadcast(table), (F.col("_ts_named") == F.col("_ts_z")) & (F.col("_ts_yk") == F.col("_ts_y")), "left")

    lt = F.col("_ts_local")
    at = F.col("_ts_at")
    hold = F.filter("_ts_spans", lambda x: (x.from_us <= at) & (at < x.to_us))
    past = F.filter("_ts_spans", lambda x: x.to_us <= at)
    most = F.array_max(F.transform(hold, lambda x: x.off_us))  # the larger offset is the earlier instant
    before = F.element_at(past, -1).off_us
    bare = F.col("_ts_t").rlike(r"^[+-]?\d+(\.\d+)?$")
    whole = F.regexp_extract("_ts_t", r"^[+-]?(\d+)", 1)
    digits = F.length(F.ltrim(whole, F.lit("0")))
    wv = whole.try_cast("long")
    frac6 = F.rpad(F.substring(F.regexp_extract("_ts_t", r"\.(\d+)$", 1), 1, 6), 6, "0").try_cast("long")
    sign = F.when(F.col("_ts_t").startswith("-"), -1).otherwise(1)
    number = sign * F.when(digits <= 11, wv * 1_000_000 + frac6).when(digits <= 14, wv * 1000 + F.floor(frac6 / 1000)).when(digits <= 17, wv)
    minute = F.lit(60_000_000)
    basis = (
        F.when(bare, F.when(number.isNotNull(), "number"))
        .when(lt.isNull(), None)
        .when(F.col("_ts_off").isNotNull(), "offset")
        .when(F.col("_ts_abb_min").isNotNull(), "abbreviation")
        .when(F.col("_ts_spans").isNull(), None)
        .when(F.size(hold) == 1, "zone")
        .when(F.size(hold) > 1, "ambiguous")
        .when(before.isNotNull(), "nonexistent")
    )
    df = df.withColumn("basis", basis)
    utc = (
        F.when(F.col("basis") == "number", number)
        .when(F.col("basis") == "offset", lt - F.col("_ts_off") * minute)
        .when(F.col("basis") == "abbreviation", lt - F.col("_ts_abb_min") * minute)
        .when(F.col("basis").isin("zone", "ambiguous"), lt - most)
        .when(F.col("basis") == "nonexistent", lt - before)
    )
    out = df.withColumns({"utc_micros": utc.cast("long"), "zone_used": F.when(F.col("basis").isin("zone", "ambiguous", "nonexistent"), F.col("_ts_named"))})
    return out.drop(*[c for c in out.columns if c.startswith("_ts_")])


def posting_instants(jobs: DataFrame, sources: DataFrame, abbrevs: DataFrame, fields: tuple[str, ...] = ("date_posted", "first_seen_at", "last_seen")) -> DataFrame:
    """(job_id, field, value, utc_micros, basis, zone_used): one row per non-null value not yet in the exact form."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]))
    long = (
        jobs.select(F.col("id").alias("job_id"), F.col("source_name"), pairs.alias("x"))
        .select("job_id", "source_name", "x.field", "x.value")
        .where(F.col("value").isNotNull() & ~F.col("value").rlike(EXACT))
    )
    return read_instants(long, sources, abbrevs).drop("source_name")
