"""Exchange calendar: rule-based holidays and early closes as a small dimension, session predicates as expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ZONE, OPEN, SESSION, EARLY = "America/New_York", 570, 390, 210
DAY = dt.timedelta(days=1)


def easter(year: int) -> dt.date:
    """Gregorian Easter Sunday, by the method of Meeus."""
    a, (b, c) = year % 19, divmod(year, 100)
    d, e = divmod(b, 4)
    g = (8 * b + 13) // 25
    h = (19 * a + b - d - g + 15) % 30
    i, k = divmod(c, 4)
    r = (32 + 2 * e + 2 * i - h - k) % 7
    m = (a + 11 * h + 22 * r) // 451
    month, day = divmod(h + r - 7 * m + 114, 31)
    return dt.date(year, month, day + 1)


def nth_weekday(year: int, month: int, weekday: int, n: int) -> dt.date:
    """The n-th weekday (Monday 0) of a month; n = -1 is the last."""
    if n > 0:
        first = dt.date(year, month, 1)
        return first + DAY * ((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = (dt.date(year + month // 12, month % 12 + 1, 1)) - DAY
    return last - DAY * ((last.weekday() - weekday) % 7)


def observed(d: dt.date) -> dt.date:
    return d - DAY if d.weekday() == 5 else d + DAY if d.weekday() == 6 else d


def holidays(year: int) -> list[dt.date]:
    """Full-day closures. A New Year's Day on Saturday isn't observed."""
    new_year = dt.date(year, 1, 1)
    out = [] if new_year.weekday() == 5 else [observed(new_year)]
    out += [nth_weekday(year, 1, 0, 3), nth_weekday(year, 2, 0, 3), easter(year) - 2 * DAY, nth_weekday(year, 5, 0, -1), observed(dt.date(year, 7, 4)),
            nth_weekday(year, 9, 0, 1), nth_weekday(year, 11, 3, 4), observed(dt.date(year, 12, 25))]
    if year >= 2022:
        out.append(observed(dt.date(year, 6, 19)))
    return sorted(out)


def early_closes(year: int) -> list[dt.date]:
    out = [nth_weekday(year, 11, 3, 4) + DAY]
    out += [d for d in (dt.date(year, 7, 3), dt.date(year, 12, 24)) if d.weekday() < 4]
    return sorted(set(out) - set(holidays(year)))


def days(spark: SparkSession, first: int, last: int) -> DataFrame:
    """A row for each day of the years: weekday, holiday, early_close, trading, session_minutes, next_trading_day."""
    special = [(d, "holiday") for y in range(first, last + 1) for d in holidays(y)] + [(d, "early") for y in range(first, last + 1) for d in early_closes(y)]
    kinds = spark.createDataFrame(special, "date date, kind string")  # a dozen rows a year
    all_days = spark.sql(f"select explode(sequence(date'{first}-01-01', date'{last}-12-31', interval 1 day)) as date").join(F.broadcast(kinds), "date", "left")
    trading = (F.weekday("date") < 5) & F.coalesce(F.col("kind") != "holiday", F.lit(True))
    out = all_days.select("date", (F.col("kind") == "holiday").alias("_h"), (F.col("kind") == "early").alias("_e"), trading.alias("trading"))
    out = out.select("date", F.coalesce("_h", F.lit(False)).alias("holiday"), F.coalesce("_e", F.lit(False)).alias("early_close"), "trading")
    minutes = F.when(~F.col("trading"), 0).when(F.col("early_close"), EARLY).otherwise(SESSION)
    upcoming = F.min(F.when(F.col("trading"), F.col("date"))).over(Window.orderBy("date").rowsBetween(1, 14))
    return out.withColumns({"session_minutes": minutes, "next_trading_day": upcoming})  # one window over a few thousand days


def local(ts: str | Column, zone: str = ZONE) -> Column:
    return F.from_utc_timestamp(ts, zone)


def session_date(ts: str | Column) -> Column:
    return F.to_date(local(ts))


def minutes_since_open(ts: str | Column) -> Column:
    return F.hour(local(ts)) * 60 + F.minute(local(ts)) - OPEN


def in_session(ts: str | Column, session_minutes: Column | int = SESSION, grid: int | None = None) -> Column:
    """On a weekday, between open and close; with a grid, aligned to it with no seconds. Holidays aren't looked at."""
    m = minutes_since_open(ts)
    out = (F.weekday(local(ts)) < 5) & (m >= 0) & (m < session_minutes)
    return out & (m % grid == 0) & (F.second(ts) == 0) if grid else out


def expected_next(ts: str | Column, bar_minutes: int = 30, session_minutes: Column | int = SESSION) -> Column:
    """The next bar's start in the same session, else null."""
    m = minutes_since_open(ts)
    t = F.col(ts) if isinstance(ts, str) else ts
    return F.when(m + bar_minutes < session_minutes, F.timestamp_seconds(F.unix_seconds(t) + 60 * bar_minutes))


def grid(day_table: DataFrame, bar_minutes: int = 30) -> DataFrame:
    """Local bar starts of every trading day."""
    k = F.explode(F.sequence(F.lit(0), (F.col("session_minutes") / bar_minutes).cast("int") - 1)).alias("bar")
    return day_table.where("trading").select("date", k).select("date", "bar", (F.col("date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(OPEN) + F.col("bar") * bar_minutes)).alias("start"))
