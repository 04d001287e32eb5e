"""Queries: sources and sinks, calendar, validation, projections, joins, sorts, sets, relational surface."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.operators import validate as V
from barloom.plans.base import BARS_15M, BARS_DAILY, ORDER, DEALS, query, sql_of
from barloom.sources import bars as B
from barloom.sources import calendar as C

D = "open high low close volume"
ID = 'instrument, "timestamp"'
ALL = f"{ID}, open, high, low, close, volume"


def daily(spark, sf_dir):
    return B.bars_daily(spark, sf_dir)


def cols(df, extra=()):
    return df.select("instrument", "timestamp", "open", "high", "low", "close", "volume", *extra)


@query("SRC-01", sql_of(f"select {ALL}, 1440::int as bar_minutes from bars", D))
def src_01(spark, sf_dir):
    """A CSV scan: the bars are written as CSV to the shared folder first."""
    path = B.save_bars(cols(daily(spark, sf_dir)), B.fresh_path(spark, "csv"))
    return cols(B.read_bars_csv(spark, path, bar_minutes=1440), ["bar_minutes"])


@query("SRC-02", sql_of(f"select instrument, count(*)::bigint as n, 0::bigint as out_of_order from bars group by 1"))
def src_02(spark, sf_dir):
    bars = daily(spark, sf_dir).withColumn("file_order", F.row_number().over(B.by_time()))
    bad = B.out_of_order(bars).groupBy("instrument").agg(F.count("*").alias("b"))
    return bars.groupBy("instrument").agg(F.count("*").alias("n")).join(bad, "instrument", "left").select("instrument", "n",
        F.coalesce("b", F.lit(0)).alias("out_of_order"))


@query("SRC-03", sql_of(f"select {ALL} from bars where \"timestamp\" <= timestamp '1998-01-01' or \"timestamp\" > timestamp '1998-01-01'",
    D))
def src_03(spark, sf_dir):
    """Appending overlapping bars: only later ones go in."""
    bars = cols(daily(spark, sf_dir))
    cut = F.lit(dt.datetime(1998, 1, 1)).cast("timestamp")
    old = bars.where(F.col("timestamp") <= cut)
    return B.append_new(old, bars.where(F.col("timestamp") > cut - F.expr("interval 200 days")))


@query("SRC-04", sql_of(f"select {ALL} from bars", D))
def src_04(spark, sf_dir):
    path = B.save_bars(cols(daily(spark, sf_dir)), B.fresh_path(spark, "parquet"), "parquet")
    return cols(spark.read.parquet(path))


@query("SRC-05",
    sql_of(f"select {ALL} from (select *, row_number() {ORDER} as n, row_number() over (partition by instrument order by \"timestamp\" desc) as b from bars) where (n > 100 and n <= 200) or b <= 20",
    D))
def src_05(spark, sf_dir):
    bars = cols(daily(spark, sf_dir))
    return B.slice_rows(bars, 100, 200).unionByName(B.last_rows(bars, 20))


@query("SRC-06", sql_of(f"select {ID}, open, close, volume, 86400.0::double as duration_seconds from bars", "open close volume"))
def src_06(spark, sf_dir):
    return B.with_bar_columns(daily(spark, sf_dir)).select("instrument", "timestamp", "open", "close", "volume", "duration_seconds")


_micro = " || ',' || ".join(f"round({c} * 1e6)::bigint::varchar" for c in D.split())


@query("SRC-07",
    sql_of(f"select instrument, substr(sha256(string_agg(epoch(\"timestamp\")::bigint::varchar || ',' || {_micro}, '|' order by \"timestamp\")), 1, 16) as checksum from bars group by 1"))
def src_07(spark, sf_dir):
    return B.checksum(daily(spark, sf_dir))


@query("SRC-08",
    sql_of("select instrument, q as quote_share, s as size_share, case when q >= 0.9 and s >= 0.9 then 'B' else 'A' end as tier from (select instrument, avg(case when bid is not null and ask is not null then 1.0 else 0.0 end) as q, avg(case when bid is not null and bid_size + ask_size > 0 then 1.0 else 0.0 end) as s from bars group by 1)",
    "quote_share size_share"))
def src_08(spark, sf_dir):
    return B.data_tier(daily(spark, sf_dir))


LOCAL = "timezone('America/New_York', \"timestamp\" at time zone 'UTC')"
L = f"(select *, {LOCAL} as l from bars)"
MIN = "(date_part('hour', l) * 60 + date_part('minute', l) - 570)"


@query("SRC-09", sql_of(f"select {ALL} from {L} where isodow(l) < 6 and {MIN} between 0 and 389", D, BARS_15M))
def src_09(spark, sf_dir):
    return cols(B.bars_15m(spark, sf_dir).where(C.in_session("timestamp")))


@query("SRC-11",
    sql_of(f"select {ALL} from {L} where isodow(l) < 6 and {MIN} between 0 and 389 and \"timestamp\" + interval 15 minutes <= timestamp '2024-01-15'",
    D, BARS_15M))
def src_11(spark, sf_dir):
    done = F.unix_seconds("timestamp") + 900 <= F.unix_seconds(F.lit(dt.datetime(2024, 1, 15)).cast("timestamp"))
    return cols(B.bars_15m(spark, sf_dir).where(C.in_session("timestamp") & done))


@query("SRC-12",
    sql_of(f"select {ALL}, \"timestamp\" = max(\"timestamp\") over (partition by instrument) as is_newest from bars where \"timestamp\" > timestamp '2024-01-10' and \"timestamp\" + interval 920 seconds <= timestamp '2024-01-11'",
    D, BARS_15M))
def src_12(spark, sf_dir):
    at = lambda *d: F.lit(dt.datetime(*d)).cast("timestamp")
    return cols(B.poll(B.bars_15m(spark, sf_dir), at(2024, 1, 10), at(2024, 1, 11)), ["is_newest"])


@query("SRC-13",
    sql_of(f"select instrument, count(*)::bigint as n, max(\"timestamp\") as newest from bars where instrument in ('click', 'purchase') group by 1",
    "", BARS_15M))
def src_13(spark, sf_dir):
    return B.bars_15m(spark, sf_dir).where(F.col("instrument").isin("click", "purchase")).groupBy("instrument").agg(F.count("*").alias("n"),
        F.max("timestamp").alias("newest"))


@query("SRC-14",
    sql_of(f"select instrument as symbol, \"timestamp\" as exchange_timestamp, 'BAR' as event_type, 'bars' as source, row_number() {ORDER} - 1 as sequence_id, close as deal_price, volume as deal_size from bars",
    "deal_price deal_size", BARS_15M))
def src_14(spark, sf_dir):
    return B.events_from_bars(B.bars_15m(spark, sf_dir))


@query("SRC-20", sql_of("select instrument, volume from bars", "volume"))
def src_20(spark, sf_dir):
    """The audit sink: JSON lines, read back."""
    path = B.fresh_path(spark, "audit")
    daily(spark, sf_dir).select(F.to_json(F.struct("instrument", "volume")).alias("value")).write.text(path)
    return spark.read.text(path).select(F.from_json("value", "instrument string, volume double").alias("v")).select("v.instrument",
        "v.volume")


# --- calendar
FIRST, LAST = 1995, 2027
HOL = f"""days as (select d::date as date, year(d)::int as y, month(d) as m, day(d) as dd, isodow(d) as w from generate_series(timestamp '{FIRST - 1}-12-25', timestamp '{LAST}-12-31', interval 1 day) t(d)),
ranked as (select *, row_number() over (partition by y, m, w order by date) as k, row_number() over (partition by y, m, w order by date desc) as kd from days),
c as (select y, y % 19 as a, y // 100 as b, y % 100 as cc from generate_series({FIRST}, {LAST}) t(y)),
c2 as (select *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 as h from c),
c3 as (select *, (32 + 2 * (b % 4) + 2 * (cc // 4) - h - cc % 4) % 7 as r from c2), c4 as (select *, (a + 11 * h + 22 * r) // 451 as mm from c3),
east as (select y, make_date(y::int, ((h + r - 7 * mm + 114) // 31)::int, ((h + r - 7 * mm + 114) % 31 + 1)::int) as e from c4),
fixed as (select date + (case w when 6 then -1 when 7 then 1 else 0 end)::int as date from days where ((m = 1 and dd = 1 and w <> 6) or (m = 7 and dd = 4) or (m = 12 and dd = 25) or (m = 6 and dd = 19 and y >= 2022)) and y >= {FIRST}),
hol as (select date from fixed union select date from ranked where y >= {FIRST} and ((m = 1 and w = 1 and k = 3) or (m = 2 and w = 1 and k = 3) or (m = 5 and w = 1 and kd = 1) or (m = 9 and w = 1 and k = 1) or (m = 11 and w = 4 and k = 4)) union select e - 2 from east),
early as (select date + 1 as date from ranked where y >= {FIRST} and m = 11 and w = 4 and k = 4 union select date from days where y >= {FIRST} and ((m = 7 and dd = 3) or (m = 12 and dd = 24)) and w < 5),
early2 as (select date from early where date not in (select date from hol)),
cal as (select date, date in (select date from hol) as holiday, date in (select date from early2) as early_close, w < 6 and date not in (select date from hol) as trading from days where y between {FIRST} and {LAST}),
cal2 as (select *, case when not trading then 0 when early_close then 210 else 390 end::int as session_minutes, min(case when trading then date end) over (order by date rows between 1 following and 14 following) as next_trading_day from cal)"""


def all_days(spark):
    return C.days(spark, FIRST, LAST)


for _key, _cols in (("CAL-02", "date, holiday"), ("CAL-04", "date, early_close"), ("CAL-05", "date, trading, next_trading_day"),
    ("CAL-06", "date, session_minutes")):
    query(_key, sql_of(f"select {_cols} from cal2 where date < date '2027-12-20'", "", HOL))(lambda spark, sf_dir,
        _c=_cols: all_days(spark).where("date < date'2027-12-20'").select(*_c.split(", ")))


@query("CAL-03", sql_of("select y::int as year, e as easter from east", "", HOL))
def cal_03(spark, sf_dir):
    return spark.createDataFrame([(y, C.easter(y)) for y in range(FIRST, LAST + 1)], "year int, easter date")


@query("CAL-10",
    sql_of("select date, bar::int as bar, date + to_minutes((570 + 30 * bar)::bigint) as start from cal2, generate_series(0, 12) t(bar) where trading and bar < session_minutes / 30 and year(date) = 2024",
    "", HOL))
def cal_10(spark, sf_dir):
    return C.grid(C.days(spark, 2024, 2024))


@query("CAL-01", sql_of("select sequence_id, l as local, l::date as session_date from (select *, " + LOCAL + " as l from deals)", "",
    DEALS))
def cal_01(spark, sf_dir):
    return B.deals(spark, sf_dir).select("sequence_id", C.local("timestamp").alias("local"),
        C.session_date("timestamp").alias("session_date"))


@query("CAL-07", sql_of(f"select sequence_id, {MIN}::int as minute from (select *, {LOCAL} as l from deals)", "", DEALS))
def cal_07(spark, sf_dir):
    return B.deals(spark, sf_dir).select("sequence_id", C.minutes_since_open("timestamp").cast("int").alias("minute"))


@query("CAL-08",
    sql_of(f"select {ID}, isodow(l) < 6 and {MIN} between 0 and 389 as in_session, isodow(l) < 6 and {MIN} between 0 and 389 and {MIN} % 30 = 0 as on_grid from {L}",
    "", BARS_15M))
def cal_08(spark, sf_dir):
    return B.bars_15m(spark, sf_dir).select("instrument", "timestamp", C.in_session("timestamp").alias("in_session"),
        C.in_session("timestamp", grid=30).alias("on_grid"))


@query("CAL-09",
    sql_of(f"select {ID}, case when {MIN} + 15 < 390 then \"timestamp\" + interval 15 minutes end as expected, coalesce(lag(l::date) {ORDER} <> l::date, true) as boundary from {L}",
    "", BARS_15M))
def cal_09(spark, sf_dir):
    day = C.session_date("timestamp")
    return B.bars_15m(spark, sf_dir).select("instrument", "timestamp", C.expected_next("timestamp", 15).alias("expected"),
        F.coalesce(F.lag(day).over(B.by_time()) != day, F.lit(True)).alias("boundary"))


@query("CAL-11", sql_of(f"select {ID}, dense_rank() over (partition by instrument order by l::date) - 1 as session from {L}", "", BARS_15M))
def cal_11(spark, sf_dir):
    rank = F.dense_rank().over(Window.partitionBy("instrument").orderBy(C.session_date("timestamp")))
    return B.bars_15m(spark, sf_dir).select("instrument", "timestamp", (rank - 1).cast("long").alias("session"))


# --- validation, on bars broken on purpose by their row number
BROKEN = f"""n as (select *, row_number() {ORDER} as n from bars), b as (select * replace (case when n % 97 = 0 then -1 else open end as open, case when n % 89 = 0 then low - 1 else high end as high,
 case when n % 83 = 0 then null else close end as close, case when n % 79 = 0 then -volume else volume end as volume, case when n % 73 = 0 then bid - 1 else ask end as ask) from n)"""


def broken(spark, sf_dir):
    n = F.col("n")
    out = daily(spark, sf_dir).withColumn("n", F.row_number().over(B.by_time()))
    return out.withColumns({"open": F.when(n % 97 == 0, -1.0).otherwise(F.col("open")),
        "high": F.when(n % 89 == 0, F.col("low") - 1).otherwise(F.col("high")),
                            "close": F.when(n % 83 != 0, F.col("close")),
                                "volume": F.when(n % 79 == 0, -F.col("volume")).otherwise(F.col("volume")),
                                "ask": F.when(n % 73 == 0, F.col("bid") - 1).otherwise(F.col("ask"))})


@query("VAL-01",
    sql_of(f"select {ID}, concat_ws(',', case when close is null then 'non-finite' end, case when least(open, high, low, close) <= 0 then 'non-positive price' end, case when high < greatest(open, close, low) - 1e-12 or low > least(open, close, high) + 1e-12 then 'inconsistent prices' end, case when volume < 0 then 'negative volume' end, case when ask < bid then 'crossed quote' end) as reasons from b",
    "", BARS_DAILY + ", " + BROKEN))
def val_01(spark, sf_dir):
    return broken(spark, sf_dir).select("instrument", "timestamp", F.array_join(V.structural_reasons(), ",").alias("reasons"))


@query("VAL-02",
    sql_of(f"select {ID}, '' as reject, concat_ws(',', case when date_diff('second', lag(\"timestamp\") {ORDER}, \"timestamp\") > 86400 then 'missing bar' end, case when abs(ln(close / lag(close) {ORDER})) > 0.1 then 'jump' end) as halt from bars"))
def val_02(spark, sf_dir):
    out = V.sequence_columns(daily(spark, sf_dir), "timestamp", 86400)
    return out.select("instrument", "timestamp", F.array_join("reject", ",").alias("reject"), F.array_join("halt", ",").alias("halt"))


@query("VAL-03",
    sql_of(f"""select instrument, n - 1 as file_order, case when prev is not null and date_diff('second', prev, "timestamp") > 86400 then 'halt' when abs(ln(close / pc)) > 0.1 then 'halt' else 'ok' end as status
 from (select *, row_number() {ORDER} as n, lag("timestamp") {ORDER} as prev, lag(close) {ORDER} as pc from bars)"""))
def val_03(spark, sf_dir):
    bars = daily(spark, sf_dir).withColumn("file_order", (F.row_number().over(B.by_time()) - 1).cast("long"))
    return V.validate(bars, 86400).select("instrument", "file_order", "status")


@query("VAL-04",
    sql_of(f"select instrument, date_diff('second', max(\"timestamp\") + interval 15 minutes, timestamp '2024-01-30') > 2700 as stale from bars group by 1",
    "", BARS_15M))
def val_04(spark, sf_dir):
    last = B.bars_15m(spark, sf_dir).groupBy("instrument").agg((F.max(F.unix_seconds("timestamp")) + 900).alias("t"))
    return last.select("instrument", V.stale(F.col("t"), F.lit(0).cast("long"),
        F.unix_seconds(F.lit(dt.datetime(2024, 1, 30)).cast("timestamp")), 900).alias("stale"))


# --- projections
@query("PRJ-01", sql_of(f"select {ID}, \"timestamp\" + interval 1 day as close_time, 86400.0::double as duration_seconds from bars"))
def prj_01(spark, sf_dir):
    return B.with_bar_columns(daily(spark, sf_dir)).select("instrument", "timestamp", "close_time", "duration_seconds")


@query("PRJ-02",
    sql_of(f"select {ID}, (bid + ask) / 2 as mid, (ask - bid) / ((bid + ask) / 2) as relative_spread, case when bid_size + ask_size = 0 then 0 else (bid_size - ask_size) / (bid_size + ask_size) end as quote_imbalance from bars",
    "mid relative_spread quote_imbalance"))
def prj_02(spark, sf_dir):
    return B.with_bar_columns(daily(spark, sf_dir)).select("instrument", "timestamp", "mid", "relative_spread", "quote_imbalance")


@query("PRJ-03", sql_of(f"select {ID}, volume, dollar_volume from bars", "volume dollar_volume"))
def prj_03(spark, sf_dir):
    from barloom.plans.schema import FeatureSchema

    names = FeatureSchema({"VOLUME": ["volume", "dollar_volume"], "PRICE": ["open", "close"]}).without("PRICE")
    return daily(spark, sf_dir).select("instrument", "timestamp", *names)


@query("PRJ-04", sql_of(f"select {ALL} from b where close is not null and volume > 0", D, BARS_DAILY + ", " + BROKEN))
def prj_04(spark, sf_dir):
    return cols(broken(spark, sf_dir).dropna(subset=["close"]).where("volume > 0"))


@query("PRJ-05", sql_of(f"select {ID}, open, close from bars", "open close"))
def prj_05(spark, sf_dir):
    return daily(spark, sf_dir).select("instrument", "timestamp", "open", "close")


@query("PRJ-06", sql_of(f"select {ID}, ln(close) as log_close from bars", "log_close"))
def prj_06(spark, sf_dir):
    return daily(spark, sf_dir).select("instrument", "timestamp", F.log("close").alias("log_close"))


@query("PRJ-07", sql_of(f"select {ID}, close is not null and open is not null as finite from b", "", BARS_DAILY + ", " + BROKEN))
def prj_07(spark, sf_dir):
    from barloom.functions.scalars import finite

    return broken(spark, sf_dir).select("instrument", "timestamp", (finite(F.col("close")) & finite(F.col("open"))).alias("finite"))


# --- joins
@query("JOI-02", sql_of(f"select {ID}, close, lead(open) {ORDER} as open_next from bars", "close open_next"))
def joi_02(spark, sf_dir):
    return daily(spark, sf_dir).select("instrument", "timestamp", "close", F.lead("open").over(B.by_time()).alias("open_next"))


@query("JOI-03", sql_of("select instrument, count_if(\"timestamp\" < timestamp '1997-06-01')::bigint as index_at from bars group by 1"))
def joi_03(spark, sf_dir):
    return daily(spark, sf_dir).groupBy("instrument").agg(F.count_if(F.col("timestamp") < F.lit(dt.datetime(1997, 6,
        1)).cast("timestamp")).alias("index_at"))


@query("JOI-04",
    sql_of(f"select {ID}, w::int as \"window\" from (select *, row_number() {ORDER} - 1 as i from bars) b join (select w, 300 + 250 * w as lo, 550 + 250 * w as hi from generate_series(0, 5) t(w)) on i >= lo and i < hi"))
def joi_04(spark, sf_dir):
    w = spark.range(6).select(F.col("id").cast("int").alias("window"), (300 + 250 * F.col("id")).alias("lo"),
        (550 + 250 * F.col("id")).alias("hi"))
    rows = daily(spark, sf_dir).withColumn("i", F.row_number().over(B.by_time()) - 1)
    return rows.join(F.broadcast(w), (F.col("i") >= F.col("lo")) & (F.col("i") < F.col("hi"))).select("instrument", "timestamp", "window")


@query("JOI-04-instruments",
    sql_of(f"select {ID}, ((i - 300) // 250)::int as \"window\" from (select *, row_number() {ORDER} - 1 as i from bars) where i >= 300"))
def joi_04_instruments(spark, sf_dir):
    """The windows that each instrument's rows fill, to its last row."""
    rows = daily(spark, sf_dir).withColumn("i", F.row_number().over(B.by_time()) - 1)
    last = F.floor((F.max("i") - 300) / 250).cast("int")
    w = rows.groupBy("instrument").agg(last.alias("_last")).where("_last >= 0").select("instrument",
        F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("window"))
    return rows.withColumn("window", F.floor((F.col("i") - 300) / 250).cast("int")).join(w, ["instrument", "window"]).select("instrument",
        "timestamp", "window")


TRD = "t as (select deal_id, entry_row, entry_row + 4 + deal_id % 3 as exit_row from (select k as deal_id, 7 * k as entry_row from generate_series(0, 200) g(k)))"


@query("JOI-05",
    sql_of("select i as row, max(deal_id)::int as deal_id from t join generate_series(0, 1500) g(i) on i between entry_row and exit_row group by 1",
    "", TRD))
def joi_05(spark, sf_dir):
    """Interval join of deals with rows; of deals on the same row the later one counts. Spans are expanded, so it is an equi-join."""
    k = F.col("id").cast("int")
    t = spark.range(201).select(k.alias("deal_id"), (7 * F.col("id")).alias("entry_row"),
        (7 * F.col("id") + 4 + F.col("id") % 3).alias("exit_row"))
    spans = t.select("deal_id", F.explode(F.sequence("entry_row", "exit_row")).alias("row"))
    return spark.range(1501).withColumnRenamed("id", "row").join(spans, "row").groupBy("row").agg(F.max("deal_id").alias("deal_id"))


@query("JOI-06",
    sql_of(f"select a.instrument, a.\"timestamp\", a.close, b.open as next_open from n a join n b on a.instrument = b.instrument and a.i + 1 = b.i",
    "close next_open", BARS_DAILY + f", n as (select *, row_number() {ORDER} as i from bars)"))
def joi_06(spark, sf_dir):
    n = daily(spark, sf_dir).withColumn("i", F.row_number().over(B.by_time()))
    nxt = n.select("instrument", (F.col("i") - 1).alias("i"), F.col("open").alias("next_open"))
    return n.join(nxt, ["instrument", "i"]).select("instrument", "timestamp", "close", "next_open")


@query("JOI-07",
    sql_of(f"select {ALL} from bars where \"timestamp\" + interval 15 minutes <= timestamp '2024-01-20' and instrument <> 'view'", D,
    BARS_15M))
def joi_07(spark, sf_dir):
    end = F.unix_seconds(F.lit(dt.datetime(2024, 1, 20)).cast("timestamp"))
    return cols(B.bars_15m(spark, sf_dir).where((F.unix_seconds("timestamp") + 900 <= end) & (F.col("instrument") != "view")))


@query("JOI-08", sql_of("select entry_row // 250 as window_id, count(*)::bigint as deals from t group by 1", "", TRD))
def joi_08(spark, sf_dir):
    t = spark.range(201).select((7 * F.col("id")).alias("entry_row"))
    windows = spark.range(1501).select(F.col("id").alias("entry_row"), F.floor(F.col("id") / 250).alias("window_id"))
    return t.join(windows, "entry_row").groupBy("window_id").agg(F.count("*").alias("deals"))


@query("JOI-09", sql_of("select 0::bigint as differing_keys", "", "one as (select 1)"))
def joi_09(spark, sf_dir):
    a = daily(spark, sf_dir).select("instrument", "timestamp")
    b = cols(daily(spark, sf_dir).where("close > 0")).select("instrument", "timestamp")
    return a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.count("*").alias("differing_keys"))


# --- sorts, limits, sets
@query("ORD-01", sql_of(f"select {ID}, row_number() {ORDER}::bigint as n from bars"))
def ord_01(spark, sf_dir):
    return daily(spark, sf_dir).select("instrument", "timestamp", F.row_number().over(B.by_time()).cast("long").alias("n"))


@query("ORD-02", sql_of(f"select {ID}, close from bars order by \"timestamp\" desc, instrument limit 25", "close"))
def ord_02(spark, sf_dir):
    return daily(spark, sf_dir).select("instrument", "timestamp", "close").orderBy(F.col("timestamp").desc(), "instrument").limit(25)


@query("ORD-03",
    sql_of("select instrument, first_ts as \"timestamp\", best from (select instrument, \"timestamp\" as first_ts, high as best, row_number() over (partition by instrument order by high desc, \"timestamp\") as k from bars) where k = 1",
    "best"))
def ord_03(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("instrument").orderBy(F.col("high").desc(), "timestamp"))
    return daily(spark, sf_dir).withColumn("k", k).where("k = 1").select("instrument", "timestamp", F.col("high").alias("best"))


@query("ORD-04", sql_of("select instrument, arg_min(close, row(low, \"timestamp\")) as close from bars group by 1", "close"))
def ord_04(spark, sf_dir):
    return daily(spark, sf_dir).groupBy("instrument").agg(F.min_by("close", F.struct("low", "timestamp")).alias("close"))


@query("ORD-06",
    sql_of("select instrument, close from (select instrument, close, row_number() over (partition by instrument order by close, \"timestamp\") as k, count(*) over (partition by instrument) as n from bars) where k = n // 2 + 1",
    "close"))
def ord_06(spark, sf_dir):
    p = Window.partitionBy("instrument")
    out = daily(spark, sf_dir).withColumns({"k": F.row_number().over(p.orderBy("close", "timestamp")), "n": F.count("*").over(p)})
    return out.where(F.col("k") == F.floor(F.col("n") / 2) + 1).select("instrument", "close")


@query("ORD-07", sql_of(f"select {ALL} from (select *, row_number() {ORDER} as k from bars) where k <= 50", D))
def ord_07(spark, sf_dir):
    return cols(B.slice_rows(daily(spark, sf_dir), 0, 50))


@query("SET-01",
    sql_of("select 'a' as part, o_orderkey from orders where o_orderstatus = 'F' union all select 'b', o_orderkey from orders where o_totalprice > 200000",
    "", "one as (select 1)"))
def set_01(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders")
    return o.where("o_orderstatus = 'F'").select(F.lit("a").alias("part"),
        "o_orderkey").unionByName(o.where("o_totalprice > 200000").select(F.lit("b").alias("part"), "o_orderkey"))


@query("SET-02", sql_of("select distinct c_mktsegment from customer", "", "one as (select 1)"))
def set_02(spark, sf_dir):
    return B.table(spark, sf_dir, "customer").select("c_mktsegment").distinct()


@query("SET-03",
    sql_of("select o_custkey from orders where o_orderstatus = 'F' except select o_custkey from orders where o_orderstatus = 'O'", "",
    "one as (select 1)"))
def set_03(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders")
    return o.where("o_orderstatus = 'F'").select("o_custkey").subtract(o.where("o_orderstatus = 'O'").select("o_custkey"))


@query("SET-04", sql_of("select o_custkey, min(o_orderkey) as o_orderkey from orders group by 1", "", "one as (select 1)"))
def set_04(spark, sf_dir):
    return B.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
