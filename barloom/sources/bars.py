"""Bars: schema, readers and writers, and bars built from deal and line-item tables."""

from __future__ import annotations

import contextlib
import contextvars
import functools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

KEY, TIME = "instrument", "timestamp"
BAR_SCHEMA = T.StructType(
    [T.StructField(KEY, T.StringType()), T.StructField(TIME, T.TimestampType())]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")]
    + [T.StructField("bar_minutes", T.IntegerType()), T.StructField("bid", T.DoubleType()), T.StructField("ask", T.DoubleType()),
       T.StructField("quote_timestamp", T.TimestampType()), T.StructField("observed_at", T.TimestampType()),
       T.StructField("bid_size", T.DoubleType()), T.StructField("ask_size", T.DoubleType()), T.StructField("end_time", T.TimestampType()),
       T.StructField("dollar_volume", T.DoubleType()), T.StructField("deal_count", T.LongType()), T.StructField("vwap", T.DoubleType()),
       T.StructField("bar_kind", T.StringType()), T.StructField("bar_id", T.StringType())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_time() -> WindowSpec:
    return Window.partitionBy(KEY).orderBy(TIME)


def trailing(n: int) -> WindowSpec:
    return by_time().rowsBetween(-(n - 1), 0)


def running() -> WindowSpec:
    return by_time().rowsBetween(Window.unboundedPreceding, 0)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); where that is unset, a local one of our own, on one machine only."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("barloom.shared.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="barloom-")
        spark.conf.set("barloom.shared.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str | None = None, name: str = "table") -> DataFrame:
    """df, written to the shared folder and read back: what reads it twice doesn't make it twice, and lost executors cost no more
    than their tasks."""
    path = f"{folder}/{name}" if folder else fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_once: contextvars.ContextVar[dict | None] = contextvars.ContextVar("once", default=None)


@contextlib.contextmanager
def made_once() -> Iterator[None]:
    """Within it bars of a tape are made once and stored, however many plans, fits and stages read them; an inner one joins the outer."""
    token = _once.set({}) if _once.get() is None else None
    try:
        yield
    finally:
        if token:
            _once.reset(token)


def kept_once(make):
    """A function (spark, sf_dir) -> bars that keeps to made_once; outside of it, or without a shared folder, bars are a plan."""
    @functools.wraps(make)
    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        known, key = _once.get(), (make.__name__, sf_dir)
        if known is None:
            return make(spark, sf_dir)
        if key not in known:
            try:
                shared_dir(spark)
            except ValueError:
                return make(spark, sf_dir)
            path, made = fresh_path(spark, make.__name__), make(spark, sf_dir)
            made.write.parquet(path)
            known[key] = path, made.schema
        path, schema = known[key]
        return spark.read.schema(schema).parquet(path)  # each reader has columns of its own

    return get


@kept_once
def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bar for each return flag and ship date; prints are ordered by their four-column key. One shuffle with partial aggregates."""
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    px = F.col("l_extendedprice").cast("double") / F.col("l_quantity").cast("double")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias(KEY), F.col("l_shipdate").cast("timestamp").alias(TIME), px.alias("px"), key.alias("k"), F.col("l_quantity").cast("double").alias("q"),
        F.col("l_extendedprice").cast("double").alias("p"), F.col("l_linestatus").alias("s"), F.col("l_discount").cast("double").alias("d"))
    out = rows.groupBy(KEY, TIME).agg(
        F.min_by("px", "k").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "k").alias("close"),
        F.sum("q").alias("volume"), F.sum("p").alias("dollar_volume"), F.count("*").alias("deal_count"),
        F.sum(F.when(F.col("s") == "O", F.col("q")).otherwise(0.0)).alias("bid_size"), F.sum(F.when(F.col("s") == "F", F.col("q")).otherwise(0.0)).alias("ask_size"),
        F.avg("d").alias("avg_disc"))
    return out.select("*", (F.col("close") * (1 - F.col("avg_disc") / 200)).alias("bid"), (F.col("close") * (1 + F.col("avg_disc") / 200)).alias("ask")).drop("avg_disc")


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deal events: instrument, exchange time, price, size, sequence id."""
    return table(spark, sf_dir, "events").where("value > 0").select(
        F.col("event_type").alias(KEY), F.col("ts").cast("timestamp").alias(TIME), F.col("value").alias("price"),
        (1 + F.get_json_object("props", "$.k").cast("double")).alias("size"), F.col("event_id").alias("sequence_id"))


def time_bars(ticks: DataFrame, length: str = "15 minutes", slide: str | None = None) -> DataFrame:
    """Tumbling (or sliding) time bars of deals; bars exist only where deals do."""
    key = F.struct(TIME, "sequence_id")
    out = ticks.groupBy(KEY, F.window(TIME, length, slide or length).alias("w")).agg(
        F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close"),
        F.sum("size").alias("volume"), F.sum(F.col("price") * F.col("size")).alias("dollar_volume"), F.count("*").alias("deal_count"))
    return out.select(KEY, F.col("w.start").alias(TIME), "open", "high", "low", "close", "volume", "dollar_volume", "deal_count")


def bars_15m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return time_bars(deals(spark, sf_dir))


def read_bars_csv(spark: SparkSession, path: str, instrument: str | None = None, bar_minutes: int = 30) -> DataFrame:
    """A CSV bar scan with a header. Missing optional columns become null, naive times are UTC, no order is checked."""
    head = spark.read.option("header", True).csv(path)
    have = set(head.columns)
    out = [(F.lit(instrument) if f.name == KEY and instrument else F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in BAR_SCHEMA.fields]
    return head.select(*out).withColumn("bar_minutes", F.coalesce("bar_minutes", F.lit(bar_minutes)))


def out_of_order(bars: DataFrame) -> DataFrame:
    """Bars whose time isn't later than the one before, in file order; a strict loader accepts only an empty result."""
    w = Window.partitionBy(KEY).orderBy("file_order")
    return bars.withColumn("previous", F.lag(TIME).over(w)).where(F.col(TIME) <= F.col("previous"))


def load_strict(bars: DataFrame) -> DataFrame:
    """bars (with file_order) if their times increase within each instrument; else ValueError."""
    if not out_of_order(bars).isEmpty():
        raise ValueError("bar times must increase")
    return bars


def append_new(store: DataFrame, bars: DataFrame) -> DataFrame:
    """store and those bars that are later than its last bar of their instrument. The last times are one row an instrument."""
    last = store.groupBy(KEY).agg(F.max(TIME).alias("_last"))
    fresh = bars.join(last, KEY, "left").where(F.col("_last").isNull() | (F.col(TIME) > F.col("_last"))).drop("_last")
    return store.unionByName(fresh, allowMissingColumns=True)


def save_bars(bars: DataFrame, path: str, fmt: str = "csv") -> str:
    writer = bars.write.mode("errorifexists")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)
    return path


def slice_rows(bars: DataFrame, start: int, stop: int) -> DataFrame:
    """Rows start to stop - 1 of each instrument in time order."""
    return bars.withColumn("_row", F.row_number().over(by_time()) - 1).where((F.col("_row") >= start) & (F.col("_row") < stop)).drop("_row")


def last_rows(bars: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy(KEY).orderBy(F.col(TIME).desc())
    return bars.withColumn("_row", F.row_number().over(w)).where(F.col("_row") <= n).drop("_row")


def checksum(bars: DataFrame) -> DataFrame:
    """First 16 hex digits of SHA-256 over each instrument's bars in time order, prices in millionths."""
    micro = [F.round(F.col(c) * 1e6).cast("long").cast("string") for c in ("open", "high", "low", "close", "volume")]
    line = F.concat_ws(",", F.unix_seconds(TIME).cast("string"), *micro)
    rows = bars.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct(F.col(TIME), line.alias("line")))).alias("rows"))
    return rows.select(KEY, F.substring(F.sha2(F.array_join(F.transform("rows", lambda r: r.line), "|"), 256), 1, 16).alias("checksum"))


def data_tier(bars: DataFrame, least: float = 0.9) -> DataFrame:
    """Share of bars with quotes and with displayed sizes; tier B where both reach the share, else A."""
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    quotes = F.col("bid").isNotNull() & F.col("ask").isNotNull()
    sizes = F.col("bid_size").isNotNull() & F.col("ask_size").isNotNull() & (F.col("bid_size") + F.col("ask_size") > 0)
    out = bars.groupBy(KEY).agg(share(quotes).alias("quote_share"), share(quotes & sizes).alias("size_share"))
    return out.withColumn("tier", F.when((F.col("quote_share") >= least) & (F.col("size_share") >= least), "B").otherwise("A"))


def poll(bars: DataFrame, cursor: Column, now: Column, grace_seconds: int = 20, bar_seconds: int = 900) -> DataFrame:
    """Completed bars after the cursor: closed by now less the grace; observed_at is now, the newest of an instrument is marked."""
    close = F.unix_seconds(TIME) + bar_seconds
    fresh = bars.where((F.col(TIME) > cursor) & (close + grace_seconds <= F.unix_seconds(now)))
    newest = F.max(TIME).over(Window.partitionBy(KEY))
    return fresh.withColumn("observed_at", now).withColumn("is_newest", F.col(TIME) == newest)


def events_from_bars(bars: DataFrame, source: str = "bars") -> DataFrame:
    return bars.select(F.col(KEY).alias("symbol"), F.col(TIME).alias("exchange_timestamp"), F.lit("BAR").alias("event_type"), F.lit(source).alias("source"),
                       (F.row_number().over(by_time()) - 1).cast("long").alias("sequence_id"), F.col("close").alias("deal_price"), F.col("volume").alias("deal_size"))


def with_bar_columns(bars: DataFrame, bar_seconds: int = 86400) -> DataFrame:
    """Close time, latest source time, duration, mid, relative spread and quote imbalance of each bar."""
    close = F.coalesce(F.col("end_time"), F.timestamp_seconds(F.unix_seconds(TIME) + bar_seconds)) if "end_time" in bars.columns else F.timestamp_seconds(F.unix_seconds(TIME) + bar_seconds)
    mid = (F.col("bid") + F.col("ask")) / 2
    total = F.col("bid_size") + F.col("ask_size")
    return bars.withColumns({
        "close_time": close, "latest_source_time": F.greatest(close, F.col("quote_timestamp"), F.col("observed_at")) if "observed_at" in bars.columns else close,
        "duration_seconds": (F.unix_seconds(close) - F.unix_seconds(TIME)).cast("double"), "mid": mid,
        "relative_spread": F.when(mid > 0, (F.col("ask") - F.col("bid")) / mid),
        "quote_imbalance": F.when(total.isNotNull(), F.when(total == 0, 0.0).otherwise(F.try_divide(F.col("bid_size") - F.col("ask_size"), total)))})
