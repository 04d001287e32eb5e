"""Structured Streaming: time bars with watermarks, session windows, and stateful event bars with late events set aside."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.sources.bars import KEY, TIME, fresh_path

TICK = "instrument string, timestamp timestamp, price double, size double, sequence_id long"


#: fixed values: the arrivals that a tape is replayed in, and the ticks of one at least and at most (but for equal times)
ARRIVALS, LEAST_TICKS, MOST_TICKS = 8, 5_000, 2_000_000


def tick_stream(spark: SparkSession, path: str, files_per_trigger: int | None = 1) -> DataFrame:
    """Ticks of a folder's files; without a number of files a trigger takes all that are there."""
    reader = spark.readStream.schema(TICK)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def stream_bars(ticks: DataFrame, length: str = "15 minutes", delay: str = "20 seconds", slide: str | None = None) -> DataFrame:
    """Time bars that come out once the watermark passes their end (append mode)."""
    key = F.struct(TIME, "sequence_id")
    out = ticks.withWatermark(TIME, delay).groupBy(KEY, F.window(TIME, length, slide or length).alias("w")).agg(
        F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close"),
        F.sum("size").alias("volume"), F.count("*").alias("deal_count"))
    return out.select(KEY, F.col("w.start").alias(TIME), "open", "high", "low", "close", "volume", "deal_count")


def stream_sessions(ticks: DataFrame, gap: str = "30 minutes", delay: str = "20 seconds") -> DataFrame:
    out = ticks.withWatermark(TIME, delay).groupBy(KEY, F.session_window(TIME, gap).alias("w")).agg(F.count("*").alias("n"), F.sum("size").alias("volume"))
    return out.select(KEY, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "volume")


EVENT = "instrument string, start timestamp, close double, volume double, deal_count long, kind string"
_STATE = "last timestamp, start timestamp, close double, volume double, n long, session string"


def stream_event_bars(ticks: DataFrame, target: float, delay: str = "1 day") -> DataFrame:
    """Volume bars by accumulate and reset with one small state an instrument; ticks not later than the last one accepted come
    out with kind "late" and change nothing."""
    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, start, close, volume, n, session = state.get if state.exists else (None, None, None, 0.0, 0, None)
        out = []
        batch = pd.concat(list(frames)).sort_values([TIME, "sequence_id"])
        for t, price, size in zip(batch[TIME], batch["price"], batch["size"], strict=True):
            if last is not None and t <= last:
                out.append((key[0], t, price, size, 1, "late"))
                continue
            day = str(t.date())
            if n and day != session:
                out.append((key[0], start, close, volume, n, "partial"))
                volume, n = 0.0, 0
            if not n:
                start, session = t, day
            last, close, volume, n = t, price, volume + size, n + 1
            if volume >= target:
                out.append((key[0], start, close, volume, n, "bar"))
                volume, n = 0.0, 0
        state.update((last, start, close, volume, n, session))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in EVENT.split(", ")])

    return ticks.withWatermark(TIME, delay).groupBy(KEY).applyInPandasWithState(step, EVENT, _STATE, "append", GroupStateTimeout.NoTimeout)


def collect_stream(df: DataFrame, name: str, checkpoint: str | None = None, path: str | None = None) -> DataFrame:
    """Runs a stream over what is there, into a table in the shared folder that is read back."""
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    writer = df.writeStream.format("parquet").queryName(name).outputMode("append").trigger(availableNow=True).option("path", path)
    writer.option("checkpointLocation", checkpoint or fresh_path(spark, "stream")).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def arrivals(ticks: DataFrame, path: str) -> int:
    """Stores ticks under path, dealt by time into a number of slices that is returned; equal times share one (column arrival)."""
    at, n = F.unix_micros(TIME), ticks.count()
    count = max(min(ARRIVALS, math.ceil(n / LEAST_TICKS)), math.ceil(n / MOST_TICKS), 1)
    shares = [F.lit(k / count) for k in range(1, count)]
    cuts = ticks.agg(F.percentile_approx(at, F.array(*shares), F.lit(max(10_000, 100 * count)))).first()[0] if shares else None
    before = F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda x: x < at)) if cuts else F.lit(0)
    ticks.withColumn("arrival", F.coalesce(before, F.lit(0))).write.partitionBy("arrival").parquet(path)
    return count


def replay(ticks: DataFrame, job: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """What the stream job makes of ticks that arrive in the order of time: after each arrival it runs on from its checkpoint over what
    is new. Many tasks write an arrival, and their number doesn't grow with the tape until arrivals are full."""
    spark = ticks.sparkSession
    tape, path, checkpoint, out = (fresh_path(spark, x) for x in ("tape", "ticks", "ck", name))
    for k in range(arrivals(ticks, tape)):
        spark.read.schema(f"{TICK}, arrival int").parquet(tape).where(F.col("arrival") == k).drop("arrival").write.mode("append").parquet(path)
        done = collect_stream(job(tick_stream(spark, path, None)), name, checkpoint, out)
    return done


def closed_batch(bars: DataFrame, length_seconds: int, delay_seconds: int = 20) -> DataFrame:
    """Bars of the batch form that a stream over the same rows has closed too."""
    return bars.where(F.unix_seconds(TIME) + length_seconds <= bars.agg(F.max(F.unix_seconds(TIME))).first()[0] - delay_seconds)


