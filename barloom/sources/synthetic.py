"""Seeded synthetic bars: fractional noise, regimes, correlated instruments. Small series come from the driver's generator, so a
seed always gives the same bars; a data source of its own lets Spark generate many instruments in parallel."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from barloom.sources.calendar import holidays

SCHEMA = "instrument string, timestamp timestamp, open double, high double, low double, close double, volume double, bid double, ask double, bid_size double, ask_size double, regime int"


def fractional_noise(n: int, d: float, rng: np.random.Generator, burn: int = 800, most: int = 1000) -> np.ndarray:
    """Unit-variance noise with long memory: white noise through the kernel of order -d."""
    k = np.arange(1, most)
    taps = np.concatenate([[1.0], np.cumprod((k - 1 + d) / k)])
    x = np.convolve(rng.standard_normal(n + burn), taps)[burn : burn + n]
    return x / max(x.std(), 1e-12)


def regimes(n: int, rng: np.random.Generator, mean_bars: float = 200.0, weights=(0.4, 0.25, 0.15, 0.1, 0.1)) -> np.ndarray:
    """Piecewise-constant regime ids with geometric durations."""
    ids: list[np.ndarray] = []
    size = 0
    while size < n:
        length = int(rng.geometric(1 / mean_bars))
        ids.append(np.full(length, rng.choice(len(weights), p=np.array(weights) / sum(weights))))
        size += length
    return np.concatenate(ids)[:n]


def session_starts(n: int, start: dt.date = dt.date(2020, 1, 2), bars_per_day: int = 13) -> list[dt.datetime]:
    """UTC bar starts of regular sessions (09:30 local taken as 14:30 UTC), without holidays."""
    out: list[dt.datetime] = []
    day, closed = start, {}
    while len(out) < n:
        closed.setdefault(day.year, set(holidays(day.year)))
        if day.weekday() < 5 and day not in closed[day.year]:
            first = dt.datetime(day.year, day.month, day.day, 14, 30)
            out += [first + dt.timedelta(minutes=30 * k) for k in range(bars_per_day)]
        day += dt.timedelta(days=1)
    return out[:n]


def market(n: int, symbols=("SPY", "QQQ"), seed: int = 0, memory: float = 0.4, base_vol: float = 0.0025, beta: float = 0.4) -> list[tuple]:
    """Rows of several instruments with a common factor, a planted one-bar lead, regimes, jumps and quotes with sizes."""
    rng = np.random.default_rng(seed)
    times, state = session_starts(n), regimes(n, rng)
    scale = np.array([0.7, 1.0, 1.5, 2.5, 4.0])[state] * base_vol
    common = fractional_noise(n, memory, rng) * scale
    out: list[tuple] = []
    for s in symbols:
        own = rng.standard_t(5, n) * scale * 0.6
        jump = np.where(rng.random(n) < 0.002, rng.normal(0, 8, n), 0.0) * scale
        r = common + own + jump + beta * np.r_[0.0, common[:-1]] * (s != symbols[0])
        close = 400 * np.exp(np.cumsum(r))
        open_ = np.r_[400.0, close[:-1]] * np.exp(rng.normal(0, 0.1, n) * scale)
        top, low = np.maximum(open_, close) * (1 + np.abs(rng.normal(0, 0.3, n)) * scale), np.minimum(open_, close) * (1 - np.abs(rng.normal(0, 0.3, n)) * scale)
        volume, spread = rng.lognormal(11, 0.4, n), close * 1e-4
        sizes = rng.integers(1, 40, (2, n)) * 100.0
        out += list(zip([s] * n, times, open_.tolist(), top.tolist(), low.tolist(), close.tolist(), volume.tolist(), (close - spread / 2).tolist(), (close + spread / 2).tolist(), sizes[0].tolist(), sizes[1].tolist(), state.tolist(), strict=True))
    return out


def market_frame(spark: SparkSession, n: int, **kw) -> DataFrame:
    return spark.createDataFrame(market(n, **kw), SCHEMA)


class SyntheticMarket(DataSource):
    """spark.read.format("synthetic_market").option("paths", k).option("bars", n): one independent path a partition."""

    @classmethod
    def name(cls) -> str:
        return "synthetic_market"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(int(self.options.get("paths", "4")), int(self.options.get("bars", "1000")), int(self.options.get("seed", "0")))


class _Reader(DataSourceReader):
    def __init__(self, paths: int, bars: int, seed: int):
        self.paths, self.bars, self.seed = paths, bars, seed

    def partitions(self):
        return [InputPartition(k) for k in range(self.paths)]

    def read(self, partition):
        yield from market(self.bars, (f"P{partition.value}",), seed=self.seed * 1_000_003 + partition.value)
