"""Resampling statistics: seeded draws fan out as rows, quantiles come from aggregates."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NORMAL = NormalDist()


def _draws(spark: SparkSession, n: int, kernel, schema: str) -> DataFrame:
    """kernel(draw number) -> tuple, for n draws spread over tasks. Each draw has its own seed, so lost tasks repeat it exactly."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        for b in batches:
            yield pd.DataFrame([kernel(int(k)) for k in b["id"]], columns=names)

    return spark.range(n).mapInPandas(run, schema)


def block_bootstrap(spark: SparkSession, pnl: np.ndarray, per_year: float = 252.0, block: int = 65, n: int = 1000,
    seed: int = 0) -> DataFrame:
    """Circular block bootstrap: sharpe, cagr, total_return, max_drawdown of each draw."""
    return _draws(spark, n, lambda k: block_draw(pnl, k, per_year, block, seed), BLOCK)


BLOCK = "draw long, sharpe double, cagr double, total_return double, max_drawdown double"
ABLATION = "draw long, mean double, median double"
DEALS = "draw long, terminal double, max_drawdown double"


def block_draw(pnl: np.ndarray, k: int, per_year: float = 252.0, block: int = 65, seed: int = 0) -> tuple:
    size = len(pnl)
    rng = np.random.default_rng([seed, k])
    starts = rng.integers(0, size, -(-size // block))
    x = pnl[(starts[:, None] + np.arange(block)).ravel()[:size] % size]
    eq = np.cumprod(1 + x)
    sd = x.std()
    dd = float((1 - eq / np.maximum(np.maximum.accumulate(eq), 1)).max())
    return k, float(x.mean() / sd * math.sqrt(per_year)) if sd > 0 else 0.0, float(max(eq[-1],
        1e-9) ** (per_year / size) - 1), float(eq[-1] - 1), dd


def draws_by_key(rows: DataFrame, value: str, order: str, kernel, schema: str, n: int, parts: int = 8,
    key: str = "instrument") -> DataFrame:
    """kernel(values in order, draw number) -> tuple, for n draws of each key: a task for each key and part of the draws."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x, k, p = pdf[value].to_numpy(float), pdf[key].iloc[0], int(pdf["_part"].iloc[0])
        out = pd.DataFrame([kernel(x, i) for i in range(p, n, parts)], columns=names)
        out.insert(0, key, k)
        return out

    spread = rows.select(key, order, value, F.explode(F.sequence(F.lit(0), F.lit(min(parts, n) - 1))).alias("_part"))
    return spread.groupBy(key, "_part").applyInPandas(run, f"{key} string, {schema}")


def intervals(draws: DataFrame, columns: list[str], confidence: float = 0.95, by: tuple[str, ...] = ()) -> DataFrame:
    lo, hi = (1 - confidence) / 2, (1 + confidence) / 2
    parts = [draws.groupBy(*by).agg(F.lit(c).alias("metric"), F.avg(c).alias("mean"), F.percentile(c, F.lit(lo)).alias("low"),
        F.percentile(c, F.lit(hi)).alias("high")) for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sign_test(values: np.ndarray) -> float:
    """Exact two-sided binomial p-value of the signs."""
    up, n = int((values > 0).sum()), int((values != 0).sum())
    if not n:
        return 1.0
    tail = sum(math.comb(n, k) for k in range(max(up, n - up), n + 1)) / 2**n
    return min(1.0, 2 * tail)


def ablation_draw(deltas: np.ndarray, k: int, seed: int = 0) -> tuple:
    x = np.random.default_rng([seed, k]).choice(deltas, len(deltas))
    return k, float(x.mean()), float(np.median(x))


def ablation_bootstrap(spark: SparkSession, deltas: np.ndarray, n: int = 5000, seed: int = 0) -> DataFrame:
    return _draws(spark, n, lambda k: ablation_draw(deltas, k, seed), ABLATION)


def deals_draw(pnls: np.ndarray, k: int, seed: int = 0) -> tuple:
    eq = np.cumprod(1 + np.random.default_rng([seed, k]).choice(pnls, len(pnls)))
    return k, float(eq[-1]), float((1 - eq / np.maximum(np.maximum.accumulate(eq), 1)).max())


def monte_carlo_deals(spark: SparkSession, pnls: np.ndarray, n: int = 2000, seed: int = 0) -> DataFrame:
    return _draws(spark, n, lambda k: deals_draw(pnls, k, seed), DEALS)


def multiple_testing(sharpe_annual: float, n_bars: int, per_year: float, tests: int) -> dict[str, float]:
    """t, its p-value, the Bonferroni p-value and the Sharpe ratio that would pass at 5 %."""
    years = n_bars / per_year
    t = sharpe_annual * math.sqrt(years)
    p = 2 * (1 - NORMAL.cdf(abs(t)))
    return {"t": t, "p": p, "p_bonferroni": min(1.0, p * tests), "required_sharpe": NORMAL.inv_cdf(1 - 0.025 / tests) / math.sqrt(years)}


def break_even(points: list[tuple[float, float]]) -> float | None:
    """Where a metric crosses 0 along a rising cost level, linearly between points."""
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        if y0 > 0 >= y1:
            return x0 + (x1 - x0) * y0 / (y0 - y1)
    return None


def permuted_exposure(q: np.ndarray, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).permutation(q)
