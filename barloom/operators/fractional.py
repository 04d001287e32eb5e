"""Fractional differencing: kernels, transforms, unit-root tests, choice of the order."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.windows import convolve
from barloom.operators.chunks import map_chunks
from barloom.sources.bars import KEY, TIME

THRESHOLD, RUN, MAX_LAGS = 1e-5, 10, 500


@lru_cache(maxsize=256)
def weights(d: float, threshold: float = THRESHOLD, run: int = RUN, max_lags: int = MAX_LAGS) -> tuple[float, ...]:
    """Grünwald-Letnikov weights 1, -d, ...; they end after `run` small terms in a row, or at max_lags."""
    if not 0 <= d <= 1:
        raise ValueError("the order must be between 0 and 1")
    out, small = [1.0], 0
    for k in range(1, max_lags + 1):
        out.append(-out[-1] * (d - k + 1) / k)
        small = small + 1 if abs(out[-1]) < threshold else 0
        if small == run:
            break
    return tuple(out)


def kernel_length(d: float, **kw) -> int:
    return len(weights(d, **kw)) - 1


def weight_closed_form(d: float, k: int) -> float:
    """(-1)^k times the binomial coefficient of d over k."""
    out = 1.0
    for j in range(k):
        out *= (d - j) / (j + 1)
    return (-1) ** k * out


def transform(x: str | Column, d: float, **kw) -> Column:
    """Causal convolution with the kernel of order d, null until it is full."""
    return convolve(x, list(weights(d, **kw)))


def transformed(df: DataFrame, x: str, orders: dict[str, float], keep: tuple[str, ...] = ()) -> DataFrame:
    """instrument, timestamp, x, the columns keep, and x at each order (column name: order), in one Arrow pass over chunks."""
    return map_chunks(df, x, lambda v: {n: np_transform(v, d) for n, d in orders.items()}, list(orders), MAX_LAGS, keep=keep)


def latest(bars: DataFrame, x: str, d: float) -> DataFrame:
    """The newest transformed value of each instrument, from the last kernel length of rows only."""
    w = Window.partitionBy(KEY).orderBy(F.col(TIME).desc())
    taps = weights(d)
    rows = bars.select(KEY, TIME, F.col(x).alias("x"), (F.row_number().over(w) - 1).alias("k")).where(F.col("k") < len(taps))
    tap = F.get(F.array(*[F.lit(t) for t in taps]), F.col("k"))
    out = rows.groupBy(KEY).agg(F.max(TIME).alias(TIME), F.sum(F.col("x") * tap).alias("value"), F.count("x").alias("n"))
    return out.select(KEY, TIME, F.when(F.col("n") == len(taps), F.col("value")).alias("value"))


def np_transform(x: np.ndarray, d: float) -> np.ndarray:
    taps = np.array(weights(d))
    out = np.full(len(x), np.nan)
    if len(x) >= len(taps):
        out[len(taps) - 1 :] = np.convolve(x, taps, "valid")
    return out


def _ols(y: np.ndarray, x: np.ndarray):
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    resid = y - x @ beta
    return beta, resid


def nested_residuals(y: np.ndarray, m: np.ndarray, least: int) -> list[float]:
    """Residual sums of squares of y on the first `least` columns of m, on one more, and so on up to all: from one orthogonal
    decomposition of m beside y, or, where columns depend on each other, from a fit of each."""
    if len(m) > m.shape[1]:
        r = np.linalg.qr(np.column_stack([m, y]), mode="r")
        diagonal, scale = np.abs(np.diag(r)[:-1]), np.linalg.norm(m, axis=0)
        if (diagonal > 1e-9 * scale).all():
            tail = np.cumsum(r[::-1, -1] ** 2)[::-1]
            return [float(tail[k]) for k in range(least, m.shape[1] + 1)]
    fits = [_ols(y, m[:, :k])[1] for k in range(least, m.shape[1] + 1)]
    return [float(e @ e) for e in fits]


#: rows that are decomposed at once
BLOCK = 8192


def folded(rows: Callable[[int, int], np.ndarray], start: int, stop: int) -> np.ndarray:
    """No more rows than columns, with the sums of squares and products of rows(start, stop): least squares on them have the same
    coefficients and residual sums. A block is decomposed together with what the blocks before it left."""
    few = None
    for a in range(start, stop, BLOCK):
        block = rows(a, min(a + BLOCK, stop))
        few = block if few is None else np.vstack([few, block])
        if len(few) > few.shape[1]:
            few = np.linalg.qr(few, mode="r")
    return few


#: where the approximation of the p-value ends: left of it 0, right of it 1
TAU_LEAST, TAU_MOST = -18.83, 2.74


def adf(x: np.ndarray, max_lag: int = 20) -> tuple[float, float]:
    """Augmented Dickey-Fuller statistic with a constant, lags by AIC on a common sample, and its approximate p-value."""
    x = np.asarray(x, float)
    dx = np.diff(x)
    max_lag = min(max_lag, len(dx) // 2 - 2)
    if max_lag < 0 or np.ptp(x) == 0:
        return math.nan, math.nan
    def design(lags: int, start: int, stop: int) -> np.ndarray:
        """A constant, the level, `lags` lagged differences and the difference itself, of each of the rows."""
        return np.column_stack([np.ones(stop - start), x[start:stop], *[dx[start - j : stop - j] for j in range(1, lags + 1)], dx[start:stop]])
    few, n = folded(lambda a, b: design(max_lag, a, b), max_lag, len(dx)), len(dx) - max_lag
    best = None
    for lags, rss in enumerate(nested_residuals(few[:, -1], few[:, :-1], 2)):
        aic = n * math.log(max(rss / n, 1e-300)) + 2 * (2 + lags)
        if best is None or aic < best[0]:
            best = (aic, lags)
    lags, n = best[1], len(dx) - best[1]
    few = np.vstack([few[:, [*range(2 + lags), -1]], design(lags, lags, max_lag)])
    m = few[:, :-1]
    beta, r = _ols(few[:, -1], m)
    cov = np.linalg.pinv(m.T @ m) * (r @ r / max(n - m.shape[1], 1))
    tau = beta[1] / math.sqrt(max(cov[1, 1], 1e-300))
    if not TAU_LEAST <= tau <= TAU_MOST:
        return tau, 0.0 if tau < TAU_LEAST else 1.0
    z = 2.1659 + 1.4412 * tau + 0.038269 * tau**2 if tau <= -1.61 else 1.7339 + 0.93202 * tau - 0.12745 * tau**2 - 0.010368 * tau**3
    return tau, 0.5 * (1 + math.erf(z / math.sqrt(2)))


def kpss(x: np.ndarray) -> tuple[float, float]:
    """KPSS level statistic with automatic bandwidth, and its p-value between 0.01 and 0.10."""
    x = np.asarray(x, float)
    n = len(x)
    e = x - x.mean()
    if n < 10 or np.ptp(x) == 0:
        return math.nan, math.nan
    lags = int(n ** (2 / 9))
    s0, s1 = e @ e / n, 0.0
    for j in range(1, lags + 1):
        c = 2 * (e[j:] @ e[:-j]) / n
        s0 += c
        s1 += j * c
    gamma = 1.1447 * ((s1 / s0) ** 2) ** (1 / 3)
    bandwidth = min(n - 1, int(gamma * n ** (1 / 3)))
    s = e @ e / n + sum(2 * (1 - j / (bandwidth + 1)) * (e[j:] @ e[:-j]) / n for j in range(1, bandwidth + 1))
    stat = float((np.cumsum(e) ** 2).sum() / (n * n * s))
    return stat, float(np.interp(stat, [0.347, 0.463, 0.574, 0.739], [0.10, 0.05, 0.025, 0.01]))


#: observations that a unit-root test needs
LEAST = 50
CANDIDATES = tuple(round(0.05 * k, 2) for k in range(1, 20))
EVALUATION = "instrument string, d double, adf double, p_adf double, kpss double, p_kpss double, corr double, n_obs long, kernel int"


def evaluate_orders(bars: DataFrame, candidates: tuple[float, ...] = CANDIDATES, x: str = "log_close", least: int = LEAST) -> DataFrame:
    """Stationarity tests of each candidate order, a task for each (instrument, order)."""
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        d, inst = float(pdf["d"].iloc[0]), pdf[KEY].iloc[0]
        v = pdf.sort_values(TIME)["x"].to_numpy(float)
        f = np_transform(v, d)
        ok = np.isfinite(f)
        a, pa, k, pk, c = math.nan, math.nan, math.nan, math.nan, math.nan
        if ok.sum() >= least and np.ptp(f[ok]) > 0:
            (a, pa), (k, pk) = adf(f[ok]), kpss(f[ok])
            c = float(np.corrcoef(f[ok], v[ok])[0, 1])
        return pd.DataFrame([[inst, d, a, pa, k, pk, c, int(ok.sum()), kernel_length(d)]],
            columns=["instrument", "d", "adf", "p_adf", "kpss", "p_kpss", "corr", "n_obs", "kernel"])

    grid = F.explode(F.array(*[F.lit(d) for d in candidates]))
    return bars.select(KEY, TIME, F.col(x).alias("x"), grid.alias("d")).groupBy(KEY, "d").applyInPandas(one, EVALUATION)


def choose_order(evaluated: DataFrame, p_adf: float = 0.05, p_kpss: float = 0.05) -> DataFrame:
    """The smallest acceptable order of each instrument; without one, that of the smallest (statistic, order)."""
    good = (F.col("p_adf") < p_adf) & (F.col("p_kpss") > p_kpss)
    finite = evaluated.where(F.col("adf").isNotNull() & ~F.isnan("adf")).withColumn("acceptable", good)
    order = F.when(F.col("acceptable"), F.struct(F.lit(0).alias("a"), F.lit(0.0).alias("b"),
        F.col("d").alias("c"))).otherwise(F.struct(F.lit(1).alias("a"), F.col("adf").alias("b"), F.col("d").alias("c")))
    return finite.groupBy(KEY).agg(F.min_by(F.struct("d", "acceptable"), order).alias("r")).select(KEY, "r.d", "r.acceptable")
