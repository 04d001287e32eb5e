"""Rolling expressions on ordered bars. All are null until their window is full, and where any of its inputs is null."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from barloom.sources.bars import by_time, running, trailing

EPS = 1e-12


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def full(x: str | Column, n: int, value: Column) -> Column:
    """value where the last n rows are there and x isn't null in any of them."""
    return F.when(F.count(_c(x)).over(trailing(n)) == n, value)


def lag(x: str | Column, k: int) -> Column:
    return F.lag(_c(x), k).over(by_time()) if k else _c(x)


def rolling_mean(x, n: int) -> Column:
    return full(x, n, F.avg(_c(x)).over(trailing(n)))


def rolling_std(x, n: int, ddof: int = 0) -> Column:
    return full(x, n, (F.stddev_samp if ddof else F.stddev_pop)(_c(x)).over(trailing(n)))


def rolling_median(x, n: int) -> Column:
    return full(x, n, F.percentile(_c(x), F.lit(0.5)).over(trailing(n)))


def _median_of(values: Column) -> Column:
    """Median of an array without nulls. The array is sorted once: its middle is taken by a slice, then averaged."""
    n = F.size(values)
    middle = F.slice(F.sort_array(values), F.floor((n + 1) / 2).cast("int"), F.when(n % 2 == 0, 2).otherwise(1))
    return F.aggregate(middle, F.lit(0.0), lambda a, x: a + x, lambda a: a / F.when(n % 2 == 0, 2.0).otherwise(1.0))


def rolling_mad(x, n: int) -> Column:
    """Median of the distances from the window's median."""
    values = F.collect_list(_c(x)).over(trailing(n))
    median = F.percentile(_c(x), F.lit(0.5)).over(trailing(n))
    return full(x, n, _median_of(F.zip_with(values, F.array_repeat(median, n), lambda v, m: F.abs(v - m))))


def let(value: Column, body) -> Column:
    """body(value), with value worked out once for a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def robust_z(x, n: int, eps: float = EPS) -> Column:
    """(x - median) / (1.4826 MAD + eps) of the window: one collected frame, sorted twice as plain doubles."""
    values = F.collect_list(_c(x)).over(trailing(n))
    z = let(_median_of(values), lambda m: (_c(x) - m) / (1.4826 * _median_of(F.transform(values, lambda v: F.abs(v - m))) + eps))
    return full(x, n, z)


def safe_corr(a, b, n: int) -> Column:
    """Pearson correlation of the last n rows; null where a variance is 0."""
    w = trailing(n)
    both = F.when(_c(a).isNotNull() & _c(b).isNotNull(), 1)
    value = F.try_divide(F.covar_pop(_c(a), _c(b)).over(w), F.stddev_pop(_c(a)).over(w) * F.stddev_pop(_c(b)).over(w))
    return F.when(F.count(both).over(w) == n, value)


def corr_with_index(x, n: int) -> Column:
    """Correlation of the last n values with their order; 0 where they don't vary. The covariance is updated around running means,
    so it doesn't lose digits where row numbers are large."""
    w = trailing(n)
    spread = ((n * n - 1) / 12.0) ** 0.5
    cross = F.covar_pop(_c(x), F.row_number().over(by_time()).cast("double")).over(w)
    return full(x, n, F.coalesce(F.try_divide(cross, F.stddev_pop(_c(x)).over(w) * spread), F.lit(0.0)))


def np_robust_z(x: np.ndarray, n: int, eps: float = EPS) -> np.ndarray:
    """robust_z of an array in time order, some windows at a time."""
    out = np.full(len(x), np.nan)
    for a in range(0, len(x) - n + 1, 2048):
        v = np.lib.stride_tricks.sliding_window_view(x, n)[a : a + 2048]
        median = np.median(v, axis=1)
        out[a + n - 1 : a + n - 1 + len(v)] = (v[:, -1] - median) / (1.4826 * np.median(np.abs(v - median[:, None]), axis=1) + eps)
    return out


def np_rolling_mean(x: np.ndarray, n: int) -> np.ndarray:
    """rolling_mean of an array in time order; sums run through the window in its order, so no bit differs."""
    out = np.full(len(x), np.nan)
    for a, b in _slices(n - 1, len(x)):
        total = np.zeros(b - a)
        for j in range(a - n + 1, a + 1):
            total += x[j : j + b - a]
        out[a:b] = total / n
    return out


def np_rolling_std(x: np.ndarray, n: int) -> np.ndarray:
    """rolling_std of an array in time order, by the same updates of mean and squares, so no bit differs."""
    out = np.full(len(x), np.nan)
    for a, b in _slices(n - 1, len(x)):
        mean, squares = np.zeros(b - a), np.zeros(b - a)
        for k in range(n):
            delta = x[a - n + 1 + k : b - n + 1 + k] - mean
            step = delta / (k + 1.0)
            mean += step
            squares += delta * (delta - step)
        out[a:b] = np.sqrt(squares / n)
    return out


def np_reference_sigma(x: np.ndarray, n: int) -> np.ndarray:
    """reference_sigma of an array in time order: windows without gaps some at a time, those with gaps one by one."""
    out, gaps = np.full(len(x), np.nan), np.r_[0, np.cumsum(np.isnan(x))]
    whole = np.zeros(len(x), bool)
    if len(x) >= n:
        whole[n - 1 :] = gaps[n:] == gaps[:-n]
        for a, b in _slices(n - 1, len(x), 512):
            v = np.partition(np.lib.stride_tricks.sliding_window_view(x[a - n + 1 : b], n), [(n - 1) // 2, n // 2], axis=1)
            out[a:b] = (v[:, (n - 1) // 2] + v[:, n // 2]) / 2
    for i in np.flatnonzero(~whole):
        v = x[max(i - n + 1, 0) : i + 1]
        v = v[~np.isnan(v)]
        out[i] = np.median(v) if len(v) else np.nan
    return out


def _slices(start: int, stop: int, size: int = 4096) -> list[tuple[int, int]]:
    return [(a, min(a + size, stop)) for a in range(start, stop, size)]


def convolve(x, weights: list[float]) -> Column:
    """Sum of weights[k] * x(t - k), null until all taps are there and where one is null."""
    n = len(weights)
    values = F.collect_list(_c(x)).over(trailing(n))
    taps = F.array(*[F.lit(float(w)) for w in reversed(weights)])
    return full(x, n, F.aggregate(F.zip_with(values, taps, lambda v, w: v * w), F.lit(0.0), lambda a, v: a + v))


def ewma_weights(decay: float, window: int) -> list[float]:
    """Taps of a seeded recursion of finite length: the oldest one carries the whole rest."""
    return [(1 - decay) * decay**k for k in range(window - 1)] + [decay ** (window - 1)]


def ewma_variance(returns, decay: float = 0.94, window: int = 450) -> Column:
    return convolve(_c(returns) * _c(returns), ewma_weights(decay, window))


def reference_sigma(sigma, window: int) -> Column:
    """Trailing median of what is there; while it warms up, of all so far."""
    return F.percentile(_c(sigma), F.lit(0.5)).over(trailing(window))


def rolling_sharpe(returns, window: int, bars_per_year: float) -> Column:
    w = trailing(window)
    return full(returns, window, F.coalesce(F.try_divide(F.avg(_c(returns)).over(w), F.stddev_pop(_c(returns)).over(w)), F.lit(0.0)) * bars_per_year**0.5)


def drawdown(equity, w: WindowSpec | None = None) -> Column:
    return _c(equity) / F.max(_c(equity)).over(w or running()) - 1
