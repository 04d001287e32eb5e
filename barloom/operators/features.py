"""Feature families as column expressions on ordered bars. Each function adds columns; nothing is joined."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from barloom.functions.windows import EPS, corr_with_index, ewma_weights, lag, np_reference_sigma, np_robust_z, np_rolling_mean, np_rolling_std, robust_z, rolling_std, safe_corr
from barloom.operators.chunks import CHUNK, map_chunks
from barloom.operators.fractional import MAX_LAGS, np_transform
from barloom.sources.bars import KEY, TIME, by_time, trailing

LAGS, VOLS = (1, 2, 4, 8, 16), (10, 50, 200)


def with_returns(bars: DataFrame) -> DataFrame:
    """log_close, r (one-bar log return), sigma_h (50 bars), range_rel."""
    out = bars.withColumn("log_close", F.log("close"))
    out = out.withColumn("r", F.col("log_close") - lag("log_close", 1))
    return out.withColumns({"sigma_h": rolling_std("r", 50), "range_rel": (F.col("high") - F.col("low")) / F.col("close")})


def return_features(df: DataFrame, lags=LAGS) -> DataFrame:
    return df.withColumns({f"return_{k}": (F.col("log_close") - lag("log_close",
        k)) / (F.col("sigma_h") * math.sqrt(k) + EPS) for k in lags})


def volatility_features(df: DataFrame, vols=VOLS, range_z: bool = True) -> DataFrame:
    s = {n: rolling_std("r", n) for n in vols}
    out = df.withColumns({f"vol_{n}": F.log(c + EPS) for n, c in s.items()})
    return out.withColumns({"vol_ratio_short": s[10] / (s[50] + EPS), "vol_ratio_long": s[50] / (s[200] + EPS),
        **({"range_z": robust_z("range_rel", 250)} if range_z else {}),
                            "close_location": (2 * F.col("close") - F.col("high") - F.col("low")) / (F.col("high") - F.col("low") + EPS)})


#: bars of the reference of sigma_h, and how many bars its columns look back on: those, and the returns of the first sigma_h
REFERENCE = 390
ROLLING_LOOKBACK = REFERENCE - 1 + 50
ROLLING = ["r", "sigma_h", "m20", "s20", "s200", "sigma_ref", "return_1", "return_4"]


def rolling_arrays(log_close: np.ndarray) -> dict[str, np.ndarray]:
    """What training rows need of the windows over prices in time order, equal to the window functions."""
    r = log_close - _ago(log_close, 1)
    sigma = np_rolling_std(r, 50)
    moves = {f"return_{k}": (log_close - _ago(log_close, k)) / (sigma * math.sqrt(k) + EPS) for k in (1, 4)}
    return {"r": r, "sigma_h": sigma, "m20": np_rolling_mean(r, 20), "s20": np_rolling_std(r, 20), "s200": np_rolling_std(r, 200),
        "sigma_ref": np_reference_sigma(sigma, REFERENCE)} | moves


def rolling_columns(bars: DataFrame, keep: tuple[str, ...], chunk: int = CHUNK) -> DataFrame:
    """instrument, timestamp, log_close, keep and the rolling columns, in one Arrow pass over chunks of each instrument."""
    return map_chunks(bars.withColumn("log_close", F.log("close")), "log_close", rolling_arrays, ROLLING, ROLLING_LOOKBACK, chunk, keep)


def fractional_volatility(df: DataFrame, decay: float = 0.94, window: int = 450, d: float = 0.4) -> DataFrame:
    """df with fractional_volatility and range_z, in an Arrow pass for each key of df (a chunk, within in_chunks)."""
    taps = np.array(ewma_weights(decay, window))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(TIME)
        r, value = pdf["r"].to_numpy(float), np.full(len(pdf), np.nan)
        if len(r) >= window:
            value[window - 1 :] = np.log(np.convolve(r * r, taps, "valid") + EPS)
        return pdf.assign(fractional_volatility=np_transform(value, d), range_z=np_robust_z(pdf["range_rel"].to_numpy(float), 250))

    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in ("fractional_volatility", "range_z")]])
    return df.groupBy(KEY).applyInPandas(run, schema)


def volume_features(df: DataFrame, window: int = 50) -> DataFrame:
    out = df.withColumn("_v", F.log1p("volume"))
    return out.withColumns({"volume_z": robust_z("_v", window), "volume_change": F.col("_v") - lag("_v", 1)}).drop("_v")


FRACTIONAL = {"adaptive": 0.35, "025": 0.25, "050": 0.50, "075": 0.75}
FRACTIONAL_NAMES = [f"fd_{n}{s}" for n in FRACTIONAL for s in ("", "_z")] + [f"fd_slope_{k}_{n}" for n in FRACTIONAL for k in (1, 4)]
FRACTIONAL_NAMES += [f"fd_curvature_{n}" for n in FRACTIONAL] + ["fd_cross_sm", "fd_cross_mf", "fd_cross_sf", "fractional_state"]


def _ago(x: np.ndarray, k: int) -> np.ndarray:
    return np.r_[np.full(min(k, len(x)), np.nan), x[:-k]]


def fractional_arrays(log_close: np.ndarray, orders: dict[str, float] = FRACTIONAL, window: int = 250) -> dict[str, np.ndarray]:
    """Levels, robust z, slopes and curvature of each order, and differences across scales, of prices in time order."""
    out = {}
    for n, d in orders.items():
        x = out[f"fd_{n}"] = np_transform(log_close, d)
        out |= {f"fd_{n}_z": np_robust_z(x, window), f"fd_slope_1_{n}": x - _ago(x, 1), f"fd_slope_4_{n}": x - _ago(x, 4),
            f"fd_curvature_{n}": x - 2 * _ago(x, 1) + _ago(x, 2)}
    z = {n: out[f"fd_{n}_z"] for n in orders}
    return out | {"fd_cross_sm": z["025"] - z["050"], "fd_cross_mf": z["050"] - z["075"], "fd_cross_sf": z["025"] - z["075"],
        "fractional_state": np.abs(z["025"]) / (np.abs(z["075"]) + 0.1)}


def fractional_features(df: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """instrument, timestamp, log_close and the fractional features, in one Arrow pass over chunks of each instrument."""
    return map_chunks(df, "log_close", fractional_arrays, FRACTIONAL_NAMES, MAX_LAGS + 250 + 4, chunk)


def regime_columns(df: DataFrame) -> DataFrame:
    return df.withColumns({"trend_state": corr_with_index("log_close", 50),
        "volatility_state": rolling_std("r", 20) / (rolling_std("r", 200) + EPS)})


def order_flow(df: DataFrame) -> DataFrame:
    """Order-flow imbalance of consecutive quotes; null unless all eight inputs are there."""
    pb, pa, pbs, pas = (lag(c, 1) for c in ("bid", "ask", "bid_size", "ask_size"))
    b, a, bs, az = (F.col(c) for c in ("bid", "ask", "bid_size", "ask_size"))
    e = F.when(b >= pb, bs).otherwise(0.0) - F.when(b <= pb, pbs).otherwise(0.0) - F.when(a <= pa, az).otherwise(0.0) + F.when(a >= pa,
        pas).otherwise(0.0)
    there = pb.isNotNull() & pa.isNotNull() & pbs.isNotNull() & pas.isNotNull() & b.isNotNull() & a.isNotNull() & bs.isNotNull() & az.isNotNull()
    depth = bs + az
    mid = (b + a) / 2
    return df.withColumns({"ofi_raw": F.when(there, e), "ofi_normalized": F.when(there, e / (depth + EPS)),
        "quote_imbalance": (bs - az) / (depth + EPS), "ofi_spread": F.when(mid > 0, (a - b) / mid)})


def ofi_features(df: DataFrame, z: int = 100) -> DataFrame:
    """Order-flow columns that need no recursion; the EMAs come from operators.folds.ema."""
    out = order_flow(df)
    return out.withColumns({"ofi_zscore": robust_z("ofi_normalized", z),
        "ofi_price_divergence": robust_z("ofi_normalized", z) - robust_z("r", z), "ofi_spread_zscore": robust_z("ofi_spread", z)})


def hmm_observations(df: DataFrame) -> DataFrame:
    spread = F.when((F.col("bid") + F.col("ask")) > 0, (F.col("ask") - F.col("bid")) / ((F.col("ask") + F.col("bid")) / 2))
    return df.withColumns({"obs_return": F.col("r"), "obs_abs_return": F.abs("r"), "obs_log_vol": F.log(rolling_std("r", 20) + EPS),
        "obs_log_volume": F.log1p("volume"),
                           "obs_spread": spread, "obs_trend": corr_with_index("log_close", 50)})


def vpin(df: DataFrame, bucket: int = 5, buckets: int = 50) -> DataFrame:
    """Volume toxicity from bulk classification: Phi(r / sigma) of the volume bought; sums over `bucket` bars; every bucket-th sum
    of the window from its oldest bar on. Phi is a rational approximation (error below 1.5e-7), the same in SQL and here."""
    w = bucket * buckets
    buy = normal_cdf(F.col("r") / (F.col("sigma_h") + EPS)) * F.col("volume")
    out = df.withColumn("_imb", buy - (F.col("volume") - buy))
    bars5 = trailing(bucket)
    out = out.withColumns({"_bi": F.when(F.count("_imb").over(bars5) == bucket, F.abs(F.sum("_imb").over(bars5))),
        "_bv": F.when(F.count("volume").over(bars5) == bucket, F.sum("volume").over(bars5))})
    step = lambda c: [F.lag(c, w - 1 - k * bucket).over(by_time()) for k in range(buckets)]
    num, den = sum(step("_bi")[1:], step("_bi")[0]), sum(step("_bv")[1:], step("_bv")[0])
    return out.withColumn("vpin", F.try_divide(num, den)).drop("_imb", "_bi", "_bv")


def normal_cdf(x: Column) -> Column:
    """Abramowitz and Stegun 7.1.26 for erf. Its coefficients."""
    y = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * y)
    erf = 1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * F.exp(-y * y)
    return 0.5 * (1 + F.signum(x) * erf)


def cross_asset(primary: DataFrame, context: dict[str, DataFrame], tolerance_seconds: float = 1800.0) -> DataFrame:
    """Relative returns, correlations and breadth against context instruments, each aligned by a backward as-of join.

    All frames need timestamp, r, r4, log_close and a constant key column "all"."""
    from barloom.operators.asof import asof_join

    out = primary
    for name, other in context.items():
        named = other.select("all", "timestamp", *[F.col(c).alias(f"{name}_{c}") for c in ("r", "r4", "log_close")])
        out = asof_join(out, named, ["all"], [f"{name}_r", f"{name}_r4", f"{name}_log_close"],
            tolerance_seconds=tolerance_seconds).withColumnRenamed("age_s", f"xa_{name}_age_s")
    new: dict[str, Column] = {}
    for n in context:
        r0, o0 = F.coalesce(F.col("r"), F.lit(0.0)), F.coalesce(F.col(f"{n}_r"), F.lit(0.0))
        new |= {f"xa_{n}_rel_return_1": (F.col(f"{n}_r") - F.col("r")) / (F.col("sigma_h") + EPS),
            f"xa_{n}_rel_return_4": (F.col(f"{n}_r4") - F.col("r4")) / (2 * F.col("sigma_h") + EPS),
                f"xa_{n}_corr_short": safe_corr(r0, o0, 20), f"xa_{n}_corr_breakdown": safe_corr(r0, o0, 20) - safe_corr(r0, o0, 200),
                f"xa_{n}_divergence": robust_z(F.col(f"{n}_log_close") - F.col("log_close"), 50)}
    up = sum((F.coalesce((F.col(f"{n}_r") > 0).cast("int"), F.lit(0)) for n in context), F.lit(0)) / float(len(context))
    values = F.array_compact(F.array(*[F.col(f"{n}_r") for n in context]))
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(values).cast("double"), F.lit(0.0))
    var = F.aggregate(F.transform(values, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a,
        x: a + x) / F.nullif(F.size(values).cast("double"), F.lit(0.0))
    return out.withColumns(new).withColumns({"xa_breadth": up, "xa_dispersion": F.sqrt(var) / (F.col("sigma_h") + EPS)})


def regime_state(df: DataFrame, probs: list[str], leave: list[float]) -> DataFrame:
    """Entropy, most likely state, its age (gaps and islands), leave and stress probability of filtered state probabilities."""
    k = len(probs)
    p = F.array(*probs)
    entropy = -sum((F.when(F.col(c) > 0, F.col(c) * F.log(c)).otherwise(0.0) for c in probs), F.lit(0.0)) / math.log(k)
    out = df.withColumns({"regime_entropy": entropy, "regime_most_likely": (F.array_position(p, F.array_max(p)) - 1).cast("int")})
    change = F.coalesce((F.col("regime_most_likely") != lag("regime_most_likely", 1)).cast("int"), F.lit(1))
    out = out.withColumn("_change", change).withColumn("_island", F.sum("_change").over(by_time()))
    age = F.row_number().over(Window.partitionBy(KEY, "_island").orderBy("timestamp")) - 1
    return out.withColumns({"regime_age": age, "regime_transition_prob": F.get(F.array(*[F.lit(x) for x in leave]),
        F.col("regime_most_likely")), "regime_stress_p": F.col(probs[-1])}).drop("_change", "_island")


def time_of_session(df: DataFrame, zone: str = "America/New_York", open_minute: int = 570, session_minutes: int = 390) -> DataFrame:
    local = F.from_utc_timestamp("timestamp", zone)
    m = F.hour(local) * 60 + F.minute(local) - open_minute
    return df.withColumns({"time_sin": F.sin(2 * math.pi * m / session_minutes), "time_cos": F.cos(2 * math.pi * m / session_minutes)})


def required_history(vol_windows=VOLS, z: int = 250, ewma: int = 450, max_lags: int = 500) -> int:
    """Bars that the newest feature row looks back on."""
    return max(max(vol_windows) + 1, z + max_lags + 1, ewma + max_lags + 1 + 1)
