"""Forward mutation: bars behind a cut are rewritten, everything is worked out anew, and nothing up to the cut may move."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.operators import features as X
from barloom.operators import folds as FO
from barloom.sources.bars import KEY, TIME, stored

PRICES, SIZES = ("open", "high", "low", "close", "bid", "ask"), ("volume", "bid_size", "ask_size")
OBSERVED = ["obs_return", "obs_abs_return", "obs_log_vol", "obs_log_volume", "obs_spread", "obs_trend"]
#: the share of the bars up to a cut that fits its components
FITTED = 0.6
c = F.col


def cut_points(bars: DataFrame, samples: int = 4, first: float = 0.5) -> DataFrame:
    """(instrument, cut, at): bars of each instrument at even shares of its history, the earliest at `first`."""
    shares = [first + (0.95 - first) * k / max(samples - 1, 1) for k in range(samples)]
    times = bars.groupBy(KEY).agg(F.percentile_approx(F.unix_micros(TIME), F.array(*[F.lit(s) for s in shares]), F.lit(100_000)).alias("t"))
    return times.select(KEY, F.posexplode("t").alias("cut", "micros")).select(KEY, "cut", F.timestamp_micros("micros").alias("at"))


def mutated(bars: DataFrame, cuts: DataFrame) -> DataFrame:
    """Both copies of each instrument's bars for each cut, as (instrument#cut#copy): copy 0 as it is, copy 1 with another path and
    other sizes behind the cut. The path is a function of the bar, so that a task that is repeated makes the same."""
    both = bars.join(cuts, KEY).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    noise = F.pmod(F.xxhash64(KEY, TIME, "cut"), F.lit(2001)) / 1000.0 - 1.0
    later = (c("copy") == 1) & (c(TIME) > c("at"))
    change = {p: F.when(later, c(p) * (1.37 + 0.01 * noise)).otherwise(c(p)) for p in PRICES} | {s: F.when(later, c(s) * (2.0 + 0.1 * noise)).otherwise(c(s)) for s in SIZES}
    out = both.withColumns(change).withColumns({"_instrument": c(KEY), KEY: F.concat_ws("#", KEY, c("cut").cast("string"), c("copy").cast("string"))})
    return out


def components(df: DataFrame) -> DataFrame:
    """instrument, timestamp, the filter's features and the probabilities of hidden states, both fitted on the first bars up to `at`."""
    filtered, states = [f"kalman_{n}" for n in FO.KALMAN_FEATURES], [f"state_{k}" for k in range(3)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(TIME)
        known = int((pdf[TIME] <= pdf["at"]).sum() * FITTED)
        y, sigma, seen = pdf["log_close"].to_numpy(float), pdf["sigma_h"].to_numpy(float), pdf[OBSERVED].to_numpy(float)
        base = max(float(np.nanvar(np.diff(y[:known]))), 1e-12)
        v, r = max(FO.KALMAN_GRID, key=lambda g: FO.kalman(y[:known], base, base * g[0], base * g[1])[1])
        made = FO.kalman_features(y, sigma, base, base * v, base * r)
        p = FO.GaussianHMM().fit(seen[:known]).filter(seen)
        out = pd.DataFrame({KEY: pdf[KEY].to_numpy(), TIME: pdf[TIME].to_numpy(), **made, **{s: p[:, k] for k, s in enumerate(states)}})
        return out.replace([np.inf, -np.inf], np.nan)

    schema = f"{KEY} string, {TIME} timestamp, " + ", ".join(f"{n} double" for n in filtered + states)
    return X.hmm_observations(df).select(KEY, TIME, "at", "log_close", "sigma_h", *OBSERVED).groupBy(KEY).applyInPandas(run, schema)


def feature_matrix(bars: DataFrame) -> tuple[DataFrame, list[str]]:
    """All features of bars (with `at`, up to which components may be fitted) and their names."""
    df = X.with_returns(bars)
    plain = X.time_of_session(X.vpin(X.ofi_features(X.regime_columns(X.volume_features(X.fractional_volatility(X.volatility_features(X.return_features(df), range_z=False)))))))
    fractional, fitted = X.fractional_features(df.select(KEY, TIME, "log_close")).drop("log_close"), components(df)
    out = plain.join(fractional, [KEY, TIME]).join(fitted, [KEY, TIME])
    given = {*bars.columns, "log_close", "r"}
    return out, [n for n, kind in out.dtypes if n not in given and kind == "double"]


def forward_mutation(bars: DataFrame, features: Callable[[DataFrame], tuple[DataFrame, list[str]]] = feature_matrix, samples: int = 4) -> DataFrame:
    """(instrument, cut, feature, compared, changed, moved): how many rows up to each cut were compared and how many differ in any
    bit, and how many rows behind it moved (a mutation that moves nothing proves nothing). A task for each (instrument, cut, copy)."""
    both = stored(mutated(bars, cut_points(bars, samples)), name="mutated")
    out, names = features(both)
    # the window sums of one copy add the same bars as the other's, in the same order
    of = lambda n, k: F.max(F.when(c("copy") == k, F.struct(c(n)))).alias(f"{n}_{k}")
    pairs = out.groupBy(c("_instrument").alias("_i"), "cut", TIME, (c(TIME) <= c("at")).alias("early")).agg(*[of(n, k) for n in names for k in (0, 1)])
    same = {n: c(f"{n}_0").eqNullSafe(c(f"{n}_1")) for n in names}
    sums = pairs.groupBy(c("_i").alias(KEY), "cut").agg(F.count_if("early").alias("compared"), *[F.count_if(c("early") & ~same[n]).alias(f"{n}_c") for n in names], *[F.count_if(~c("early") & ~same[n]).alias(f"{n}_m") for n in names])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), c(f"{n}_c").alias("changed"), c(f"{n}_m").alias("moved")) for n in names]))
    return sums.select(KEY, "cut", "compared", each.alias("f")).select(KEY, "cut", "f.feature", "compared", "f.changed", "f.moved")


def leaking(bars: DataFrame) -> tuple[DataFrame, list[str]]:
    """A planted leak for tests of the check: the next bar's open."""
    w = Window.partitionBy(KEY).orderBy(TIME)
    return bars.withColumns({"leak": F.lead("open", 1).over(w) / c("close"), "honest": c("close") / F.lag("close", 1).over(w)}), ["leak", "honest"]
