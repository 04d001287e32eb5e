"""Model versions in a registry table, read as of each bar: the same expressions over a batch and over a stream.

A version is a row of numbers, so a bar's forecast is a column expression: the version that was in force when the bar closed comes from
an equi-join with the times of each instrument's versions, its numbers from one with the registry, and nothing is broadcast by hand. A
version that is published at a bar is in force from the bar after it; before the first one nothing is forecast."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.windows import let
from barloom.operators import models as MO
from barloom.operators import retraining as R
from barloom.operators import training as T
from barloom.sources.bars import KEY, TIME

INPUTS = T.BASELINE
VERSIONS = f"{KEY} string, version int, published timestamp, mean array<double>, scale array<double>, w array<double>, base double, up array<double>, gx array<double>, gy array<double>, slope double"
c = F.col


def corners(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The points where a map of straight lines bends, and its ends: a level needs its two ends only, and the map stays the same. An
    isotonic fit has as many points as calibration rows, but few levels, and each bar searches them."""
    flat = np.zeros(len(x), bool)
    flat[1:-1] = (y[1:-1] == y[:-2]) & (y[1:-1] == y[2:])
    return x[~flat], y[~flat]


def fitted_versions(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """VERSIONS of each window that has rows enough: fitted on the first of its rows, calibrated on its last quarter, published at the
    bar before the window deals. A task for each (instrument, window)."""
    names = [x.split()[0] for x in VERSIONS.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar")
        own, rel, ok = pdf.iloc[0], (pdf["row"] - pdf["first"]).to_numpy(), pdf["ok"].to_numpy(bool)
        train = np.flatnonzero(ok & (rel >= 0) & (rel < own["train_end"]))
        cut = int(len(train) * (1 - T.INNER))
        fit, cal = train[: cut - T.PURGE], train[cut + T.PURGE :]
        x, y = pdf[INPUTS].to_numpy(float), pdf["y_norm"].to_numpy(float)
        pair = T.Pair(x[fit], y[fit])
        g = MO.Calibrator().fit(pair.predict(x[cal])[0], y[cal])
        row = (own[KEY], int(own["window"]), own["published"], pair.m.mean, pair.m.scale, pair.m.w, pair.m.base, pair.w, *corners(g.x, g.y), g.slope)
        return pd.DataFrame([row], columns=names)

    parts = R.layout(windows).select(*R.AT, "first", F.lit(1).alias("part"), c("m").alias("train_end"), c("m").alias("start"), c("m").alias("end"), c("m").alias("d_end"), (c("oos_start") - 1).alias("_at"))
    at = rows.where("ok").select(KEY, c("row").alias("_at"), c(TIME).alias("published"))
    return R.task_bars(rows, parts.join(at, [KEY, "_at"]), ["published"]).groupBy(*R.AT, "part").applyInPandas(run, VERSIONS)


def dotted(x: Column, w: Column) -> Column:
    return F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def interpolated(a: Column, x: Column, y: Column, slope: Column) -> Column:
    """The calibrator's map: straight lines between its points, flat beyond them; slope * a where it has none. 0 stays 0."""
    at = lambda v, i: F.get(v, i)

    def line(k: Column) -> Column:
        inner = at(y, k - 1) + (a - at(x, k - 1)) / (at(x, k) - at(x, k - 1)) * (at(y, k) - at(y, k - 1))
        return F.when(k == 0, at(y, F.lit(0))).when(k == F.size(x), at(y, k - 1)).otherwise(inner)

    met = let(F.size(F.filter(x, lambda v: v <= a)), line)
    return F.when(a.isNull() | (a == 0), 0.0).otherwise(F.when(F.size(x) == 0, slope * a).otherwise(met))


def forecast_as_of(bars: DataFrame, versions: DataFrame) -> DataFrame:
    """bars (with INPUTS and sigma, batch or stream) with version and er by the version in force; null and 0 before the first. What a
    row's search compares with each point is worked out once for the row."""
    fields = [n.split()[0] for n in VERSIONS.split(", ") if n.split()[0] not in (KEY, "published", "version")]
    times = versions.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("published", "version"))).alias("_times"))  # a row an instrument
    out = bars.join(times, KEY, "left")
    out = out.withColumn("version", F.try_element_at(F.filter("_times", lambda v: v["published"] < c(TIME)), F.lit(-1))["version"])
    out = out.drop("_times").join(versions.select(KEY, "version", F.struct(*fields).alias("_v")), [KEY, "version"], "left")

    def combined(z: Column) -> Column:
        logit = dotted(z, F.slice(c("_v.up"), 2, len(INPUTS))) + F.get(c("_v.up"), F.lit(0))
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit))))
        agreed = lambda m, p: F.when(F.signum(m) == F.signum(p - 0.5), m * F.abs(2 * p - 1)).otherwise(0.0)
        return let(dotted(z, c("_v.w")) + c("_v.base"), lambda m: let(p, lambda p: agreed(m, p)))

    x = F.array(*[c(n) for n in INPUTS])
    z = F.zip_with(F.zip_with(x, c("_v.mean"), lambda a, b: a - b), c("_v.scale"), lambda a, b: a / b)
    e = let(let(z, combined), lambda a: interpolated(a, c("_v.gx"), c("_v.gy"), c("_v.slope")))
    er = F.when(c("version").isNotNull(), F.coalesce(e * c("sigma") * math.sqrt(T.HORIZON), F.lit(0.0))).otherwise(0.0)
    return out.withColumn("er", er).select(*bars.columns, *[n for n in ("version", "er") if n not in bars.columns])
