"""What families of inputs add: refits of every variant in every window, Sharpe differences over windows, and a verdict on each family."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import folds as FO
from barloom.operators import fractional as FR
from barloom.operators import models as MO
from barloom.operators import retraining as R
from barloom.operators import stats as ST
from barloom.operators import training as T
from barloom.operators.metrics import ratio
from barloom.sources.bars import KEY, stored

CORE = {"PRICE": T.FAMILIES["PRICE"]}
OPTIONAL = {"VOLATILITY": T.FAMILIES["VOLATILITY"], "FRACTIONAL": ["frac"], "VOLUME": ["volume_z", "volume_change"], "FLOW": ["ofi_zscore", "quote_imbalance"], "TOXICITY": ["vpin"]}
FAMILIES = CORE | OPTIONAL
EXTRA = [n for f in ("VOLUME", "FLOW", "TOXICITY") for n in FAMILIES[f]]
COLUMNS = [n for names in FAMILIES.values() for n in names]
VARIANTS = {"base": list(CORE), "full": list(FAMILIES)} | {f"base+{f}": [*CORE, f] for f in OPTIONAL} | {f"full-{f}": [g for g in FAMILIES if g != f] for f in OPTIONAL}
#: fixed values: what a family must reach
POSITIVE, DOMINANCE, DRAWS = 0.55, 0.5, 2000
SCENARIOS = {"plain": {}, "delay_1": {"delay": 1}, "cost_2x": {"cost_scale": 2.0}}
c = F.col

FORECASTS = f"{KEY} string, window int, variant string, bar long, e double"


def variant_forecasts(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """FORECASTS of every variant: one light refit each on the window's rows, its last quarter calibrating, and of the full one with a
    family's inputs shuffled after the fit (full~family). A task for each (instrument, window)."""
    names = [x.split()[0] for x in FORECASTS.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar")
        own, rel, ok = pdf.iloc[0], (pdf["row"] - pdf["first"]).to_numpy(), pdf["ok"].to_numpy(bool)
        train, wanted = np.flatnonzero(ok & (rel >= 0) & (rel < own["train_end"])), np.flatnonzero(ok & (rel >= own["start"]) & (rel < own["end"]))
        cut = int(len(train) * (1 - T.INNER))
        fit, cal, close = train[: cut - T.PURGE], train[cut + T.PURGE :], pdf["log_close"].to_numpy(float)
        d = R.order_at(close[: fit[-1] + 2 + T.HORIZON])
        x = np.column_stack([FR.np_transform(close, d) if n == "frac" else pdf[n].to_numpy(float) for n in COLUMNS])
        x, y = np.where(np.isfinite(x), x, 0.0), pdf["y_norm"].to_numpy(float)
        at = lambda families: [COLUMNS.index(n) for f in families for n in FAMILIES[f]]
        made = {}
        for name, families in VARIANTS.items():
            use = at(families)
            pair = T.Pair(x[fit][:, use], y[fit])
            g = MO.Calibrator().fit(pair.predict(x[cal][:, use])[0], y[cal])
            made[name] = g.predict(pair.predict(x[wanted][:, use])[0])
            if name == "full":
                for k, f in enumerate(OPTIONAL):
                    mixed, order = x[wanted].copy(), np.random.default_rng([*own[KEY].encode(), int(own["window"]), k]).permutation(len(wanted))
                    mixed[:, at([f])] = mixed[order][:, at([f])]
                    made[f"full~{f}"] = g.predict(pair.predict(mixed[:, use])[0])
        out = [pd.DataFrame({"variant": v, "bar": pdf["bar"].to_numpy()[wanted], "e": e}) for v, e in made.items()]
        return pd.concat(out).assign(**{KEY: own[KEY], "window": int(own["window"])})[names]

    parts = R.layout(windows).select(*R.AT, "first", F.lit(1).alias("part"), c("m").alias("train_end"), (c("oos_start") - c("first")).alias("start"), (c("oos_end") - c("first")).alias("end"), c("m").alias("d_end"))
    return R.task_bars(rows, parts, [], [*T.BASELINE, *EXTRA]).groupBy(*R.AT, "part").applyInPandas(run, FORECASTS)


SIMULATED = f"{KEY} string, variant string, scenario string, window int, bar long, pnl double, exposure double"


def simulated(made: DataFrame, rows: DataFrame) -> DataFrame:
    """SIMULATED rows of each variant over all windows. Rows are shuffled once; the scenarios are run one after the other in a task."""
    names = [x.split()[0] for x in SIMULATED.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar")
        a = {n: pdf[n].to_numpy(float) for n in FO.SIM_COLUMNS if n != "window"} | {"window": np.zeros(len(pdf))}
        zero = np.zeros(len(pdf))
        a |= {"er": pdf["e"].to_numpy(float) * a["sigma"] * math.sqrt(T.HORIZON), "adverse": zero, "uncertainty": zero}
        out = []
        for name, changes in SCENARIOS.items():
            done = FO.simulate(a, FO.scenario(**changes))[0]
            out.append(pdf[[KEY, "variant", "window", "bar"]].assign(scenario=name, pnl=done["pnl"], exposure=done["exposure"]))
        return pd.concat(out)[names]

    bars = rows.where("ok").select(KEY, "bar", *[n for n in FO.SIM_COLUMNS if n != "window"])
    return made.join(bars, [KEY, "bar"]).groupBy(KEY, "variant").applyInPandas(run, SIMULATED)


def sharpe(pnl: str = "pnl", year: float = 252.0):
    return F.coalesce(ratio(F.avg(pnl), F.stddev_pop(pnl)), F.lit(0.0)) * math.sqrt(year)


def pairs(spark) -> DataFrame:
    """(family, kind, variant, reference): what is compared with what; a row for each family and kind."""
    rows = [(f, k, a, b) for f in OPTIONAL for k, a, b in (("additive", f"base+{f}", "base"), ("marginal", "full", f"full-{f}"))]
    return spark.createDataFrame(rows, "family string, kind string, variant string, reference string")


def compared(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """values (by, variant, value) as (by, family, kind, delta) of all pairs."""
    p = F.broadcast(pairs(values.sparkSession))
    one = values.join(p, "variant").select(*by, "family", "kind", "reference", c(value).alias("_a"))
    return one.join(values.select(*by, c("variant").alias("reference"), c(value).alias("_b")), [*by, "reference"]).select(*by, "family", "kind", (c("_a") - c("_b")).alias("delta"))


def matrix(sims: DataFrame, draws: int = DRAWS) -> DataFrame:
    """For each (instrument, family, kind): the difference of the whole Sharpe ratios, and mean, median, share above 0, dominance and
    bootstrapped interval of the differences in each window."""
    plain = sims.where("scenario = 'plain'")
    by_window = stored(compared(plain.groupBy(KEY, "window", "variant").agg(sharpe().alias("s")), [KEY, "window"], "s"), name="deltas")
    up = F.when(c("delta") > 0, c("delta"))
    stats = by_window.groupBy(KEY, "family", "kind").agg(F.count("*").alias("windows"), F.avg("delta").alias("mean_delta"), F.percentile("delta", F.lit(0.5)).alias("median_delta"),
                                                         F.avg((c("delta") > 0).cast("double")).alias("positive"), F.coalesce(ratio(F.max(up), F.sum(up)), F.lit(0.0)).alias("dominance"))
    keyed = by_window.withColumn("k", F.concat_ws("|", KEY, "family", "kind"))
    drawn = ST.intervals(ST.draws_by_key(keyed, "delta", "window", ST.ablation_draw, ST.ABLATION, n=draws, key="k"), ["mean"], by=("k",))
    drawn = drawn.select(F.split("k", r"\|").alias("k"), "low", "high").select(c("k")[0].alias(KEY), c("k")[1].alias("family"), c("k")[2].alias("kind"), "low", "high")
    whole = compared(plain.groupBy(KEY, "variant").agg(sharpe().alias("s")), [KEY], "s").withColumnRenamed("delta", "delta_sharpe")
    return stats.join(drawn, [KEY, "family", "kind"]).join(whole, [KEY, "family", "kind"])


def verdicts(table: DataFrame, sims: DataFrame) -> DataFrame:
    """A row for each (instrument, family): checks, and ACCEPTED, RESEARCH ONLY or REJECTED. Accepted needs a median difference above
    0 in most windows, and a benefit that goes when the family's inputs are shuffled; a family that has the benefit but doesn't outlive
    a bar of delay or doubled costs stays with research."""
    totals = sims.groupBy(KEY, "variant", "scenario").agg(sharpe().alias("s"))
    of = lambda v, s: F.max(F.when((c("variant") == v) & (c("scenario") == s), c("s")))
    out = None
    for f in OPTIONAL:  # a fixed handful
        one = totals.groupBy(KEY).agg(F.lit(f).alias("family"), (of(f"full~{f}", "plain") < of("full", "plain")).alias("sabotage_hurts"),
                                      (of(f"base+{f}", "delay_1") > of("base", "delay_1")).alias("survives_delay"), (of(f"base+{f}", "cost_2x") > of("base", "cost_2x")).alias("survives_cost"))
        out = one if out is None else out.unionByName(one)
    own = table.where("kind = 'marginal'").select(KEY, "family", (c("median_delta") > 0).alias("median_up"), (c("positive") > POSITIVE).alias("mostly_up"), (c("low") > 0).alias("interval_up"), (c("dominance") < DOMINANCE).alias("spread_out"))
    rows = own.join(out, [KEY, "family"])
    gain = c("median_up") & c("mostly_up") & c("sabotage_hurts")
    return rows.withColumn("status", F.when(gain & c("survives_delay") & c("survives_cost"), "ACCEPTED").when(gain, "RESEARCH ONLY").otherwise("REJECTED"))


def conditional(sims: DataFrame, tags: DataFrame, least: int = 20) -> DataFrame:
    """(instrument, family, condition, bars, sharpe_with, sharpe_base, delta): each family added to the base, in each cell of the tags
    (instrument, bar, condition) that holds at least so many bars."""
    plain = sims.where("scenario = 'plain'")
    base = plain.where("variant = 'base'").select(KEY, "bar", c("pnl").alias("base"))
    family = F.regexp_extract("variant", r"^base\+(.*)$", 1)
    both = plain.where(c("variant").startswith("base+")).select(KEY, "bar", family.alias("family"), "pnl").join(base, [KEY, "bar"]).join(tags, [KEY, "bar"])
    cells = both.groupBy(KEY, "family", "condition").agg(F.count("*").alias("bars"), sharpe().alias("sharpe_with"), sharpe("base").alias("sharpe_base"))
    return cells.where(c("bars") >= least).withColumn("delta", c("sharpe_with") - c("sharpe_base"))
