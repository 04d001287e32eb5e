"""Queries: retrain-driven halts, forward mutation, digests of stored runs, ablation over windows and regimes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.operators import ablation as A
from barloom.operators import digests as D
from barloom.operators import engine as EN
from barloom.operators import features as X
from barloom.operators import folds as FO
from barloom.operators import halts as H
from barloom.operators import mutation as MU
from barloom.operators import representation as RP
from barloom.operators import retraining as R
from barloom.operators import versions as V
from barloom.plans.base import BARS_DAILY, ORDER, query, sql_of
from barloom.plans.decisions import engine_bars
from barloom.plans.research import long_training_rows, training_rows
from barloom.plans.runner import run_research
from barloom.plans.windows import tag_regimes
from barloom.sources import bars as B

c = F.col

# --- halts that retrains drive, on retrains laid over the bars: one at every 40th bar, its sample the last 100 bars
RETRAINS = BARS_DAILY + f""", n as (select *, row_number() {ORDER} as n, close / lag(close, 40) {ORDER} - 1 as delta, close / max(close) {ORDER[:-1]} rows between 39 preceding and current row) - 1 as fall from bars),
t as (select instrument, n // 40 as retrain, delta, delta > 0.5 as accepted, n - 99 as s, n as e, fall < -0.9 as drawn from n where n % 40 = 0 and n >= 120),
f as (select instrument, min(retrain) as k0, max(retrain) as k1 from t group by 1),
w as (select instrument, k0 - 1 as retrain, '' as outcome, 0 as failures, null::bigint as last_end, false as edge, false as dd from f
 union all select t.instrument, t.retrain, case when t.delta > 0 then 'success' when t.s <= w.last_end then 'repeat' else 'failure' end,
  case when t.delta > 0 then 0 when t.s <= w.last_end then w.failures else w.failures + 1 end,
  case when t.delta > 0 then null when t.s <= w.last_end then w.last_end else t.e end,
  case when t.delta > 0 then false when t.s <= w.last_end then w.edge else w.edge or w.failures + 1 >= 3 end,
  (w.dd or t.drawn) and not t.accepted from w join t on t.instrument = w.instrument and t.retrain = w.retrain + 1)"""


@query("FLD-09-retrains", sql_of("select instrument, retrain, outcome, failures, edge as edge_halted, dd as drawdown_halted from w where outcome <> ''", "", RETRAINS))
def fld_09_retrains(spark, sf_dir):
    """What each retrain does to the halts of the fractional edge and of the drawdown."""
    n = F.row_number().over(B.by_time())
    fall = c("close") / F.max("close").over(B.by_time().rowsBetween(-39, 0)) - 1
    df = B.bars_daily(spark, sf_dir).withColumns({"n": n.cast("long"), "delta": c("close") / F.lag("close", 40).over(B.by_time()) - 1, "fall": fall}).where("n % 40 = 0 and n >= 120")
    rows = df.select("instrument", F.floor(c("n") / 40).alias("retrain"), "delta", (c("delta") > 0.5).alias("accepted"), (c("n") - 99).alias("start"), c("n").alias("end"), (c("fall") < -0.9).alias("drawn"))
    return H.retrain_halts(rows)


@query("SAN-03-features")
def san_03_features(spark, sf_dir):
    """Every feature and fitted component at cuts of each instrument's bars, with the bars behind the cut rewritten."""
    return MU.forward_mutation(B.bars_daily(spark, sf_dir), samples=2)


# --- stored runs
def two_runs(spark, sf_dir, spec: str):
    """Digests of the tables of two runs of the same stages."""
    out = []
    for _ in range(2):
        paths = {r.stage: r.path for r in run_research(spark, sf_dir, spec).collect()}  # a row a stage
        out.append(D.run_digest(D.stored_run(spark, paths)))
    return out


@query("REP-01-runs")
def rep_01_runs(spark, sf_dir):
    """Two stored runs, compared part by part of each table by digests that don't depend on the order of rows."""
    return D.compare(*two_runs(spark, sf_dir, "baselines,cost,timing,regimes"))


@query("REP-02-windows")
def rep_02_windows(spark, sf_dir):
    """The last windows of the walk once more, from their bars: fitted models (by digest) and forecasts against those stored."""
    walk = R.walked(training_rows(spark, sf_dir))
    last = walk["windows"].where(c("window") == R.WINDOWS - 1)
    again = R.forecasts(walk["rows"], R.fold_parts(last), R.WALK_GRID)
    first = walk["fold_forecasts"].where(c("window") == R.WINDOWS - 1)
    return D.verdict(D.compare(D.run_digest({"forecasts": first}), D.run_digest({"forecasts": again})))


@query("SRC-07-digest", sql_of("select instrument as part, count(*) as \"rows\" from bars group by 1"))
def src_07_digest(spark, sf_dir):
    """The rows of each instrument's digest; bars are hashed where they are read, and no series is put together."""
    out = D.digest(B.bars_daily(spark, sf_dir), "instrument")
    return out.where("total is not null and mixed is not null").select("part", "rows")


# --- orders and representations
ORDERS = [round(0.05 * k, 2) for k in range(1, 20)]


@query("AGG-13-folds")
def agg_13_folds(spark, sf_dir):
    """How well a fitted model does out of sample with the fractional order held at each value, over the folds of each instrument."""
    scores = R.score_by_order(B.stored(R.positioned(training_rows(spark, sf_dir))), ORDERS, *R.GRID[0])
    return scores.groupBy("instrument", "d").agg(F.count("*").alias("folds"), F.avg("score").alias("score"), F.avg("sharpe").alias("sharpe"), F.avg("accuracy").alias("accuracy"), F.sum("net").alias("net"), F.max("max_drawdown").alias("max_drawdown"))


CANDIDATES = ["time_15", "tick_1", "tick_2"]
#: the tape has deals only: quotes are taken to lie so far apart
SPREAD = 1e-3


def candidate_bars(spark, sf_dir):
    """The tape's instruments in each candidate's bars, with their place (_row): bars of deals that came at once are in the deals' order."""
    out = None
    for name in CANDIDATES:
        if name.startswith("time"):
            bars = B.bars_15m(spark, sf_dir).withColumn("_row", (F.row_number().over(B.by_time()) - 1).cast("long"))
        else:
            bars = FO.event_bars(B.deals(spark, sf_dir), *FO.parse_target(name)).withColumnRenamed("start", "timestamp").withColumn("_row", F.split_part("bar_id", F.lit("-"), F.lit(2)).cast("long")).drop("bar_id")
        one = RP.keyed(bars, name)
        out = one if out is None else out.unionByName(one)
    return out.withColumns({"bid": c("close") * (1 - SPREAD / 2), "ask": c("close") * (1 + SPREAD / 2), "bid_size": c("volume") / 2, "ask_size": c("volume") / 2})


def representation_tables(spark, sf_dir):
    """A walk over the tape's instruments that picks its bars anew in each window: quarter hours, single deals, or pairs of deals."""
    placed = RP.in_place(candidate_bars(spark, sf_dir))
    rows = long_training_rows(placed, (RP.BEGAN,)).withColumn("session", F.floor(c(RP.BEGAN) / 1e6).cast("double"))
    return RP.selection_walk(rows, CANDIDATES, B.fresh_path(spark, "representation"), count=5)


@query("RUN-06-walk")
def run_06_walk(spark, sf_dir):
    """Which bars each window trades on, by the folds before it, and what the account earns in it."""
    out = representation_tables(spark, sf_dir)
    net = out["results"].where("variant = 'full'").groupBy(c("instrument").alias("base"), "window").agg(F.sum("pnl").alias("net"), F.count("*").alias("n"))
    return out["selection"].drop("instrument").join(net, ["base", "window"], "left").withColumnRenamed("base", "instrument")


# --- backtests with a model that is retrained on the way
def versioned_bars(spark, sf_dir):
    """The engine's bars with the forecast of the model version in force, and the registry of versions."""
    rows = B.stored(R.positioned(training_rows(spark, sf_dir)))
    versions = B.stored(V.fitted_versions(rows, R.walk_windows(rows)), name="versions")
    inputs = X.regime_columns(X.volatility_features(X.return_features(engine_bars(spark, sf_dir).drop("er"))))
    return inputs.select("instrument", "timestamp", *[n for n in EN.INPUTS if n != "er"], *V.INPUTS), versions


@query("API-01-engine")
def api_01_engine(spark, sf_dir):
    """A backtest bar by bar, its model swapped at the bar after each retrain: what the account did under each version."""
    bars, versions = versioned_bars(spark, sf_dir)
    known = B.stored(V.forecast_as_of(bars, versions), name="forecast")
    done = EN.run_engine(known).join(known.select("instrument", "timestamp", "version"), ["instrument", "timestamp"])
    return done.groupBy("instrument", "version").agg(F.count("*").alias("bars"), F.count_if(c("filled") != 0).alias("fills"), F.count_if(c("status") == "HALTED").alias("halted"),
                                                     F.min_by("equity", "timestamp").alias("first_equity"), F.max_by("equity", "timestamp").alias("last_equity"))


# --- ablation
def ablation_tables(spark, sf_dir):
    """rows, forecasts and simulated rows of every variant over the windows of a walk."""
    folder = B.fresh_path(spark, "ablation")
    extra = X.vpin(X.ofi_features(X.volume_features(X.with_returns(B.bars_daily(spark, sf_dir))))).select("instrument", "timestamp", *A.EXTRA)
    rows = B.stored(R.positioned(training_rows(spark, sf_dir)).join(extra, ["instrument", "timestamp"], "left"), folder, "rows")
    made = B.stored(A.variant_forecasts(rows, R.walk_windows(rows)), folder, "forecasts")
    return rows, B.stored(A.simulated(made, rows), folder, "simulated")


@query("ABL-01-windows")
def abl_01_windows(spark, sf_dir):
    """What each family adds to the base and to all others: Sharpe differences, whole and over windows, with bootstrapped intervals."""
    return A.matrix(ablation_tables(spark, sf_dir)[1])


@query("ABL-04")
def abl_04(spark, sf_dir):
    """The verdict on each family: its differences over windows, and whether they outlive shuffled inputs, a bar of delay and doubled costs."""
    sims = ablation_tables(spark, sf_dir)[1]
    return A.verdicts(A.matrix(sims), sims)


@query("ABL-02-families")
def abl_02_families(spark, sf_dir):
    """What each family adds in each regime: both variants in the same rows of a cell."""
    rows, sims = ablation_tables(spark, sf_dir)
    return A.conditional(sims, regime_tags(rows))


def regime_tags(rows):
    """(instrument, bar, condition): the volatility and the trend cell of each bar."""
    w = Window.partitionBy("instrument").orderBy("bar")
    tagged = tag_regimes(rows.withColumn("r", c("log_close") - F.lag("log_close", 1).over(w)))
    return tagged.select("instrument", "bar", F.explode(F.array(F.concat(F.lit("volatility:"), c("vol_tag")), F.concat(F.lit("trend:"), c("trend_tag")))).alias("condition")).where("condition not like '%warmup'")
