"""Queries: models, walk-forward runs, gates, manifests, entry points, streaming, and the relational surface."""

from __future__ import annotations

import json
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window


from barloom.operators import engine as EN
from barloom.operators import features as X
from barloom.operators import folds as FO
from barloom.operators import labels as L
from barloom.operators import metrics as M
from barloom.operators import models as MO
from barloom.operators import retraining as R
from barloom.operators import stats as ST
from barloom.operators import training as T
from barloom.plans import config as C
from barloom.plans import gates as G
from barloom.plans.base import BARS_15M, BARS_DAILY, ORDER, DEALS, query, sql_of
from barloom.plans.decisions import FC, LAB, OBS, TRAINING, engine_bars, forecast_columns, forecasts, labelled, sim_rows
from barloom.plans.metrics import PRE, pnl
from barloom.plans.windows import RET
from barloom.sources import bars as B
from barloom.sources import synthetic as SY
from barloom.streaming import jobs as J

c = F.col
ID = 'instrument, "timestamp"'
NONE = "one as (select 1)"
INPUTS = ["return_1", "return_4", "vol_50", "volatility_state"]


def model_rows(spark, sf_dir):
    """Rows with inputs and labels, their place in their instrument's series, and whether they lie in its first 60 %, which train."""
    df = L.labels(X.regime_columns(X.volatility_features(X.return_features(forecasts(spark, sf_dir)))))
    df = L.valid_rows(df.withColumn("up", (c("y") > 0).cast("double")), [*INPUTS, "y_norm"])
    place = F.row_number().over(B.by_time())
    return df.withColumn("trains", place <= SPLIT * F.count("*").over(Window.partitionBy("instrument")))


#: the share of an instrument's rows that trains, and the fit of a single model
SPLIT, ROUNDS, LEAST = 0.6, 300, 50


def boosted_rows(spark, sf_dir):
    """Forecasts of each instrument's last rows by a model of its first ones: a task for each instrument."""
    rows = R.positioned(training_rows(spark, sf_dir))
    made = R.forecasts(rows, R.split_part(rows, SPLIT), [(ROUNDS, LEAST)]).where("inputs = 'full'")
    return made.join(rows.select("instrument", "bar", "timestamp", "y_norm", "sigma"), ["instrument", "bar"])


@query("MOD-01")
def mod_01(spark, sf_dir):
    return boosted_rows(spark, sf_dir).groupBy("instrument").agg(F.count("*").alias("n"), F.avg("m").alias("mean_forecast"), M.safe_corr("m", "y_norm").alias("ic"))


@query("MOD-02")
def mod_02(spark, sf_dir):
    rows = B.stored(model_rows(spark, sf_dir).select("instrument", *INPUTS, "up", "trains"), name="model")  # the fit passes over them many times
    train = rows.where("trains")
    model = MO.direction(INPUTS, train.count()).fit(train)
    return model.transform(rows.where("not trains")).withColumn("p", MO.probability()).groupBy("instrument").agg(
        F.avg("p").alias("mean_p"), F.avg(((c("p") > 0.5) == (c("up") == 1)).cast("double")).alias("accuracy"))


def calibrated(spark, sf_dir, kernel, schema: str):
    """kernel(forecasts, clipped labels) -> rows, in a task for each instrument."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("timestamp")
        out = pd.DataFrame(kernel(pdf["z"].to_numpy(float), np.clip(pdf["y"].to_numpy(float), -0.1, 0.1)),
            columns=[f.split()[0] for f in schema.split(", ")])
        out.insert(0, "instrument", pdf["instrument"].iloc[0])
        return out

    rows = labelled(spark, sf_dir).where(c("y").isNotNull()).select("instrument", "timestamp", F.coalesce("z", F.lit(0.0)).alias("z"), "y")
    return rows.groupBy("instrument").applyInPandas(run, f"instrument string, {schema}")


@query("MOD-04")
def mod_04(spark, sf_dir):
    def kernel(a, y):
        fits = [(k, MO.Calibrator(k).fit(a, y)) for k in ("isotonic", "binned")]
        return [(k, len(m.x), float(m.y.min()) if len(m.y) else None, float(m.y.max()) if len(m.y) else None) for k, m in fits]

    return calibrated(spark, sf_dir, kernel, "kind string, points int, lowest double, highest double")


@query("MOD-05")
def mod_05(spark, sf_dir):
    """The first 60 % of each instrument's rows calibrate, the rest is predicted."""
    def kernel(a, y):
        k = int(len(a) * SPLIT)
        return list(zip(a[k:], MO.Calibrator().fit(a[:k], y[:k]).predict(a[k:]), strict=True))

    return calibrated(spark, sf_dir, kernel, "a double, expected double")


@query("MOD-18")
def mod_18(spark, sf_dir):
    return calibrated(spark, sf_dir, lambda a, y: MO.Calibrator().fit(a, y).curve(50), "a double, expected double")


@query("MOD-06")
def mod_06(spark, sf_dir):
    """M, P, their combination and the expected return of each row."""
    from barloom.functions.scalars import combine

    scored = boosted_rows(spark, sf_dir).withColumn("a", combine(c("m"), c("p")))
    return scored.select("instrument", "timestamp", "m", "p", "a", (c("a") * c("sigma") * 2).alias("er"))


@query("MOD-07")
def mod_07(spark, sf_dir):
    rows = labelled(spark, sf_dir).withColumn("t", F.greatest(F.lit(-0.1), F.least(F.lit(0.1), c("r_fill"))))
    return spark.createDataFrame(sorted(MO.ridge(rows, ["range_rel", "relative_spread"], "t").items()), "input string, weight double")


@query("MOD-08", sql_of(f"select {ID}, 0.1 + 2 * range_rel - 0.5 * relative_spread as adverse from f3", "adverse", FC))
def mod_08(spark, sf_dir):
    return forecasts(spark, sf_dir).select("instrument", "timestamp",
        MO.linear({"one": 0.1, "range_rel": 2.0, "relative_spread": -0.5}).alias("adverse"))


def training_rows(spark, sf_dir, bars=None):
    """All bars with inputs, labels and what their simulation needs; a task of an instrument picks the rows that have them."""
    return training_columns(X.regime_columns(X.volatility_features(X.return_features(forecasts(spark, sf_dir, bars)))))


def long_training_rows(bars, keep=(), chunk=X.CHUNK):
    """training_rows of long series and the double columns keep: windows are worked out in chunks of an instrument, of which many tasks
    take some; only labels and places take its rows in one pass. bars may have _row, their place, or are numbered."""
    made = X.rolling_columns(bars, ("open", "high", "low", "close", "bid", "ask", "bid_size", "ask_size", *keep), chunk)
    df = forecast_columns(B.with_bar_columns(made.withColumn("range_rel", (c("high") - c("low")) / c("close"))))
    return training_columns(df.withColumns({"vol_50": F.log(c("sigma_h") + X.EPS), "volatility_state": c("s20") / (c("s200") + X.EPS)}), keep)


def training_columns(df, keep=()):
    df = L.labels(df)
    own = {"sigma": c("sigma_h"), "cost_side": c("cost_side_exec"), "adverse": F.lit(0.0), "uncertainty": F.lit(0.0),
        "session": F.unix_seconds("timestamp").cast("double"), "window": F.lit(0.0)}
    return df.withColumns(own).select("instrument", "timestamp", *T.COLUMNS, *keep)


def retrain_tables(spark, sf_dir, rows=None):
    """The stored tables of a retrain of each instrument over all its rows, with the whole grid."""
    folder = B.fresh_path(spark, "retrain")
    placed = R.placed_rows(spark, training_rows(spark, sf_dir) if rows is None else rows, folder)
    return R.retrained(placed, R.whole_window(placed), R.GRID, folder)


@query("MOD-09")
def mod_09(spark, sf_dir):
    """Every grid point, with and without fractional inputs, in each fold of each instrument."""
    return retrain_tables(spark, sf_dir)["fold_scores"].drop("window")


@query("LAB-07")
def lab_07(spark, sf_dir):
    """The order and the filter's noises of each fold, from bars up to the newest one in a training label."""
    def kernel(s):
        for fold, train_end, _, _ in L.folds(len(s.bars)) if len(s.bars) >= 200 else []:
            upto = s.label_end(train_end - 1)
            yield {"fold": fold, "train_bars": upto + 1, "d": s.order(upto),
                **dict(zip(("q_level", "q_velocity", "r"), s.kalman(upto), strict=True))}

    schema = "instrument string, fold int, train_bars long, d double, q_level double, q_velocity double, r double"
    return training_rows(spark, sf_dir).groupBy("instrument").applyInPandas(T.task(kernel, schema), schema)


@query("MOD-17")
def mod_17(spark, sf_dir):
    """The adverse-selection model of each fold of the chosen grid point, from forecasts before its validation rows, and what it says
    of those."""
    made = retrain_tables(spark, sf_dir)
    best = made["choices"].where("inputs = 'full'").select(*R.AT, "inputs", "rounds", "least")
    return made["fold_scores"].join(best, [*R.AT, "inputs", "rounds", "least"]).select("instrument", "fold", "exec_rows", "residual_std", "r2", "adverse", "uncertainty")


@query("MOD-10")
def mod_10(spark, sf_dir):
    rows = sim_rows(spark, sf_dir).withColumn("row", F.row_number().over(B.by_time()))
    return FO.simulate_frame(rows.where("row > 2000"), {"holdout": FO.SimParams()}).groupBy("key").agg(F.sum("pnl").alias("net"),
        F.count("*").alias("n"))


RETRAIN = "instrument string, folds int, mean_sharpe double, wins int, accepted boolean, d double, train_end long, calibration_rows long, residual_std double, model string"
LIGHT = "instrument string, variant string, d double, net double, sharpe double, corr double, n long"


@query("MOD-10-holdout")
def mod_10_holdout(spark, sf_dir):
    """The chosen models on the newest rows, which no choice has seen: refitted on the inner rows, calibrated on the folds."""
    return retrain_tables(spark, sf_dir)["reports"].drop("window")


@query("MOD-11")
def mod_11(spark, sf_dir):
    """A retrain of each instrument: choice by the folds, one look at the holdout, acceptance, and the refit on all rows that it
    leaves: its digest, and its forecast for the newest row."""
    made = retrain_tables(spark, sf_dir)
    newest = R.chosen(made["windows"], made["choices"]).select(*R.AT, "first", F.lit(R.PRODUCTION_PART).alias("part"), c("m").alias("train_end"), (c("m") - 1).alias("start"), c("m").alias("end"),
                                                               c("inner_end").alias("d_end"), *R.POINTS)
    last = R.forecasts(made["rows"], newest, None).where("inputs = 'full'").select("instrument", "bar", c("m").alias("forecast"), c("p").alias("up"), c("digest").alias("model"))
    means = made["choices"].where("inputs = 'full'").select("instrument", "mean_score")
    return made["reports"].drop("window").join(means, "instrument").join(last.withColumnRenamed("bar", "train_end"), "instrument")


@query("MOD-12")
def mod_12(spark, sf_dir):
    """Light refits, as they are and on destroyed labels or inputs."""
    return training_rows(spark, sf_dir).groupBy("instrument").applyInPandas(T.task(T.light_refits, LIGHT), LIGHT)


@query("MOD-13",
    sql_of("select instrument, count(*) as n, count(distinct er) as distinct_forecasts, quantile_cont(abs(er), 0.9) as p90_edge, avg(cost + 3e-4 + 8e-4) as mean_required, count_if(abs(er) - cost - 3e-4 > 8e-4)::bigint as tradable from f3 where er is not null group by 1",
    "p90_edge mean_required", FC))
def mod_13(spark, sf_dir):
    df = forecasts(spark, sf_dir).where("er is not null")
    return df.groupBy("instrument").agg(F.count("*").alias("n"), F.count_distinct("er").alias("distinct_forecasts"),
        F.percentile(F.abs("er"), F.lit(0.9)).alias("p90_edge"),
                                        F.avg(c("cost") + 3e-4 + 8e-4).alias("mean_required"),
                                            F.count_if(F.abs("er") - c("cost") - 3e-4 > 8e-4).alias("tradable"))


@query("MOD-14",
    sql_of("select instrument, substr(sha256('[' || count(*) || ', ' || sum(volume)::bigint || ']'), 1, 16) as digest from bars group by 1"))
def mod_14(spark, sf_dir):
    """The digest of what was fitted: here on each instrument's row count and volume."""
    rows = B.bars_daily(spark, sf_dir).groupBy("instrument").agg(F.count("*").alias("n"),
        F.sum("volume").cast("long").alias("v")).collect()  # a row an instrument
    return spark.createDataFrame([(r.instrument, MO.digest([r.n, r.v])) for r in rows], "instrument string, digest string")


ACCEPT = """m as (select instrument, avg(case when q <> 0 then (sign(q) = sign(open_next2 / open_next - 1))::int end) as accuracy, covar_pop(q, open_next2 / open_next - 1) as corr, sum(pnl) as net,
 sum(case when pnl > 0 then pnl else 0 end) / nullif(-sum(case when pnl < 0 then pnl else 0 end), 0) as pf, max(drawdown) as dd from p group by 1),
wins as (select instrument, count_if(t > 0) as k from (select instrument, w, sum(pnl) as t from p group by 1, 2) group by 1)"""


@query("MOD-15",
    sql_of("""select instrument, unnest(['accuracy', 'correlation', 'net', 'profit_factor', 'drawdown', 'beats_baseline']) as "check", unnest([accuracy > 0.51, corr > 0, net > 0, pf > 1.05, dd < 0.15, k >= 3]) as passed
 from m join wins using (instrument)""", "", PRE + ", " + ACCEPT))
def mod_15(spark, sf_dir):
    """The acceptance checks on the results of each instrument's prescribed exposure; wins are windows with a gain."""
    move = c("open_next2") / c("open_next") - 1
    wins = pnl(spark, sf_dir).groupBy("instrument",
        "w").agg(F.sum("pnl").alias("t")).groupBy("instrument").agg(F.count_if(c("t") > 0).alias("k"))
    gain = lambda up: F.sum(F.when(c("pnl") > 0 if up else c("pnl") < 0, c("pnl")).otherwise(0.0))
    rows = pnl(spark, sf_dir).groupBy("instrument").agg(
        F.avg(F.when(c("q") != 0, (F.signum("q") == F.signum(move)).cast("int"))).alias("accuracy"),
            F.covar_pop(c("q"), move).alias("corr"), F.sum("pnl").alias("net"),
        M.ratio(gain(True), -gain(False)).alias("profit_factor"), F.max("drawdown").alias("max_drawdown")).join(wins,
            "instrument").collect()  # a row an instrument
    return spark.createDataFrame([(r.instrument, k, bool(v)) for r in rows for k, v in MO.accept(r.asDict(), r.k).items()],
        "instrument string, check string, passed boolean")


@query("MOD-16")
def mod_16(spark, sf_dir):
    """How often each instrument's model splits on each input."""
    rows = R.positioned(training_rows(spark, sf_dir))
    return R.importance(rows, R.split_part(rows, SPLIT), ROUNDS, LEAST).select("instrument", "feature", "splits")


# --- runs
CARRY = PRE + ", t as (select instrument, w, sum(pnl) as t from p group by 1, 2)"


def window_totals(spark, sf_dir):
    return pnl(spark, sf_dir).groupBy("instrument", c("w").alias("window")).agg(F.sum("pnl").alias("t"))


@query("RUN-01",
    sql_of("select instrument, w as \"window\", last_value(case when t > 0 then w end ignore nulls) over (partition by instrument order by w rows unbounded preceding) as model from t",
    "", CARRY))
def run_01(spark, sf_dir):
    """Which model each window deploys: its own if accepted (here: its window gains), else the last accepted one."""
    return window_totals(spark, sf_dir).select("instrument", "window",
        F.last(F.when(c("t") > 0, c("window")), True).over(Window.partitionBy("instrument").orderBy("window")).alias("model"))


@query("RUN-01-windows")
def run_01_windows(spark, sf_dir):
    """The walk over each instrument's bars before the locked ones: retrain, accept, carry on, run out of sample. A row an instrument
    and window; a task an instrument, window and fold."""
    return R.walk_table(R.walked(training_rows(spark, sf_dir)))


@query("RUN-01-holdout")
def run_01_holdout(spark, sf_dir):
    """The walk over the locked bars, opened on record, with the last models of the walk before carried in."""
    before = R.walked(training_rows(spark, sf_dir))
    made = R.holdout_walk(before, "EXPERIMENTAL", B.fresh_path(spark, "access"), "registered query: results are reported, not selected on", forced=True)
    return R.walk_table(made)


@query("RUN-03-walk")
def run_03_walk(spark, sf_dir):
    """What the fractional inputs add to each window's Sharpe ratio: mean, median, trimmed mean, mean without the best window, the
    share of windows with a gain, and how much of all gains the best window has."""
    return ablation_of(run_01_windows(spark, sf_dir))


def ablation_of(walk):
    rows = walk.where("model is not null").withColumn("delta", c("window_sharpe_full") - c("window_sharpe_baseline"))
    v = F.array_sort(F.collect_list("delta"))  # a value a window
    up = F.when(c("delta") > 0, c("delta"))
    out = rows.groupBy("instrument").agg(F.count("*").alias("windows"), F.avg("delta").alias("mean"), F.percentile("delta", F.lit(0.5)).alias("median"), v.alias("v"), F.avg((c("delta") > 0).cast("double")).alias("positive"),
                                         F.coalesce(M.ratio(F.max(up), F.sum(up)), F.lit(0.0)).alias("dominance"))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.greatest(F.size(a), F.lit(1))
    cut = lambda a, at, less: F.slice(a, at, F.greatest(F.size(a) - less, F.lit(1)))
    return out.withColumns({"trimmed": mean(cut(c("v"), 2, 2)), "without_best": mean(cut(c("v"), 1, 1))}).drop("v")


def _tasks(key: str, kernel, schema: str):
    @query(key)
    def run(spark, sf_dir):
        return training_rows(spark, sf_dir).groupBy("instrument").applyInPandas(T.task(kernel, schema), schema)

    return run


san_01_refits = _tasks("SAN-01-refits", T.sanity,
    "instrument string, scenario string, net double, sharpe double, total_return double, n long")
abl_03_inputs = _tasks("ABL-03-inputs", T.sabotage, "instrument string, family string, mode string, net double")
str_05_refits = _tasks("STR-05-refits", T.around_order,
    "instrument string, step int, d double, net double, sharpe double, corr double, collapsed boolean")
bas_01_paths = _tasks("BAS-01-paths", T.baselines, "instrument string, scenario string, net double")


@query("ABL-01")
def abl_01(spark, sf_dir):
    """Refits with and without each optional family; delta is full against baseline."""
    schema = "instrument string, family string, baseline double, base_plus double, full_minus double, full double"
    df = training_rows(spark, sf_dir).groupBy("instrument").applyInPandas(T.task(T.ablation, schema), schema)
    return df.withColumns({"additive": c("base_plus") - c("baseline"), "marginal": c("full") - c("full_minus"),
        "delta": c("full") - c("baseline")})


@query("RUN-02", "select * from (values (0, 'walkforward'), (1, 'baselines'), (2, 'bootstrap'), (3, 'gates')) t(n, stage)")
def run_02(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(resolve_stages("walkforward,baselines,bootstrap,gates"))), "n int, stage string")


STAGES = ["walkforward", "baselines", "cost", "execution_stress", "timing", "perturbation", "d_perturbation", "sanity", "leakage",
    "regimes", "ablation", "families", "bootstrap", "holdout", "reproducibility", "gates"]
QUICK = [s for s in STAGES if s not in ("d_perturbation", "sanity", "families", "holdout")]


def resolve_stages(spec: str, open_holdout: bool = False) -> list[str]:
    """all, quick or a comma list, in the fixed order; the holdout only when opened."""
    wanted = STAGES if spec == "all" else QUICK if spec == "quick" else [s.strip() for s in spec.split(",")]
    if unknown := set(wanted) - set(STAGES):
        raise ValueError(f"unknown stages: {sorted(unknown)}")
    return [s for s in STAGES if s in wanted and (open_holdout or s != "holdout")]


@query("RUN-03")
def run_03(spark, sf_dir):
    d = sim_rows(spark, sf_dir).groupBy("window").agg(F.sum(c("er") * (c("open_next2") / c("open_next") - 1)).alias("delta"))
    v = F.sort_array(F.collect_list("delta"))
    out = d.agg(F.avg("delta").alias("mean"), F.percentile("delta", F.lit(0.5)).alias("median"), v.alias("v"), F.sum("delta").alias("s"),
        F.count("*").alias("n"))
    trimmed = F.aggregate(F.slice("v", 2, F.greatest(F.size("v") - 2, F.lit(1))), F.lit(0.0), lambda a,
        x: a + x) / F.greatest(F.size("v") - 2, F.lit(1))
    return out.select("mean", "median", trimmed.alias("trimmed"),
        ((c("s") - F.array_max("v")) / F.greatest(c("n") - 1, F.lit(1))).alias("without_best"))


@query("RUN-05")
def run_05(spark, sf_dir):
    root = B.fresh_path(spark, "runs")
    spark.createDataFrame([(f"run{k}", json.dumps({"run": k, "sharpe": k / 10})) for k in range(3)],
        "id string, value string").write.partitionBy("id").text(root)
    return spark.read.json(f"{root}/id=*").select("run", "sharpe").orderBy(c("run").desc())


@query("RUN-06",
    sql_of("select w as \"window\", arg_max(instrument, row(t, -ascii(instrument))) as choice from (select instrument, (row_number() " + ORDER + " - 1) // 250 as w, close from bars), lateral (select close as t) group by 1"))
def run_06(spark, sf_dir):
    """The candidate with the best score in each window; the first of equal ones."""
    df = B.bars_daily(spark, sf_dir).withColumn("w", F.floor((F.row_number().over(B.by_time()) - 1) / 250))
    return df.groupBy(c("w").alias("window")).agg(F.max_by("instrument", F.struct(c("close"), -F.ascii("instrument"))).alias("choice"))


@query("RUN-07")
def run_07(spark, sf_dir):
    """An ensemble of seeded paths, one a partition of the data source, each retrained like an instrument; never more than
    EXPERIMENTAL, whatever comes out."""
    spark.dataSource.register(SY.SyntheticMarket)
    bars = X.with_returns(spark.read.format("synthetic_market").option("paths", 4).option("bars", 1600).load())
    runs = training_rows(spark, sf_dir, bars).groupBy("instrument").applyInPandas(T.task(T.retrain, RETRAIN), RETRAIN)
    return runs.withColumn("class", F.lit(G.evaluate({}, synthetic=True)[1])).drop("model")


@query("RUN-09",
    sql_of("select instrument, count(*) as n from bars where \"timestamp\" < timestamp '1998-01-01' or \"timestamp\" >= timestamp '2000-01-01' group by 1"))
def run_09(spark, sf_dir):
    bars = B.bars_daily(spark, sf_dir)
    y = F.year("timestamp")
    return bars.where(y < 1998).unionByName(bars.where(y >= 2000)).groupBy("instrument").agg(F.count("*").alias("n"))


@query("GAT-01")
def gat_01(spark, sf_dir):
    """The gates, fed from the stages' queries over these tables; the holdout stays closed."""
    from barloom.plans.base import QUERIES
    from barloom.plans.runner import stage_table

    tables = {stage: stage_table(spark, sf_dir, stage) for stage in ("walkforward", "execution_stress", "timing", "bootstrap", "leakage", "reproducibility")}
    return gates_frame(spark, tables | {"sanity_more": QUERIES["SAN-01-refits"](spark, sf_dir)})


def walk_values(walk) -> dict:
    """Of the short list: what the walk of each instrument says; the worst one counts."""
    up = F.when(c("net_full") > 0, c("net_full"))
    each = walk.select(F.inline("instruments")).groupBy("instrument").agg(
        F.count_if(c("model").isNotNull()).alias("windows"),
        F.first("return_full").alias("net"),
        F.first("sharpe_full").alias("sharpe"),
        F.first("drawdown_full").alias("dd"),
        F.sum("oos_rows").alias("n"),
        (F.first("sharpe_full") - F.first("sharpe_baseline")).alias("delta"),
        M.ratio(F.max(up), F.sum(up)).alias("dominance"),
    ).collect()  # a row an instrument
    worst = lambda k, f: f(r[k] for r in each)
    corrected = lambda r: ST.multiple_testing(r.sharpe, r.n, 252.0, len(each) * T.WINDOWS)["p_bonferroni"] if r.sharpe > 0 and r.n else 1.0
    return {
        "windows": worst("windows", min),
        "net_return": worst("net", min),
        "sharpe": worst("sharpe", min),
        "max_drawdown": worst("dd", max),
        "delta_sharpe": worst("delta", min),
        "dominance": worst("dominance", max),
        "p_bonferroni": max(map(corrected, each)),
    }


def cost_break_even(stress) -> float:
    """The cost level at which the worst instrument stops earning. Without a crossing it lies beyond the highest level, or below the
    lowest."""
    levels = stress.where(c("scenario").rlike("^x[0-9.]+_d0$")).select("instrument", F.regexp_extract("scenario", "^x([0-9.]+)", 1).cast("double").alias("x"), "total_return").collect()
    points = {i: sorted((r.x, r.total_return) for r in levels if r.instrument == i) for i in {r.instrument for r in levels}}
    beyond = lambda v: v[-1][0] if v[-1][1] > 0 else v[0][0]
    return min(b if (b := ST.break_even(v)) is not None else beyond(v) for v in points.values())


def gate_values(tables) -> dict:
    """What the gates judge, from stage tables; the worst instrument counts. A stage that didn't run leaves its gates open."""
    out = walk_values(tables["walkforward"]) if "walkforward" in tables else {}
    one = lambda stage, value: tables[stage].agg(value).first()[0]
    if "execution_stress" in tables:
        out["cost_break_even"] = cost_break_even(tables["execution_stress"])
    if "timing" in tables:
        out["delay_sharpe"] = tables["timing"].where("scenario = 'delay_1'").agg(F.min("sharpe")).first()[0]
    if "bootstrap" in tables:
        out["bootstrap_low"] = tables["bootstrap"].where("metric = 'sharpe'").select(F.inline("instruments")).agg(F.min("low")).first()[0]
    if "reproducibility" in tables:
        out["identical"] = int(one("reproducibility", F.sum("changed")) == 0)
    if "leakage" in tables:
        out["leaks"] = one("leakage", F.sum("changed"))
    if "sanity_more" in tables:
        out["destroyed_sharpe"] = tables["sanity_more"].where("scenario in ('shuffled_labels', 'shuffled_features')").agg(F.max("sharpe")).first()[0]
    if "holdout" in tables:
        held = tables["holdout"].where("variant = 'full'")
        out |= held.agg(F.min("total_return").alias("holdout_return"), F.min("sharpe").alias("holdout_sharpe")).first().asDict()
    return out


def gates_frame(spark, tables):
    rows, rung = G.evaluate(gate_values(tables))
    return spark.createDataFrame([(n, g, None if v is None else float(v), t, p, rung) for n, g, v, t, p in rows],
        "gate string, grp string, value double, threshold double, passed boolean, class string")


def sanity_verdicts(refits):
    """instrument, scenario, passed of the sanity tests: what is destroyed must lose its edge, costs must cost, and the strategy
    must lie above 95 % of its own permutations."""
    base = refits.where("scenario = 'strategy'").select("instrument", c("sharpe").alias("base"), c("total_return").alias("base_return"))
    rows = refits.join(F.broadcast(base), "instrument")  # a row an instrument and scenario
    vanishes = (c("sharpe") < 1) & ((c("sharpe") < c("base")) | (c("base") <= 0))
    tests = {"shuffled_labels": vanishes, "shuffled_features": vanishes,
        "target_shift": (c("sharpe") < c("base")) | (c("total_return") <= 0), "reversed": c("sharpe") < c("base"),
             "zero_cost": c("total_return") >= c("base_return") - 1e-9, "double_cost": c("total_return") <= c("base_return") + 1e-9}
    verdict = F.coalesce(*[F.when(c("scenario") == n, t) for n, t in tests.items()])
    single = rows.where(c("scenario").isin(*tests)).select("instrument", "scenario", verdict.alias("passed"))
    permuted = rows.where(c("scenario").startswith("random_")).groupBy("instrument").agg(F.avg((c("sharpe") < c("base")).cast("double")).alias("share"),
        F.percentile("sharpe", F.lit(0.5)).alias("middle"))
    return single.unionByName(permuted.select("instrument", F.lit("random").alias("scenario"),
        ((c("share") >= 0.95) & (c("middle") < 1)).alias("passed")))


@query("SAN-01-verdicts")
def san_01_verdicts(spark, sf_dir):
    return sanity_verdicts(san_01_refits(spark, sf_dir))


def ladder_values(tables) -> dict:
    """What the full ladder judges, from stage tables; the worst instrument counts, and a stage that didn't run leaves its gates open."""
    out = gate_values({k: v for k, v in tables.items() if k in ("bootstrap", "leakage", "reproducibility", "holdout")})
    if "walkforward" in tables:
        delta = c("window_sharpe_full") - c("window_sharpe_baseline")
        w = tables["walkforward"].select(F.inline("instruments")).groupBy("instrument").agg(
            F.count_if(c("model").isNotNull()).alias("windows"),
            F.first("deals_full").alias("deals"),
            F.first("sharpe_full").alias("sharpe"),
            F.first("drawdown_full").alias("max_drawdown"),
            F.first("pf_full").alias("profit_factor"),
            F.avg((c("net_full") > 0).cast("double")).alias("positive_windows"),
            F.first("return_production").alias("production_return"),
            F.first("sharpe_production").alias("production_sharpe"),
            M.ratio(F.sum(F.when(c("deployed").isNotNull(), c("oos_rows"))), F.sum("oos_rows")).alias("deployed"),
            F.percentile(delta, F.lit(0.5)).alias("median_delta"),
            F.avg((delta > 0).cast("double")).alias("positive_deltas"),
        )
        low = [n for n in w.columns if n not in ("instrument", "max_drawdown")]
        out |= w.agg(F.max("max_drawdown").alias("max_drawdown"), *[F.min(n).alias(n) for n in low]).first().asDict()
    if "cost" in tables:
        out["profitable_at_2x"] = int(tables["cost"].where("scenario = 'realised_2.0'").agg(F.min("total_return")).first()[0] > 0)
    if "timing" in tables:
        late = tables["timing"].where("scenario = 'delay_1'")
        out["viable_at_plus_1"] = int(late.agg(F.min(F.least("total_return", "sharpe"))).first()[0] > 0)
    if collapse := [tables[k].where("collapsed").count() for k in ("perturbation", "d_perturbation_more") if k in tables]:
        out["collapsed"] = sum(collapse)
    if "sanity_more" in tables:
        out["sanity_failed"] = sanity_verdicts(tables["sanity_more"]).where("not passed").count()
    if "holdout" in tables:
        out["holdout_opened"] = 1
    return out


def ladder_frame(spark, tables):
    rows, rung = G.evaluate(ladder_values(tables), gates=G.FULL_GATES)
    return spark.createDataFrame([(n, g, None if v is None else float(v), t, p, rung) for n, g, v, t, p in rows],
        "gate string, grp string, value double, threshold double, passed boolean, class string")


@query("GAT-01-ladder")
def gat_01_ladder(spark, sf_dir):
    """All gates of the ladder, from the stages' queries over these tables; the holdout stays closed."""
    from barloom.plans.base import QUERIES
    from barloom.plans.runner import stage_table

    tables = {s: stage_table(spark, sf_dir, s) for s in ("walkforward", "cost", "timing", "perturbation", "bootstrap", "leakage",
        "reproducibility")}
    return ladder_frame(spark, tables | {"d_perturbation_more": QUERIES["STR-05-refits"](spark, sf_dir),
        "sanity_more": QUERIES["SAN-01-refits"](spark, sf_dir)})


@query("REP-01", "select true as identical, 0::bigint as differing")
def rep_01(spark, sf_dir):
    sums = lambda: {r["instrument"]: r["checksum"] for r in B.checksum(B.bars_daily(spark,
        sf_dir)).collect()}  # noqa: E731  a row an instrument
    out = C.compare_runs(sums(), sums())
    return spark.createDataFrame([(out["identical"], len(out["differs"]))], "identical boolean, differing long")


@query("REP-02", "select 0::bigint as changed")
def rep_02(spark, sf_dir):
    run = lambda: FO.simulate_frame(sim_rows(spark, sf_dir), {"full": FO.SimParams()})
    return run().exceptAll(run()).agg(F.count("*").alias("changed"))


@query("SRC-16")
def src_16(spark, sf_dir):
    return SY.market_frame(spark, 500, symbols=("SYN",), seed=11)


@query("SRC-18")
def src_18(spark, sf_dir):
    return SY.market_frame(spark, 500, seed=21).groupBy("instrument", "regime").agg(F.count("*").alias("n"))


@query("SRC-17")
def src_17(spark, sf_dir):
    return spark.createDataFrame([(float(x),) for x in SY.fractional_noise(1000, 0.4, np.random.default_rng(0))], "x double")


@query("SRC-19")
def src_19(spark, sf_dir):
    ids, n = np.unique(SY.regimes(5000, np.random.default_rng(0)), return_counts=True)
    return spark.createDataFrame([(int(a), int(b)) for a, b in zip(ids, n, strict=True)], "regime int, n long")


@query("SRC-21", sql_of("select instrument, count(*) as n from bars group by 1"))
def src_21(spark, sf_dir):
    path = B.fresh_path(spark, "run")
    B.bars_daily(spark, sf_dir).groupBy("instrument").agg(F.count("*").alias("n")).write.parquet(f"{path}/bars")
    return spark.read.parquet(f"{path}/bars")


@query("SRC-22",
    sql_of("select instrument as current, row_number() over (order by n, instrument)::int as version from (select instrument, count(*) as n from bars group by 1) qualify row_number() over (order by n desc, instrument desc) = 1"))
def src_22(spark, sf_dir):
    """Instruments published as models, the fewest bars first; the current one is the last published."""
    registry = C.ModelRegistry(spark, B.fresh_path(spark, "registry"))
    for r in B.bars_daily(spark, sf_dir).groupBy("instrument").agg(F.count("*").alias("n")).orderBy("n",
        "instrument").collect():  # a row an instrument
        registry.publish(r.instrument, {"bars": r.n})
    now = registry.current()
    return spark.createDataFrame([(now["model"], now["version"])], "current string, version int")


@query("SRC-23", sql_of("select instrument, count(*) as n from bars group by 1", "", BARS_15M))
def src_23(spark, sf_dir):
    sources = {"daily": B.bars_daily, "15m": B.bars_15m}
    return sources["15m"](spark, sf_dir).groupBy("instrument").agg(F.count("*").alias("n"))


@query("SRC-24", "select 'x.y' as path, 3::int as value union all select 'x.z', 4")
def src_24(spark, sf_dir):
    cfg = C.load(base={"x": {"y": 1, "z": 4}}, over=C.overrides(["x.y=3"]))
    return spark.createDataFrame([("x.y", cfg["x"]["y"]), ("x.z", cfg["x"]["z"])], "path string, value int")


@query("API-05", "select 'a.b' as path, '1.5' as value union all select 'a.c', 'text'")
def api_05(spark, sf_dir):
    o = C.overrides(["a.b=1.5", "a.c=text"])
    return spark.createDataFrame([("a.b", str(o["a"]["b"])), ("a.c", o["a"]["c"])], "path string, value string")


@query("API-01")
def api_01(spark, sf_dir):
    """A backtest: simulate, then measure."""
    rows = FO.simulate_frame(sim_rows(spark, sf_dir), {"backtest": FO.SimParams()}).withColumnRenamed("exposure", "q").drop("equity")
    return M.performance(M.with_equity(rows, ["key"]), ["key"])


@query("FEA-24")
def fea_24(spark, sf_dir):
    """Filter and hidden states fitted on each instrument's training block, and the digest of both."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("timestamp").iloc[: int(len(pdf) * TRAINING)]
        y = pdf["log_close"].to_numpy(float)
        base = max(float(np.nanvar(np.diff(y))), 1e-12)
        v, r = max(FO.KALMAN_GRID, key=lambda g: FO.kalman(y, base, base * g[0], base * g[1])[1])
        m = FO.GaussianHMM().fit(pdf[OBS].to_numpy(float))
        fitted = [f"{x:.9g}" for x in (base, base * v, base * r, *m.mean.ravel(), *m.var.ravel(), *m.trans.ravel())]
        return pd.DataFrame([(pdf["instrument"].iloc[0], len(pdf), pdf["timestamp"].iloc[-1], base * r, MO.digest(fitted))],
            columns=["instrument", "n_bars", "fitted_end", "r", "digest"])

    df = X.hmm_observations(X.with_returns(B.bars_daily(spark, sf_dir))).select("instrument", "timestamp", "log_close", *OBS)
    return df.groupBy("instrument").applyInPandas(run, "instrument string, n_bars long, fitted_end timestamp, r double, digest string")


@query("FEA-26", "select 3::int as states, 1800.0::double as staleness")
def fea_26(spark, sf_dir):
    cfg = C.load(base={"hmm": {"states": 3}, "context": {"staleness": 1800.0}})
    return spark.createDataFrame([(cfg["hmm"]["states"], cfg["context"]["staleness"])], "states int, staleness double")


# --- ledger and event loop folds
@query("FLD-07",
    sql_of("""select instrument, 100 * (coalesce(arg_max(close, n) filter (where n % 12 = 0), arg_min(close, n)) - arg_min(close, n)) as realised,
 100000 + 100 * (arg_max(close, n) - arg_min(close, n)) as equity from o group by 1""", "realised equity",
     BARS_DAILY + f", o as (select *, row_number() {ORDER} as n from bars)"))
def fld_07(spark, sf_dir):
    """100 units held, closed and taken anew after every twelve bars: that books what was gained, and equity stays what it was."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        price = pdf.sort_values("timestamp")["close"].to_numpy(float)
        again = (np.arange(len(price)) + 1) % 12 == 0
        times = np.where(again, 3, 1)  # the bar itself, the close and the new entry
        fill = np.zeros(times.sum())
        at = np.cumsum(times)[again]
        fill[at - 2], fill[at - 1] = -100.0, 100.0
        fill[0] = 100.0
        led = FO.ledger(fill, np.repeat(price, times))
        return pd.DataFrame([(pdf["instrument"].iloc[0], float(led["realised"][-1]), float(led["equity"][-1]))],
            columns=["instrument", "realised", "equity"])

    return B.bars_daily(spark, sf_dir).select("instrument", "timestamp", "close").groupBy("instrument").applyInPandas(run,
        "instrument string, realised double, equity double")


def halts(marks: list[bool], recovery: int = 13) -> list[bool]:
    """Whether each bar is halted: bad bars arm, so many clean ones in a row clear."""
    out, armed, clean = [], False, 0
    for bad in marks:
        clean = 0 if bad else clean + 1
        armed = bad or (armed and clean < recovery)
        out.append(armed)
    return out


HALTED = f'max((r < -0.025)::int) over (partition by instrument order by "timestamp" rows between 12 preceding and current row) = 1'


def halted_bars(spark, sf_dir):
    """Bars with halted: a loss of over 2.5 % arms, 13 bars without one in a row clear."""
    df = X.with_returns(B.bars_daily(spark, sf_dir)).withColumn("bad", F.coalesce((c("r") < -0.025).cast("double"), F.lit(0.0)))
    return FO.fold_column(df, "bad", lambda x: np.array(halts((x > 0).tolist()), float), "halted").withColumn("halted", c("halted") > 0)


@query("FLD-09", sql_of(f"select {ID}, coalesce({HALTED}, false) as halted from r1", "", RET))
def fld_09(spark, sf_dir):
    return halted_bars(spark, sf_dir)


@query("FLD-13")
def fld_13(spark, sf_dir):
    """What each bar decides: its state, the target, what the rules and halts approve, why, and what is ordered for the next open."""
    return EN.run_engine(engine_bars(spark, sf_dir)).select("instrument", "timestamp", "status", "target", "approved", "reason", "ordered")


@query("FLD-14", digits=4)  # a capital that many fills went through
def fld_14(spark, sf_dir):
    """What each bar's open fills, and the ledger after it."""
    return EN.run_engine(engine_bars(spark, sf_dir)).where("filled <> 0").select("instrument", "timestamp", "filled", "fill_price", "units",
        "cash", "equity")


@query("FLD-15",
    sql_of("select instrument, least(count(*), 200)::bigint as warm_up, min(\"timestamp\") filter (where n = 201) as running_from from o group by 1",
    "", RET + f", o as (select *, row_number() {ORDER} as n from r1)"))
def fld_15(spark, sf_dir):
    """How long an instrument warms up, and from when on it decides."""
    rows = EN.run_engine(engine_bars(spark, sf_dir))
    return rows.groupBy("instrument").agg(F.count_if(c("status") == "INITIALIZING").alias("warm_up"),
        F.min(F.when(c("status").isin("RUNNING", "HALTED"), c("timestamp"))).alias("running_from"))


@query("FLD-19",
    sql_of("select instrument, max(\"timestamp\") as snapshot_end from bars where \"timestamp\" <= timestamp '2024-01-20' group by 1", "",
    BARS_15M))
def fld_19(spark, sf_dir):
    import datetime as dt

    end = F.lit(dt.datetime(2024, 1, 20)).cast("timestamp")
    return B.bars_15m(spark, sf_dir).where(c("timestamp") <= end).groupBy("instrument").agg(F.max("timestamp").alias("snapshot_end"))


STATES = RET + f""", o as (select *, row_number() {ORDER} as n, coalesce({HALTED}, false) as halted from r1), s as (select *, case when n <= 200 then 'INITIALIZING' when halted then 'HALTED' else 'RUNNING' end as state, n % 7 - 3 as wanted from o)"""


@query("API-10",
    sql_of("select instrument, \"timestamp\", state, wanted::int as wanted, (case when state = 'INITIALIZING' or (state = 'HALTED' and wanted > 0) then 0 else wanted end)::int as allowed from s",
    "", STATES))
def api_10(spark, sf_dir):
    """Orders a state allows: none while initialising, only those that flatten (here a long position) while halted."""
    n = F.row_number().over(B.by_time())
    state = F.when(n <= 200, "INITIALIZING").when(c("halted"), "HALTED").otherwise("RUNNING")
    df = halted_bars(spark, sf_dir).select("instrument", "timestamp", state.alias("state"), (n % 7 - 3).alias("wanted"))
    return df.withColumn("allowed", F.when((c("state") == "INITIALIZING") | ((c("state") == "HALTED") & (c("wanted") > 0)),
        0).otherwise(c("wanted")))


# --- streaming, over the deal tape as it arrives
def _name():
    return f"s{uuid.uuid4().hex}"


@query("REL-24",
    sql_of("select instrument, \"timestamp\", open, high, low, close, volume, deal_count from bars where \"timestamp\" + interval 15 minutes <= (select max(\"timestamp\") from deals) - interval 20 seconds",
    "open high low close volume", BARS_15M))
def rel_24(spark, sf_dir):
    return J.replay(B.deals(spark, sf_dir), J.stream_bars, _name())


@query("SRC-15")
def src_15(spark, sf_dir):
    return J.replay(B.deals(spark, sf_dir), lambda ticks: J.stream_event_bars(ticks, 1000.0), _name())


@query("REL-24-session",
    sql_of("""select instrument, s as start, e as "end", n, volume from (select instrument, min("timestamp") as s, max("timestamp") + interval 30 minutes as e, count(*) as n, sum(size) as volume from
 (select *, sum(fresh) over (partition by instrument order by "timestamp", sequence_id) as k from (select *, case when date_diff('microsecond', lag("timestamp") over (partition by instrument order by "timestamp", sequence_id), "timestamp") >= 1800000000 then 1 else 0 end as fresh from deals)) group by instrument, k)""",
     "volume", DEALS))
def rel_24_session(spark, sf_dir):
    """The batch form of the session windows."""
    g = B.deals(spark, sf_dir).groupBy("instrument", F.session_window("timestamp", "30 minutes").alias("w")).agg(F.count("*").alias("n"),
        F.sum("size").alias("volume"))
    return g.select("instrument", c("w.start").alias("start"), c("w.end").alias("end"), "n", "volume")


# --- relational surface
def t(spark, sf_dir, name):
    return B.table(spark, sf_dir, name)


def rel(key, sql, doubles=""):
    return query(key, sql_of(sql, doubles, NONE))


@rel("REL-01", "select n_name, count(*) as n, sum(c_acctbal) as balance from customer join nation on c_nationkey = n_nationkey group by 1",
    "balance")
def rel_01(spark, sf_dir):
    j = t(spark, sf_dir, "customer").join(F.broadcast(t(spark, sf_dir, "nation")), c("c_nationkey") == c("n_nationkey"))  # 25 nations
    return j.groupBy("n_name").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("balance"))


@rel("REL-02",
    "select o_orderstatus, count(*) as n, sum(l_quantity) as quantity from orders join lineitem on o_orderkey = l_orderkey group by 1",
    "quantity")
def rel_02(spark, sf_dir):
    j = t(spark, sf_dir, "orders").hint("merge").join(t(spark, sf_dir, "lineitem"), c("o_orderkey") == c("l_orderkey"))
    return j.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@rel("REL-03",
    "select b as band, count(*) as n from orders join (select k as b, k * 50000.0 as lo, (k + 1) * 50000.0 as hi from generate_series(0, 9) g(k)) on o_totalprice >= lo and o_totalprice < hi group by 1")
def rel_03(spark, sf_dir):
    bands = spark.range(10).select(c("id").alias("band"), (c("id") * 50000.0).alias("lo"), ((c("id") + 1) * 50000.0).alias("hi"))
    return t(spark, sf_dir, "orders").join(F.broadcast(bands),
        (c("o_totalprice") >= c("lo")) & (c("o_totalprice") < c("hi"))).groupBy("band").agg(F.count("*").alias("n"))


@rel("REL-06",
    "select count(*) as n, count(o_orderkey) as left_hits, count(c_custkey) as right_hits from orders full join customer on o_custkey = c_custkey and o_orderstatus = 'F'")
def rel_06(spark, sf_dir):
    o, u = t(spark, sf_dir, "orders"), t(spark, sf_dir, "customer")
    return o.join(u, (c("o_custkey") == c("c_custkey")) & (c("o_orderstatus") == "F"), "full").agg(F.count("*").alias("n"),
        F.count("o_orderkey").alias("left_hits"), F.count("c_custkey").alias("right_hits"))


@rel("REL-07",
    "select 'semi' as kind, count(*) as n from customer where exists (select 1 from orders where o_custkey = c_custkey) union all select 'anti', count(*) from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def rel_07(spark, sf_dir):
    o, u = t(spark, sf_dir, "orders"), t(spark, sf_dir, "customer")
    one = lambda how: u.join(o, c("c_custkey") == c("o_custkey"), f"left_{how}").agg(F.lit(how).alias("kind"),
        F.count("*").alias("n"))
    return one("semi").unionByName(one("anti"))


@rel("REL-08",
    "select l_returnflag, l_linestatus, sum(l_quantity) as qty, avg(l_discount) as disc, count(*) as n from lineitem group by 1, 2",
    "qty disc")
def rel_08(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"),
        F.avg("l_discount").alias("disc"), F.count("*").alias("n"))


@rel("REL-09", "select l_returnflag, median(l_extendedprice) as med from lineitem group by 1", "med")
def rel_09(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.percentile("l_extendedprice", F.lit(0.5)).alias("med"))


@rel("REL-10", "select l_returnflag, count(distinct l_suppkey) as suppliers from lineitem group by 1")
def rel_10(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("suppliers"))


@rel("REL-11", "select l_returnflag, l_linestatus, sum(l_quantity) as qty from lineitem group by cube (l_returnflag, l_linestatus)", "qty")
def rel_11(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"))


@rel("REL-12",
    "select o_orderstatus, sum(case when o_orderpriority like '1%' then o_totalprice end) as urgent, sum(case when o_orderpriority not like '1%' then o_totalprice end) as other from orders group by 1",
    "urgent other")
def rel_12(spark, sf_dir):
    o = t(spark, sf_dir, "orders").withColumn("p", F.when(c("o_orderpriority").startswith("1"), "urgent").otherwise("other"))
    return o.groupBy("o_orderstatus").pivot("p", ["urgent", "other"]).agg(F.sum("o_totalprice"))


@rel("REL-13",
    "select o_orderkey, rank() over (partition by o_custkey order by o_totalprice desc) as r, ntile(4) over (partition by o_custkey order by o_totalprice desc, o_orderkey) as q from orders")
def rel_13(spark, sf_dir):
    w = Window.partitionBy("o_custkey")
    return t(spark, sf_dir, "orders").select("o_orderkey", F.rank().over(w.orderBy(c("o_totalprice").desc())).cast("long").alias("r"),
        F.ntile(4).over(w.orderBy(c("o_totalprice").desc(), "o_orderkey")).cast("long").alias("q"))


@rel("REL-14",
    "select o_orderkey, lag(o_totalprice) over w as before, lead(o_totalprice) over w as after, first_value(o_totalprice) over w as first from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)",
    "before after first")
def rel_14(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t(spark, sf_dir, "orders").select("o_orderkey", F.lag("o_totalprice").over(w).alias("before"),
        F.lead("o_totalprice").over(w).alias("after"), F.first("o_totalprice").over(w).alias("first"))


@rel("REL-15",
    "select o_orderkey, sum(o_totalprice) over (partition by o_custkey order by o_orderdate range between interval 90 days preceding and current row) as s from orders",
    "s")
def rel_15(spark, sf_dir):
    t(spark, sf_dir, "orders").createOrReplaceTempView("_orders")
    return spark.sql("select o_orderkey, sum(o_totalprice) over (partition by o_custkey order by o_orderdate range between interval 90 days preceding and current row) as s from _orders")


@rel("REL-16", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100", "o_totalprice")
def rel_16(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(c("o_totalprice").desc(), "o_orderkey").limit(100)


@rel("REL-17", "select l_suppkey from lineitem where l_returnflag = 'A' intersect select l_suppkey from lineitem where l_returnflag = 'R'")
def rel_17(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem")
    return li.where("l_returnflag = 'A'").select("l_suppkey").intersect(li.where("l_returnflag = 'R'").select("l_suppkey"))


@rel("REL-18",
    "select c_custkey, regexp_extract(c_name, '([0-9]+)', 1) as digits, upper(c_mktsegment) as seg, lpad(c_custkey::varchar, 8, '0') as padded from customer")
def rel_18(spark, sf_dir):
    return t(spark, sf_dir, "customer").select("c_custkey", F.regexp_extract("c_name", "([0-9]+)", 1).alias("digits"),
        F.upper("c_mktsegment").alias("seg"), F.lpad(c("c_custkey").cast("string"), 8, "0").alias("padded"))


@rel("REL-19",
    "select o_orderkey, isodow(o_orderdate) as dow, last_day(o_orderdate) as eom, (o_orderdate + interval 10 days)::date as plus from orders")
def rel_19(spark, sf_dir):
    d = c("o_orderdate")
    return t(spark, sf_dir, "orders").select("o_orderkey", (F.weekday(d) + 1).cast("long").alias("dow"), F.last_day(d).alias("eom"),
        F.date_add(d.cast("date"), 10).alias("plus"))


@rel("REL-20",
    "select o_orderkey, ln(o_totalprice) as a, sqrt(o_totalprice) as b, sign(o_totalprice - 100000)::int as s, greatest(o_totalprice, 1000) as g from orders",
    "a b g")
def rel_20(spark, sf_dir):
    x = c("o_totalprice")
    return t(spark, sf_dir, "orders").select("o_orderkey", F.log(x).alias("a"), F.sqrt(x).alias("b"),
        F.signum(x - 100000).cast("int").alias("s"), F.greatest(x, F.lit(1000.0)).alias("g"))


@rel("REL-21", "select l_orderkey, list_sum(list(l_quantity * 2)) as s, max(l_quantity) as m from lineitem group by 1", "s m")
def rel_21(spark, sf_dir):
    q = F.collect_list("l_quantity")
    g = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(q.alias("q"))
    return g.select("l_orderkey", F.aggregate(F.transform("q", lambda x: x * 2), F.lit(0.0), lambda a, x: a + x).alias("s"),
        F.array_max("q").alias("m"))


@rel("REL-22", "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def rel_22(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@rel("REL-23", "select n from (with recursive r(n) as (select 1 union all select n * 2 from r where n < 1000) select n from r)")
def rel_23(spark, sf_dir):
    return spark.sql("with recursive r(n) as (select 1 union all select n * 2 from r where n < 1000) select n from r")


REL4 = sql_of('select p."timestamp", p.sequence_id, s.price as other from (select * from deals where instrument = \'view\') p asof left join (select * from deals where instrument = \'click\') s on p."timestamp" >= s."timestamp"',
    "other", DEALS)


@query("REL-04", REL4)
def rel_04(spark, sf_dir):
    from barloom.operators.asof import asof_join

    tr = B.deals(spark, sf_dir).withColumn("all", F.lit(1))
    return asof_join(tr.where("instrument = 'view'"), tr.where("instrument = 'click'").select("all", "timestamp",
        c("price").alias("other")), ["all"], ["other"]).select("timestamp", "sequence_id", "other")


@query("REL-05",
    sql_of("select p.sequence_id, count(s.sequence_id) as near from (select * from deals where instrument = 'view') p left join (select * from deals where instrument = 'purchase') s on s.\"timestamp\" between p.\"timestamp\" - interval 10 minutes and p.\"timestamp\" group by 1",
    "", DEALS))
def rel_05(spark, sf_dir):
    """Interval join by buckets of the interval's length: an equi-join on the bucket and the one before."""
    tr = B.deals(spark, sf_dir)
    bucket = F.floor(F.unix_seconds("timestamp") / 600)
    p = tr.where("instrument = 'view'").select("sequence_id", "timestamp", F.explode(F.array(bucket, bucket - 1)).alias("b"))
    s = tr.where("instrument = 'purchase'").select(c("timestamp").alias("t2"), bucket.alias("b"))
    hit = p.join(s,
        "b").where((c("t2") <= c("timestamp")) & (F.unix_micros("t2") >= F.unix_micros("timestamp") - 600_000_000)).groupBy("sequence_id").agg(F.count("*").alias("n"))
    return tr.where("instrument = 'view'").select("sequence_id").join(hit, "sequence_id", "left").select("sequence_id",
        F.coalesce("n", F.lit(0)).alias("near"))


@query("REL-25", sql_of("select instrument, stddev_pop(close) as sd from bars group by 1", "sd", BARS_DAILY, 4), 4)
def rel_25(spark, sf_dir):
    """A grouped-aggregate pandas UDF."""
    @F.pandas_udf("double")
    def sd(x: pd.Series) -> float:
        return float(x.std(ddof=0))

    return B.bars_daily(spark, sf_dir).groupBy("instrument").agg(sd("close").alias("sd"))


