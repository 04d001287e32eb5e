"""Retrains with a parameter grid, and walks over windows of retrains, as Spark jobs.

Every phase is a table under one folder, made from the tables before it:

    windows            which rows each window trains on, and which it deals on
    fold_forecasts     a task for each (instrument, window, fold): all grid points, with and without fractional inputs, from one binning
    fold_scores        a task for each (instrument, window, inputs, grid point): calibrated in the order of time, simulated, measured
    choices            the grid point of the best mean score of each (instrument, window, inputs)
    holdout_forecasts  the chosen points refitted on all inner rows, forecasting the untouched newest rows of the window once
    reports            holdout results, the difference between both inputs, acceptance
    carried            the model each window trades: its own or the last one (full, baseline), the last accepted one (production)
    oos_forecasts      chosen models refitted on all rows of their window, forecasting the rows of the windows that carry them
    results            simulated rows of each variant over all windows

Rows count those of an instrument that have every input and label, from 0. A window needs LEAST of them, and fits none otherwise.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.operators import folds as FO
from barloom.operators import fractional as FR
from barloom.operators import models as MO
from barloom.operators import training as T
from barloom.operators.boosting import Trees, boost
from barloom.sources.access import open_holdout
from barloom.sources.bars import KEY, TIME, by_time, fresh_path, stored

#: fixed values: the default grid (rounds, least rows of a leaf), and one for walks over many windows
GRID = [(rounds, least) for rounds in (150, 300, 600) for least in (50, 200)]
WALK_GRID = [(100, 20), (100, 50)]
INPUTS = {"full": T.FULL, "baseline": T.BASELINE}
LEAST, FOLDS, FIRST_TRAIN, FOLD_SHARE, HOLDOUT = 200, 5, 0.4, 0.1, 0.15
#: fixed values: how a score weighs turnover and drawdown against the Sharpe ratio
TURNOVER_WEIGHT, DRAWDOWN_WEIGHT, DRAWDOWN_REFERENCE = 0.25, 0.25, 0.10
HOLDOUT_PART, PRODUCTION_PART = FOLDS + 1, FOLDS + 2
AT = [KEY, "window"]
#: fixed value: the tasks that fits are dealt to
TASKS = 256
#: the windows of a walk, all in the rows between its first training block and the locked holdout
WINDOWS, FIRST, LOCKED = T.WINDOWS, T.FIRST, 0.15
c = F.col


def positioned(rows: DataFrame) -> DataFrame:
    """rows with bar (place in the series), ok (whether it is a row), row (rows before it) and n (rows in all)."""
    need = [*T.BASELINE, *T.EXEC, "y_norm", "sigma", "open_next2", "cost_side", "log_close"]
    finite = F.lit(True)
    for name in need:
        finite = finite & c(name).isNotNull() & ~F.isnan(name) & (F.abs(name) != math.inf)
    out = rows.withColumn("bar", (F.row_number().over(by_time()) - 1).cast("long"))
    out = out.withColumn("ok", finite & (c("bar") >= FR.MAX_LAGS))
    before = F.coalesce(F.sum(c("ok").cast("long")).over(by_time().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return out.withColumns({"row": before, "n": F.sum(c("ok").cast("long")).over(Window.partitionBy(KEY))})


def sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy(KEY).agg(F.max("n").alias("n"))


def whole_window(rows: DataFrame) -> DataFrame:
    """One window for each instrument, over all its rows; it deals on none."""
    return sizes(rows).select(KEY, F.lit(0).alias("window"), F.lit(0).cast("long").alias("first"), c("n").alias("last"), c("n").alias("oos_start"), c("n").alias("oos_end"))


def walk_windows(rows: DataFrame, count: int = WINDOWS, first: float = FIRST, locked: float = LOCKED, holdout: bool = False) -> DataFrame:
    """The windows of a walk: each trains on as many rows as the first did, less the purge, and deals on the rows that follow. Those
    of the locked share are laid by the same step, and numbered on, for a walk over the holdout."""
    begin, end = F.floor(c("n") * first), F.floor(c("n") * (1 - F.lit(locked)))
    span = end - begin
    at = lambda k: (end if holdout else begin) + F.floor(k * span / count)
    most = F.ceil((c("n") - end) * count / span).cast("int") if holdout else F.lit(count)
    out = sizes(rows).where((span >= count) & (most > 0)).withColumn("k", F.explode(F.sequence(F.lit(0), most - 1)))
    out = out.select(KEY, (c("k") + (count if holdout else 0)).alias("window"), begin.alias("block"), at(c("k")).alias("oos_start"), F.least(c("n"), at(c("k") + 1)).alias("oos_end"))
    out = out.where("oos_end > oos_start")
    return out.select(KEY, "window", F.greatest(c("oos_start") - c("block"), F.lit(0)).alias("first"), F.greatest(c("oos_start") - T.PURGE, F.lit(0)).alias("last"), "oos_start", "oos_end")


def layout(windows: DataFrame) -> DataFrame:
    """windows with m (training rows), inner_end and holdout_start, counted from the window's first row; those with too few rows go."""
    m = c("last") - c("first")
    start = F.floor(m * (1 - F.lit(HOLDOUT)))
    return windows.withColumns({"m": m, "holdout_start": start, "inner_end": start - T.PURGE}).where(c("m") >= LEAST)


def fold_parts(windows: DataFrame) -> DataFrame:
    """(part, train_end, start, end) of the folds 1 to FOLDS of each window's inner rows, and of part 0: the later share of the first
    training block, forecast from the earlier, which calibrates the first fold."""
    edge = lambda k: F.least(c("inner_end"), F.floor(c("inner_end") * (FIRST_TRAIN + k * F.lit(FOLD_SHARE))))
    fold = lambda k: F.struct(F.lit(k).alias("part"), (edge(k - 1) - T.PURGE).alias("train_end"), (edge(k - 1) + T.PURGE).alias("start"), edge(k).alias("end"))
    block = edge(0) - T.PURGE
    split = F.floor(block * (1 - F.lit(T.INNER)))
    inner = F.struct(F.lit(0).alias("part"), (split - T.PURGE).alias("train_end"), (split + T.PURGE).alias("start"), block.alias("end"))
    return layout(windows).select(*AT, "first", F.explode(F.array(inner, *[fold(k) for k in range(1, FOLDS + 1)])).alias("p")).select(*AT, "first", "p.*", c("p.train_end").alias("d_end"))


FORECASTS = f"{KEY} string, window int, part int, inputs string, rounds int, least int, bar long, m double, p double, d double, digest string"


def order_at(log_close: np.ndarray) -> float:
    """The smallest stationary order of a series; without one, that of the smallest statistic."""
    seen = []
    for d in FR.CANDIDATES:
        f = FR.np_transform(log_close, d)
        f = f[np.isfinite(f)]
        if len(f) >= FR.LEAST and np.ptp(f) > 0:
            (stat, p), (_, q) = FR.adf(f), FR.kpss(f)
            if p < 0.05 and q > 0.05:
                return float(d)
            seen.append((stat, d))
    return float(min(seen)[1]) if seen else 0.4


def forecasts(rows: DataFrame, parts: DataFrame, grid: list[tuple[int, int]] | None) -> DataFrame:
    """FORECASTS of parts (window, first, part, train_end, start, end, d_end, counted from first): a task for each (window, part) fits
    every point of grid, or without one the points that the part names (full_rounds, full_least, baseline_rounds, baseline_least).

    A task gets the bars of its rows and the lags before them. The order is that of the bars up to the last label of row d_end - 1."""
    names = [x.split()[0] for x in FORECASTS.split(", ")]
    extra = [] if grid else POINTS

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        made = prepared(pdf)
        if made is None:
            return pd.DataFrame(columns=names)
        own, bars, train, wanted, x, y, d = made
        points = {k: grid or [(int(own[f"{k}_rounds"]), int(own[f"{k}_least"]))] for k in INPUTS}
        fits = list(dict.fromkeys((k, least) for k in INPUTS for _, least in points[k]))
        m, _, digests = boost(x[train], y, x[wanted], [(COLUMNS_OF[k], least) for k, least in fits], sorted({r for v in points.values() for r, _ in v}), Trees())
        p = {k: T.Pair(x[train][:, COLUMNS_OF[k]], y).predict(x[wanted][:, COLUMNS_OF[k]])[1] for k in INPUTS}
        out = [pd.DataFrame({"part": int(own["part"]), "inputs": k, "rounds": r, "least": least, "bar": bars[wanted], "m": m[fits.index((k, least)), r], "p": p[k], "d": d, "digest": digests[fits.index((k, least)), r]})
               for k in INPUTS for r, least in points[k]]
        return pd.concat(out).assign(**{KEY: own[KEY], "window": int(own["window"])})[names]

    return task_bars(rows, parts, extra).groupBy(*AT, "part").applyInPandas(run, FORECASTS)


COLUMNS_OF = {k: [T.FULL.index(n) for n in columns] for k, columns in INPUTS.items()}
POINTS = [f"{k}_{v}" for k in INPUTS for v in ("rounds", "least")]


def prepared(pdf: pd.DataFrame, order: float | None = None) -> tuple | None:
    """Of a task: its part, bars, training and wanted places, inputs of all bars, labels of the training rows, and the order, which is
    the task's own if none is given."""
    pdf = pdf.sort_values("bar")
    own, rel, ok = pdf.iloc[0], (pdf["row"] - pdf["first"]).to_numpy(), pdf["ok"].to_numpy(bool)
    train, wanted = np.flatnonzero(ok & (rel >= 0) & (rel < own["train_end"])), np.flatnonzero(ok & (rel >= own["start"]) & (rel < own["end"]))
    if not len(train) or not len(wanted):
        return None
    close = pdf["log_close"].to_numpy(float)
    known = np.flatnonzero(ok & (rel >= 0) & (rel < own["d_end"]))
    d = order_at(close[: known[-1] + 2 + T.HORIZON]) if order is None else order
    made = {**{n: pdf[n].to_numpy(float) for n in T.BASELINE}, "frac": FR.np_transform(close, d)}
    return own, pdf["bar"].to_numpy(), train, wanted, np.column_stack([made[n] for n in T.FULL]), pdf["y_norm"].to_numpy(float)[train], d


def task_bars(rows: DataFrame, parts: DataFrame, extra: list[str], inputs: list[str] = T.BASELINE) -> DataFrame:
    """The bars that each part needs: from the lags before its first row to the last label behind its rows and d_end."""
    reach = parts.withColumn("stop", F.greatest("end", "d_end"))
    bars = rows.select(KEY, "bar", "row", "ok", "y_norm", *inputs, "log_close")
    starts = rows.where("ok").select(KEY, c("row").alias("first"), c("bar").alias("first_bar"))
    met = bars.join(reach.join(starts, [KEY, "first"]), KEY).where((c("bar") >= c("first_bar") - FR.MAX_LAGS) & (c("row") - c("first") < c("stop") + 2 + T.HORIZON))
    met = met.select(*AT, "part", "first", "train_end", "start", "end", "d_end", *extra, *[n for n in bars.columns if n != KEY])
    return met.repartition(TASKS, *AT, "part")  # few bytes, much work: adaptive execution would put many parts into one task


def split_part(rows: DataFrame, share: float = 0.6) -> DataFrame:
    """One part of each instrument: its first rows train, the rest is forecast."""
    cut = F.floor(c("m") * share)
    return layout(whole_window(rows)).select(*AT, "first", F.lit(1).alias("part"), (cut - T.PURGE).alias("train_end"), cut.alias("start"), c("m").alias("end"), (cut - T.PURGE).alias("d_end"))


def importance(rows: DataFrame, parts: DataFrame, rounds: int, least: int) -> DataFrame:
    """(window, part, feature, splits): how often the fit of a part splits on each input."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        made = prepared(pdf)
        if made is None:
            return pd.DataFrame(columns=names)
        own, _, train, wanted, x, y, _ = made
        uses = boost(x[train], y, x[wanted[:1]], [(COLUMNS_OF["full"], least)], [rounds], Trees())[1][0, rounds]
        return pd.DataFrame({KEY: own[KEY], "window": int(own["window"]), "part": int(own["part"]), "feature": T.FULL, "splits": uses.astype(int)})

    names = [KEY, "window", "part", "feature", "splits"]
    return task_bars(rows, parts, []).groupBy(*AT, "part").applyInPandas(run, f"{KEY} string, window int, part int, feature string, splits long")


class Trial(T.Series):
    """Rows of one window: their forecasts, and what calibrating and simulating them needs."""

    def __init__(self, pdf: pd.DataFrame):
        pdf = pdf.sort_values(["part", "bar"])
        self.a = {n: pdf[n].to_numpy(float) for n in SCORED} | {n: np.zeros(len(pdf)) for n in ("window", "er", "adverse", "uncertainty")}
        self.part, m, self.p = pdf["part"].to_numpy(), pdf["m"].to_numpy(float), pdf["p"].to_numpy(float)
        self.forecast = np.where(np.sign(m) == np.sign(self.p - 0.5), m * np.abs(2 * self.p - 1), 0.0)
        self.first = pdf.iloc[0]

    def of(self, name: str, rows: np.ndarray) -> np.ndarray:
        return self.a[name][rows]

    def calibrated(self, known: np.ndarray, rows: np.ndarray) -> tuple:
        """Expected returns of rows and their adverse costs, from what was forecast out of sample before."""
        g = MO.Calibrator().fit(self.forecast[known], self.of("y_norm", known))
        ex = T.Adverse(self, known, g.predict(self.forecast[known]), self.p[known])
        e = g.predict(self.forecast[rows])
        return ex, e, *ex.predict(self, rows, e, self.p[rows])

    def record(self, known: np.ndarray, rows: np.ndarray) -> dict:
        ex, e, adverse, uncertainty = self.calibrated(known, rows)
        a = {n: self.of(n, rows) for n in FO.SIM_COLUMNS} | {"er": e * self.of("sigma", rows) * math.sqrt(T.HORIZON), "adverse": adverse, "uncertainty": uncertainty}
        out = FO.simulate(a, FO.SimParams())[0]
        r = T.measure(out["pnl"], e, self.of("y", rows))
        turnover = float(np.abs(np.diff(out["exposure"], prepend=0.0)).mean())
        return r | {"score": r["sharpe"] - TURNOVER_WEIGHT * turnover - DRAWDOWN_WEIGHT * r["max_drawdown"] / DRAWDOWN_REFERENCE, "calibration_rows": len(known), "exec_rows": ex.n,
                    "residual_std": ex.residual, "r2": ex.r2, "adverse": float(adverse.mean()), "uncertainty": float(uncertainty.mean())}


MEASURES = "score double, net double, sharpe double, n long, total_return double, max_drawdown double, corr double, accuracy double, profit_factor double, calibration_rows long, exec_rows long, residual_std double, r2 double, adverse double, uncertainty double"
SCORES = f"{KEY} string, window int, inputs string, rounds int, least int, fold int, d double, train_bars long, " + MEASURES
REPORTS = f"{KEY} string, window int, inputs string, rounds int, least int, d double, " + MEASURES


def order_forecasts(rows: DataFrame, parts: DataFrame, orders: list[float], rounds: int, least: int) -> DataFrame:
    """FORECASTS with the fractional order held at each of `orders`, whose place stands in `window`: a task for each part makes all
    their channels and fits all their models from one binning. An order is fixed before the part is read, so it sees none of its rows."""
    names = [x.split()[0] for x in FORECASTS.split(", ")]
    plain = [T.FULL.index(n) for n in T.BASELINE]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        made = prepared(pdf, orders[0])
        if made is None:
            return pd.DataFrame(columns=names)
        own, bars, train, wanted, x, y, _ = made
        close = pdf.sort_values("bar")["log_close"].to_numpy(float)
        x = np.column_stack([x[:, plain], *[FR.np_transform(close, d) for d in orders]])
        known = list(range(len(plain)))
        m, _, digests = boost(x[train], y, x[wanted], [([*known, len(plain) + k], least) for k in range(len(orders))], [rounds], Trees())
        out = []
        for k, d in enumerate(orders):
            use = [*known, len(plain) + k]
            p = T.Pair(x[train][:, use], y).predict(x[wanted][:, use])[1]
            out.append(pd.DataFrame({"window": k, "bar": bars[wanted], "m": m[k, rounds], "p": p, "d": d, "digest": digests[k, rounds]}))
        return pd.concat(out).assign(**{KEY: own[KEY], "part": int(own["part"]), "inputs": "full", "rounds": rounds, "least": least})[names]

    return task_bars(rows, parts, []).groupBy(*AT, "part").applyInPandas(run, FORECASTS)


def score_by_order(rows: DataFrame, orders: list[float], rounds: int, least: int) -> DataFrame:
    """SCORES of each order in each fold of each instrument's rows; `window` is the place of the order."""
    parts = fold_parts(whole_window(rows))
    made = stored(order_forecasts(rows, parts, orders, rounds, least), name="orders")
    return fold_scores(made, rows, parts.withColumn("window", F.explode(F.sequence(F.lit(0), F.lit(len(orders) - 1)))))


#: what Trial reads of a bar: neither the inputs of the fits nor what a simulation gets from them
SCORED = [n for n in T.COLUMNS if n not in (*T.BASELINE, "window", "er", "adverse", "uncertainty")]


def with_bars(made: DataFrame, rows: DataFrame) -> DataFrame:
    """Forecasts beside the columns of their bars that Trial reads."""
    return made.drop("digest").join(rows.select(KEY, "bar", *SCORED), [KEY, "bar"])


def fold_scores(made: DataFrame, rows: DataFrame, parts: DataFrame) -> DataFrame:
    """SCORES of every grid point and fold: what lies before a fold calibrates it."""
    names = [x.split()[0] for x in SCORES.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s, out = Trial(pdf), []
        d = pdf.groupby("part")["d"].first()
        for fold in range(1, FOLDS + 1):
            mine, known = np.flatnonzero(s.part == fold), np.flatnonzero(s.part < fold)
            if len(mine) and len(known):
                out.append({"fold": fold, "d": d[fold], **s.record(known, mine)})
        own = {n: s.first[n] for n in (*AT, "inputs", "rounds", "least")}
        return pd.DataFrame([own | r for r in out], columns=[n for n in names if n != "train_bars"])

    schema = ", ".join(x for x in SCORES.split(", ") if not x.startswith("train_bars"))
    scored = with_bars(made, rows).groupBy(*AT, "inputs", "rounds", "least").applyInPandas(run, schema)
    ends = parts.select(*AT, c("part").alias("fold"), (c("first") + c("train_end") - 1).alias("row"))
    last = ends.join(rows.where("ok").select(KEY, "row", (c("bar") + 2 + T.HORIZON).alias("train_bars")), [KEY, "row"]).drop("row")
    return scored.join(last, [*AT, "fold"]).select(*names)


def choices(scores: DataFrame, grid: list[tuple[int, int]]) -> DataFrame:
    """(window, inputs, rounds, least, mean_score, folds): the best mean score over the folds, the first of the grid among equal ones."""
    spark = scores.sparkSession
    order = spark.createDataFrame([(r, least, k) for k, (r, least) in enumerate(grid)], "rounds int, least int, k int")
    mean = scores.groupBy(*AT, "inputs", "rounds", "least").agg(F.round(F.avg("score"), 9).alias("mean_score"), F.count("*").alias("folds"))
    best = Window.partitionBy(*AT, "inputs").orderBy(c("mean_score").desc(), "k")
    return mean.join(F.broadcast(order), ["rounds", "least"]).withColumn("place", F.row_number().over(best)).where("place = 1").select(*AT, "inputs", "rounds", "least", "mean_score", "folds")


def chosen(windows: DataFrame, picked: DataFrame) -> DataFrame:
    """layout(windows) with the chosen points of both inputs as columns."""
    of = lambda k, v: F.max(F.when(c("inputs") == k, c(v))).alias(f"{k}_{v}")
    return layout(windows).join(picked.groupBy(*AT).agg(*[of(*n.split("_")) for n in POINTS]), AT)


def pooled(made: DataFrame, picked: DataFrame) -> DataFrame:
    """The forecasts of the folds, of the chosen points only."""
    return made.where(c("part").between(1, FOLDS)).join(picked.select(*AT, "inputs", "rounds", "least"), [*AT, "inputs", "rounds", "least"])


def reports(made: DataFrame, held: DataFrame, rows: DataFrame) -> DataFrame:
    """REPORTS of the untouched rows of each window, calibrated on all folds."""
    names = [x.split()[0] for x in REPORTS.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = Trial(pdf)
        mine, known = np.flatnonzero(s.part == HOLDOUT_PART), np.flatnonzero(s.part < HOLDOUT_PART)
        if not len(mine) or not len(known):
            return pd.DataFrame(columns=names)
        own = {n: s.first[n] for n in (*AT, "inputs", "rounds", "least")} | {"d": pdf.loc[pdf["part"] == HOLDOUT_PART, "d"].iloc[0]}
        return pd.DataFrame([own | s.record(known, mine)], columns=names)

    return with_bars(made.unionByName(held), rows).groupBy(*AT, "inputs").applyInPandas(run, REPORTS)


def judged(report: DataFrame, scores: DataFrame, picked: DataFrame) -> DataFrame:
    """A row a window: results of the full inputs on its holdout, delta to the baseline's, folds won, and acceptance."""
    mine = scores.join(picked.select(*AT, "inputs", "rounds", "least"), [*AT, "inputs", "rounds", "least"])
    by = mine.groupBy(*AT, "fold").agg(*[F.max(F.when(c("inputs") == k, c("score"))).alias(k) for k in INPUTS])
    won = by.groupBy(*AT).agg(F.count_if(c("full") > c("baseline")).cast("int").alias("wins"), F.count("*").cast("int").alias("folds"))
    base = report.where("inputs = 'baseline'").select(*AT, c("score").alias("baseline_score"), c("rounds").alias("baseline_rounds"), c("least").alias("baseline_least"))
    out = report.where("inputs = 'full'").drop("inputs").join(base, AT).join(won, AT).withColumn("delta", c("score") - c("baseline_score"))
    checks = MO.accept({n: c(n) for n in ("accuracy", "corr", "net", "profit_factor", "max_drawdown")}, c("wins"), c("delta"))
    passed = F.lit(True)
    for check in checks.values():
        passed = passed & check
    return out.withColumn("accepted", F.coalesce(passed, F.lit(False)))


def carried(windows: DataFrame, report: DataFrame) -> DataFrame:
    """(window, model, deployed, accepted, ...): the last fitted model up to each window, and the last accepted one."""
    up = Window.partitionBy(KEY).orderBy("window").rowsBetween(Window.unboundedPreceding, 0)
    rows = windows.join(report.select(*AT, "accepted", "d", "delta", "rounds", "least"), AT, "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))
    fitted = F.when(c("d").isNotNull(), c("window"))
    return rows.withColumns({"model": F.last(fitted, True).over(up), "deployed": F.last(F.when(c("accepted"), c("window")), True).over(up)})


def production_parts(windows: DataFrame, picked: DataFrame, trades: DataFrame, oldest: DataFrame | None = None) -> DataFrame:
    """Refits on all rows of a window, with the order of its inner rows, for the rows of all windows that carry its model."""
    ends = trades.select(KEY, F.explode(F.array("model", "deployed")).alias("window"), "oos_start", "oos_end").where("window is not null")
    ends = ends.groupBy(*AT).agg(F.min("oos_start").alias("from_row"), F.max("oos_end").alias("to_row"))
    return chosen(windows, picked).join(ends, AT).select(*AT, "first", F.lit(PRODUCTION_PART).alias("part"), c("m").alias("train_end"), (c("from_row") - c("first")).alias("start"),
                                                         (c("to_row") - c("first")).alias("end"), c("inner_end").alias("d_end"), *POINTS)


OOS = f"{KEY} string, window int, inputs string, bar long, e double, adv double, unc double, d double"


def oos_forecasts(made: DataFrame, held: DataFrame, new: DataFrame, rows: DataFrame) -> DataFrame:
    """Expected returns and adverse costs of the rows behind each model's window, calibrated on its folds and its holdout."""
    names = [x.split()[0] for x in OOS.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "bar"])
        s = Trial(pdf)
        mine, known = np.flatnonzero(s.part == PRODUCTION_PART), np.flatnonzero(s.part < PRODUCTION_PART)
        if not len(mine) or not len(known):
            return pd.DataFrame(columns=names)
        _, e, adverse, uncertainty = s.calibrated(known, mine)
        return pd.DataFrame({KEY: s.first[KEY], "window": int(s.first["window"]), "inputs": s.first["inputs"], "bar": pdf["bar"].to_numpy()[mine], "e": e, "adv": adverse, "unc": uncertainty, "d": pdf["d"].to_numpy()[mine]})[names]

    return with_bars(made.unionByName(held).unionByName(new), rows).groupBy(*AT, "inputs").applyInPandas(run, OOS)


#: which inputs a variant forecasts with, and which column of `carried` names its model
VARIANTS = {"full": ("full", "model"), "baseline": ("baseline", "model"), "production": ("full", "deployed")}
RESULTS = f"{KEY} string, variant string, window int, bar long, timestamp timestamp, e double, y double, exposure double, pnl double, deals long"


def traded(trades: DataFrame, made: DataFrame, rows: DataFrame, owner: str = KEY) -> DataFrame:
    """RESULTS of each variant over the rows of all windows, one after the other; flat where it has no model yet. owner: the column of
    trades that says whose account the rows are dealt on, where that isn't the instrument's own."""
    names = [x.split()[0] for x in RESULTS.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([TIME, "bar"])
        a = {n: pdf[n].to_numpy(float) for n in FO.SIM_COLUMNS}
        e = pdf["e"].fillna(0.0).to_numpy(float)
        a |= {"er": e * a["sigma"] * math.sqrt(T.HORIZON), "adverse": pdf["adv"].fillna(0.0).to_numpy(float), "uncertainty": pdf["unc"].fillna(0.0).to_numpy(float)}
        out, closed = FO.simulate(a, FO.SimParams())
        ends = np.bincount([t[1] for t in closed], minlength=len(e)) if closed else np.zeros(len(e), int)
        return pdf.assign(**{KEY: pdf["_owner"]}, window=pdf["own"], e=e, exposure=out["exposure"], pnl=out["pnl"], deals=ends)[names]

    spans = trades.select(KEY, c(owner).alias("_owner"), c("window").alias("own"), "oos_start", "oos_end", F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(i).alias("inputs"), c(m).alias("carrier")) for v, (i, m) in VARIANTS.items()])).alias("v"))
    bars = rows.where("ok").join(spans, KEY).where((c("row") >= c("oos_start")) & (c("row") < c("oos_end")))
    bars = bars.select(KEY, "_owner", TIME, "bar", "own", "y", "v.*", *[n for n in FO.SIM_COLUMNS])
    made = made.select(KEY, c("window").alias("carrier"), "inputs", "bar", "e", "adv", "unc")
    return bars.join(made, [KEY, "carrier", "inputs", "bar"], "left").groupBy("_owner", "variant").applyInPandas(run, RESULTS)


def retrained(rows: DataFrame, windows: DataFrame, grid: list[tuple[int, int]], folder: str) -> dict[str, DataFrame]:
    """The tables up to `reports` of a retrain of each window."""
    out = {"rows": rows, "windows": stored(windows, folder, "windows")}
    parts = fold_parts(out["windows"])
    out["fold_forecasts"] = stored(forecasts(rows, parts, grid), folder, "fold_forecasts")
    out["fold_scores"] = stored(fold_scores(out["fold_forecasts"], rows, parts), folder, "fold_scores")
    out["choices"] = stored(choices(out["fold_scores"], grid), folder, "choices")
    once = chosen(out["windows"], out["choices"]).select(*AT, "first", F.lit(HOLDOUT_PART).alias("part"), c("inner_end").alias("train_end"), (c("holdout_start") + T.PURGE).alias("start"), c("m").alias("end"),
                                                         c("inner_end").alias("d_end"), *POINTS)
    out["holdout_forecasts"] = stored(forecasts(rows, once, None), folder, "holdout_forecasts")
    report = reports(pooled(out["fold_forecasts"], out["choices"]), out["holdout_forecasts"], rows)
    out["reports"] = stored(judged(stored(report, folder, "holdout_results"), out["fold_scores"], out["choices"]), folder, "reports")
    return out


def placed_rows(spark: SparkSession, rows: DataFrame, folder: str) -> DataFrame:
    return stored(positioned(rows), folder, "rows")


def walked(rows: DataFrame, grid: list[tuple[int, int]] = WALK_GRID, folder: str | None = None, locked: float = LOCKED) -> dict[str, DataFrame]:
    """All tables of a walk over the rows before the locked share of each instrument's. rows: training rows of all bars."""
    folder = folder or fresh_path(rows.sparkSession, "walk")
    placed = placed_rows(rows.sparkSession, rows, folder)
    return deal(retrained(placed, walk_windows(placed, locked=locked), grid, folder), folder)


def deal(out: dict[str, DataFrame], folder: str, before: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Adds `carried`, `oos_forecasts` and `results`. before: the tables of a walk whose last models are carried in; of its windows
    only the models are used."""
    rows, trades = out["rows"], carried(out["windows"], out["reports"])
    windows, picked, made, held = out["windows"], out["choices"], pooled(out["fold_forecasts"], out["choices"]), out["holdout_forecasts"]
    if before:
        last = before["carried"].groupBy(KEY).agg(F.max_by("model", "window").alias("_m"), F.max_by("deployed", "window").alias("_p"))
        trades = trades.join(last, KEY, "left").withColumns({"model": F.coalesce("model", "_m"), "deployed": F.coalesce("deployed", "_p")}).drop("_m", "_p")
        windows, picked = windows.unionByName(before["windows"]), picked.unionByName(before["choices"])
        made, held = made.unionByName(pooled(before["fold_forecasts"], before["choices"])), held.unionByName(before["holdout_forecasts"])
    out["carried"] = stored(trades, folder, "carried")
    new = stored(forecasts(rows, production_parts(windows, picked, out["carried"]), None), folder, "production_forecasts")
    out["oos_forecasts"] = stored(oos_forecasts(made, held, new, rows), folder, "oos_forecasts")
    out["results"] = stored(traded(out["carried"], out["oos_forecasts"], rows), folder, "results")
    return out


def holdout_walk(before: dict[str, DataFrame], level: str, log: str, why: str, grid: list[tuple[int, int]] = WALK_GRID, folder: str | None = None, forced: bool = False, levels: tuple[str, ...] = ("VALIDATED CANDIDATE", "HOLDOUT PASSED", "PAPER ELIGIBLE")) -> dict[str, DataFrame]:
    """The walk over the locked rows, with the last models of the development walk `before` carried in. Refused unless development
    reached VALIDATED CANDIDATE; a row is appended to the access log before any locked row is read, and it stays there."""
    if level not in levels and not forced:
        raise PermissionError(f"the holdout stays locked: development is {level}, not {levels[0]}")
    spark = before["rows"].sparkSession
    out = {"access": open_holdout(spark, log, "walk", why)}
    folder = folder or fresh_path(spark, "holdout")
    return deal(out | retrained(before["rows"], walk_windows(before["rows"], holdout=True), grid, folder), folder, before)


def summary(results: DataFrame, year: float = 252.0) -> DataFrame:
    """Results of each instrument and variant: net, sharpe, total_return, max_drawdown, profit_factor, deals and rows. A path per
    instrument and variant: running equity needs their order."""
    return measured(results, [KEY, "variant"], year)


def measured(results: DataFrame, by: list[str], year: float = 252.0) -> DataFrame:
    """Measures of each group of results, its rows in the order of their bars."""
    sharpe = F.when(F.stddev_pop("pnl") > 0, F.avg("pnl") / F.stddev_pop("pnl") * math.sqrt(year)).otherwise(0.0)
    order = Window.partitionBy(*by).orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
    rows = results.withColumn("_eq", F.exp(F.sum(F.log1p("pnl")).over(order)))
    rows = rows.withColumn("_dd", 1 - c("_eq") / F.greatest(F.max("_eq").over(order), F.lit(1.0)))
    lost = -F.sum(F.when(c("pnl") < 0, c("pnl")).otherwise(0.0))
    return rows.groupBy(*by).agg(F.sum("pnl").alias("net"), sharpe.alias("sharpe"), (F.exp(F.sum(F.log1p("pnl"))) - 1).alias("total_return"), F.max("_dd").alias("max_drawdown"),
                                 F.when(lost > 0, F.sum(F.when(c("pnl") > 0, c("pnl")).otherwise(0.0)) / lost).otherwise(0.0).alias("profit_factor"), F.sum("deals").alias("deals"), F.count("*").alias("n"))


def walk_table(out: dict[str, DataFrame]) -> DataFrame:
    """A row for each instrument and window: its training rows, choice, acceptance and models, and the results of each variant in
    the window (net_, window_sharpe_) and over the whole walk (sharpe_, return_, drawdown_, pf_, deals_)."""
    rows = out["rows"].where("ok").select(KEY, "row", "bar")
    edge = lambda at, name, add: rows.select(KEY, c("row").alias(at), (c("bar") + add).alias(name))
    trades = out["carried"].withColumn("_last", c("last") - 1)
    base = trades.join(edge("first", "train_start", 0), [KEY, "first"], "left").join(edge("_last", "train_end", 1), [KEY, "_last"], "left")
    base = base.select(*AT, "train_start", "train_end", (c("oos_end") - c("oos_start")).alias("oos_rows"), "d", "accepted", "delta", "rounds", "least", c("model"), c("deployed"))
    pivot = lambda df, by, names: df.groupBy(*by).agg(*[F.max(F.when(c("variant") == v, F.round(c(col), 6))).alias(f"{n}_{v}") for v in VARIANTS for n, col in names.items()])
    each = pivot(measured(out["results"], [*AT, "variant"]), AT, {"net": "net", "window_sharpe": "sharpe"})
    total = pivot(summary(out["results"]), [KEY], {"sharpe": "sharpe", "return": "total_return", "drawdown": "max_drawdown", "pf": "profit_factor", "deals": "deals"})
    return base.join(each, AT, "left").join(total, KEY, "left")
