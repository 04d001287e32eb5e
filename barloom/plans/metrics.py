"""Queries: aggregations, resampling statistics, stress and sanity scenarios, baselines, ablations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.operators import folds as FO
from barloom.operators import metrics as M
from barloom.operators import stats as ST
from barloom.operators import training as T
from barloom.plans.base import ORDER, query, sql_of
from barloom.plans.decisions import EXPO, LAB, PRESCRIBED, SIM, labelled, prescribed, sim_rows
from barloom.plans.windows import RET, WIN15, ret, tag_regimes
from barloom.sources.bars import by_time

c = F.col
PRE = SIM.split(", sim(")[0] + ", " + EXPO + f""", p0 as (select *, {PRESCRIBED} as pnl, row_number() {ORDER} as k from q2),
p1 as (select *, exp(sum(ln(1 + pnl)) {ORDER}) as equity, (k - 1) // 250 as w from p0), p as (select *, 1 - equity / greatest(max(equity) {ORDER}, 1) as drawdown from p1)"""


def pnl(spark, sf_dir):
    df = prescribed(spark, sf_dir).withColumn("w", F.floor((F.row_number().over(by_time()) - 1) / 250))
    return M.with_equity(df, ["instrument"])


AGG1 = """select instrument, count(*) as n, product(1 + pnl) - 1 as total_return, avg(pnl) as mean, stddev_pop(pnl) as std, avg(pnl) / nullif(stddev_pop(pnl), 0) * sqrt(252) as sharpe,
 avg(pnl) / nullif(sqrt(avg(pow(least(pnl, 0), 2))), 0) * sqrt(252) as sortino, quantile_cont(pnl, 0.05) as var_95, min(pnl) as worst_bar, max(drawdown) as max_drawdown, avg(abs(q)) as mean_exposure,
 avg((q <> 0)::int) as time_invested, kurtosis_pop(pnl) as kurt, (avg(pow(pnl, 3)) - 3 * avg(pnl) * avg(pnl * pnl) + 2 * pow(avg(pnl), 3)) / pow(stddev_pop(pnl), 3) as skew from p group by 1"""
A1 = "total_return mean std sharpe sortino var_95 worst_bar max_drawdown mean_exposure time_invested kurt skew"


@query("AGG-01",
    sql_of(f"select a.*, (select avg(pnl) from p where p.instrument = a.instrument and pnl <= a.var_95) as es_95 from ({AGG1}) a",
    A1 + " es_95", PRE, 5), 5)
def agg_01(spark, sf_dir):
    return M.performance(pnl(spark, sf_dir), ["instrument"]).select("instrument", "n", *A1.split(), "es_95")


@query("AGG-02",
    sql_of("select instrument, avg(pnl) * 252 as mean, stddev_pop(pnl) * sqrt(252) as std, sqrt(avg(pow(least(pnl, 0), 2))) * sqrt(252) as downside from p group by 1",
    "mean std downside", PRE))
def agg_02(spark, sf_dir):
    p = M.performance(pnl(spark, sf_dir), ["instrument"])
    return p.select("instrument", (c("mean") * 252).alias("mean"), (c("std") * 252**0.5).alias("std"),
        (c("downside") * 252**0.5).alias("downside"))


@query("AGG-03",
    sql_of(f"""select a.*, coalesce(b.l, 0)::bigint as longest_underwater from (select instrument, max(drawdown) as max_drawdown, arg_max(drawdown, "timestamp") as current_drawdown, sqrt(avg(drawdown * drawdown)) as ulcer from p group by 1) a
 left join (select instrument, max(n) as l from (select instrument, i, count(*) as n from (select *, sum((drawdown <= 0)::int) {ORDER} as i from p) where drawdown > 0 group by 1, 2) group by 1) b using (instrument)""",
     "max_drawdown current_drawdown ulcer", PRE))
def agg_03(spark, sf_dir):
    return M.drawdown_stats(pnl(spark, sf_dir), ["instrument"])


DIST = "count(*) as n, avg(pnl) as mean, median(pnl) as median, stddev_pop(pnl) as std, quantile_cont(pnl, 0.05) as p05, quantile_cont(pnl, 0.25) as p25, quantile_cont(pnl, 0.75) as p75, quantile_cont(pnl, 0.95) as p95, min(pnl) as lowest, max(pnl) as highest, avg((pnl > 0)::int) as positive"
DC = "mean median std p05 p25 p75 p95 lowest highest positive"


@query("AGG-04", sql_of(f"select instrument, {DIST} from p group by 1", DC, PRE))
def agg_04(spark, sf_dir):
    return M.distribution(pnl(spark, sf_dir), ["instrument"], "pnl")


@query("AGG-05",
    sql_of("select instrument, year(\"timestamp\")::int as year, count(*) as n, sum(pnl) as total, avg(pnl) as mean, avg((pnl > 0)::int) as win_rate from p group by 1, 2",
    "total mean win_rate", PRE))
def agg_05(spark, sf_dir):
    return pnl(spark, sf_dir).groupBy("instrument", F.year("timestamp").alias("year")).agg(F.count("*").alias("n"),
        F.sum("pnl").alias("total"), F.avg("pnl").alias("mean"), F.avg((c("pnl") > 0).cast("double")).alias("win_rate"))


@query("AGG-06",
    sql_of("select coalesce(case when grouping(instrument) = 0 then 'instrument' when grouping(y) = 0 then 'year' else 'side' end) as dimension, coalesce(instrument, y::varchar, s::varchar) as value, count(*) as n, sum(pnl) as total from (select instrument, year(\"timestamp\") as y, sign(q)::int as s, pnl from p) group by grouping sets ((instrument), (y), (s))",
    "total", PRE))
def agg_06(spark, sf_dir):
    """Three groupings of the same rows in one pass."""
    df = pnl(spark, sf_dir).select("instrument", F.year("timestamp").alias("y"), F.signum("q").cast("int").alias("s"), "pnl")
    i, y, s = c("instrument"), c("y"), c("s")
    g = df.groupingSets([[i], [y], [s]], i, y, s).agg(F.count("*").alias("n"), F.sum("pnl").alias("total"),
        F.grouping("instrument").alias("gi"), F.grouping("y").alias("gy"))
    return g.select(F.when(c("gi") == 0, "instrument").when(c("gy") == 0, "year").otherwise("side").alias("dimension"),
        F.coalesce("instrument", c("y").cast("string"), c("s").cast("string")).alias("value"), "n", "total")




@query("AGG-07",
    sql_of(f"select instrument, vol_tag, count(*) as bars, product(1 + pnl) - 1 as total_return, avg(pnl) / nullif(stddev_pop(pnl), 0) * sqrt(252) as sharpe, avg((q <> 0)::int) as time_invested from (select p.instrument, p.pnl, p.q, t.vol_tag from p join tags t on p.instrument = t.instrument and p.\"timestamp\" = t.\"timestamp\") group by 1, 2",
    "total_return sharpe time_invested", PRE + f", r2 as (select *, row_number() {ORDER} as rn from r1), tags as ({WIN15})"))
def agg_07(spark, sf_dir):
    tags = tag_regimes(ret(spark, sf_dir)).select("instrument", "timestamp", "vol_tag")
    rows = pnl(spark, sf_dir).drop("equity", "drawdown").join(tags, ["instrument", "timestamp"])
    out = M.performance(M.with_equity(rows, ["instrument", "vol_tag"]), ["instrument", "vol_tag"])
    return out.select("instrument", "vol_tag", c("n").alias("bars"), "total_return", "sharpe", "time_invested")


@query("AGG-08",
    sql_of("select instrument, w as \"window\", count(*) as n, product(1 + pnl) - 1 as total_return, coalesce(avg(pnl) / nullif(stddev_pop(pnl), 0), 0) * sqrt(252) as sharpe, sum(abs(q - q0) * cost_side_exec) as cost from p group by 1, 2",
    "total_return sharpe cost", PRE))
def agg_08(spark, sf_dir):
    g = pnl(spark, sf_dir).groupBy("instrument", c("w").alias("window"))
    return g.agg(F.count("*").alias("n"), M.compounded("pnl").alias("total_return"),
        (M.ratio(F.avg("pnl"), F.stddev_pop("pnl")) * 252**0.5).alias("sharpe"),
        F.sum(F.abs(c("q") - c("q0")) * c("cost_side")).alias("cost"))


@query("AGG-09",
    sql_of("select w as \"window\", sum(case when instrument = 'A' then pnl end) as \"A\", sum(case when instrument = 'N' then pnl end) as \"N\", sum(case when instrument = 'R' then pnl end) as \"R\" from p group by 1",
    "A N R", PRE))
def agg_09(spark, sf_dir):
    return pnl(spark, sf_dir).groupBy(c("w").alias("window")).pivot("instrument", ["A", "N", "R"]).agg(F.sum("pnl"))


@query("AGG-10",
    sql_of("select instrument, coalesce(covar_pop(er, y) / nullif(stddev_pop(case when y is not null then er end) * stddev_pop(case when er is not null then y end), 0), 0) as corr from lab group by 1",
    "corr", LAB))
def agg_10(spark, sf_dir):
    return labelled(spark, sf_dir).groupBy("instrument").agg(M.safe_corr("er", "y").alias("corr"))


@query("AGG-12",
    sql_of("select instrument, coalesce(covar_pop(z, y) / nullif(stddev_pop(case when y is not null then z end) * stddev_pop(case when z is not null then y end), 0), 0) as ic from lab group by 1",
    "ic", LAB))
def agg_12(spark, sf_dir):
    return labelled(spark, sf_dir).groupBy("instrument").agg(M.safe_corr("z", "y").alias("ic"))


@query("AGG-11",
    sql_of("select instrument, coalesce(max(case when t > 0 then t end) / nullif(sum(case when t > 0 then t end), 0), 0) as dominance from (select instrument, w, sum(pnl) as t from p group by 1, 2) group by 1",
    "dominance", PRE))
def agg_11(spark, sf_dir):
    t = pnl(spark, sf_dir).groupBy("instrument", "w").agg(F.sum("pnl").alias("t"))
    up = F.when(c("t") > 0, c("t"))
    return t.groupBy("instrument").agg(M.ratio(F.max(up), F.sum(up)).alias("dominance"))


@query("AGG-13")
def agg_13(spark, sf_dir):
    """Out-of-sample score of each candidate order: the fractional momentum's IC."""
    from barloom.operators.fractional import transformed

    df = transformed(labelled(spark, sf_dir), "log_close", {f"f{k}": d for k, d in enumerate((0.25, 0.5, 0.75))}, ("y",))
    out = df.groupBy("instrument").agg(*[M.safe_corr(f"f{k}", "y").alias(f"d{k}") for k in range(3)])
    return out.select("instrument", F.expr("stack(3, 0.25D, d0, 0.5D, d1, 0.75D, d2) as (d, score)"))


@query("AGG-14", sql_of("select instrument, product(1 + pnl) - 1 as total_return, max(drawdown) as max_drawdown from p group by 1",
    "total_return max_drawdown", PRE))
def agg_14(spark, sf_dir):
    return M.performance(pnl(spark, sf_dir), ["instrument"]).select("instrument", "total_return", "max_drawdown")


@query("AGG-15",
    sql_of("select instrument, \"timestamp\", ln(equity) as log_equity, drawdown, case when w < 6 then 'development' else 'holdout' end as segment from p",
    "log_equity drawdown", PRE))
def agg_15(spark, sf_dir):
    """The holdout's equity is stitched to the development's last value: one running product does both."""
    return pnl(spark, sf_dir).select("instrument", "timestamp", F.log("equity").alias("log_equity"), "drawdown",
        F.when(c("w") < 6, "development").otherwise("holdout").alias("segment"))


@query("AGG-16",
    sql_of("select instrument, w as retrain, t - lag(t) over (partition by instrument order by w) as delta_score from (select instrument, w, sum(pnl) as t from p group by 1, 2)",
    "delta_score", PRE))
def agg_16(spark, sf_dir):
    t = pnl(spark, sf_dir).groupBy("instrument", c("w").alias("retrain")).agg(F.sum("pnl").alias("t"))
    return t.select("instrument", "retrain",
        (c("t") - F.lag("t").over(Window.partitionBy("instrument").orderBy("retrain"))).alias("delta_score"))


@query("AGG-17",
    sql_of("select instrument, count(*) as windows, count_if(t > 0)::bigint as accepted, avg((t > 0)::int) as deployed from (select instrument, w, sum(pnl) as t from p group by 1, 2) group by 1",
    "deployed", PRE))
def agg_17(spark, sf_dir):
    t = pnl(spark, sf_dir).groupBy("instrument", "w").agg(F.sum("pnl").alias("t"))
    return t.groupBy("instrument").agg(F.count("*").alias("windows"), F.count_if(c("t") > 0).alias("accepted"),
        F.avg((c("t") > 0).cast("double")).alias("deployed"))


BASE = FO.SimParams()


# --- resampling: the draws of each instrument fan out as tasks; no series reaches the driver
@query("STA-01")
def sta_01(spark, sf_dir):
    draws = ST.draws_by_key(prescribed(spark, sf_dir), "pnl", "timestamp", ST.block_draw, ST.BLOCK, n=1000)
    return ST.intervals(draws, ["sharpe", "cagr", "total_return", "max_drawdown"], by=("instrument",))


@query("STA-02")
def sta_02(spark, sf_dir):
    """What the fractional inputs add to the Sharpe ratio of each window of the walk, resampled over windows; and the exact sign test."""
    from barloom.plans.base import QUERIES

    deltas = QUERIES["RUN-01-windows"](spark, sf_dir).select("instrument", "window", (c("window_sharpe_full") - c("window_sharpe_baseline")).alias("delta"))

    def one(delta, k):
        return *ST.ablation_draw(delta, k), ST.sign_test(delta)

    draws = ST.draws_by_key(deltas, "delta", "window", one, ST.ABLATION + ", p_sign double", n=5000)
    sign = draws.groupBy("instrument").agg(F.first("p_sign").alias("p_sign"))
    return ST.intervals(draws, ["mean", "median"], by=("instrument",)).join(sign, "instrument")


@query("STA-03")
def sta_03(spark, sf_dir):
    """The net results of closed positions, drawn in random order with replacement."""
    closed = FO.simulate_frame(sim_rows(spark, sf_dir), {"base": BASE}, want_deals=True).withColumn("instrument", F.split("key", "/")[0])
    return ST.intervals(ST.draws_by_key(closed, "net", "entry_row", ST.deals_draw, ST.DEALS, n=2000), ["terminal", "max_drawdown"],
        by=("instrument",))


@query("STA-04")
def sta_04(spark, sf_dir):
    """t, p and the corrected p of each instrument's Sharpe ratio, for as many tests as there are windows and instruments."""
    p = M.performance(pnl(spark, sf_dir), ["instrument"]).select("instrument", "sharpe", "n").collect()  # a row an instrument
    rows = [(r.instrument, k, float(v)) for r in p for k, v in ST.multiple_testing(r.sharpe, r.n, 252.0, 12 * len(p)).items()]
    return spark.createDataFrame(rows, "instrument string, name string, value double")


# --- scenarios: name -> parameters; all fan out in one job
def scenario_metrics(spark, sf_dir, params):
    rows = FO.simulate_frame(sim_rows(spark, sf_dir), params).withColumnRenamed("exposure", "q").drop("equity")
    rows = rows.withColumns({"instrument": F.split("key", "/")[0], "scenario": F.split("key", "/")[1]})
    out = M.performance(M.with_equity(rows, ["instrument", "scenario"]), ["instrument", "scenario"])
    return out.select("instrument", "scenario", "total_return", "sharpe", "max_drawdown", "mean_exposure")


@query("STR-01", None, 3)  # total returns run into millions: fewer decimals than doubles hold
def str_01(spark, sf_dir):
    """Cost curve: realised costs scaled with decisions frozen, decisions that expect other costs, and fixed costs of some basis
    points a round trip; with the level of each kind at which the return crosses 0 (null where it doesn't)."""
    out = {f"realised_{x}": FO.scenario(cost_scale=x) for x in (0.0, 0.5, 1.0, 1.5, 2.0, 3.0,
        5.0)} | {f"signal_{x}": FO.scenario(signal_cost_scale=x) for x in (0.5, 1.0, 2.0)}
    out |= {f"bps_{x}": FO.scenario(cost_bps=float(x)) for x in (0, 1, 2, 5, 10, 20, 50)}
    df = scenario_metrics(spark, sf_dir, out).withColumns({"kind": F.split("scenario", "_")[0],
        "level": F.split("scenario", "_")[1].cast("double")})
    w = Window.partitionBy("instrument", "kind").orderBy("level")
    before, level = F.lag("total_return").over(w), F.lag("level").over(w)
    crossing = F.when((before > 0) & (c("total_return") <= 0), level + (c("level") - level) * before / (before - c("total_return")))
    return df.withColumn("_x", crossing).withColumn("break_even", F.min("_x").over(Window.partitionBy("instrument", "kind"))).drop("_x")


@query("STR-02")
def str_02(spark, sf_dir):
    """Frozen decisions at each cost level and delay, and decisions that know the level."""
    levels = (0.5, 1.0, 1.5, 2.0, 3.0)
    # survives: still earns something
    frozen = {f"x{x}_d{d}": FO.scenario(cost_scale=x, delay=d) for x in levels for d in (0, 1, 2, 3)}
    return scenario_metrics(spark, sf_dir, frozen | {f"adaptive_x{x}": FO.scenario(cost_scale=x,
        signal_cost_scale=x) for x in levels}).withColumn("survives", c("total_return") > 0)


@query("STR-03")
def str_03(spark, sf_dir):
    return scenario_metrics(spark, sf_dir, {f"delay_{d}": FO.scenario(delay=d) for d in (0, 1, 2)})


@query("STR-04")
def str_04(spark, sf_dir):
    names = ("min_edge", "buffer", "rebalance", "max_holding", "stop_multiple", "confidence_multiple", "cost_multiple", "vm_high")
    out = {f"{n}_{f}": FO.scenario(**{n: type(getattr(BASE, n))(getattr(BASE, n) * f)}) for n in names for f in (0.5, 2)}
    df = scenario_metrics(spark, sf_dir, out | {"base": BASE})
    base = F.max(F.when(c("scenario") == "base", c("sharpe"))).over(Window.partitionBy("instrument"))
    return df.withColumn("collapsed", (base > 0) & (c("sharpe") < (1 - T.COLLAPSE) * base) & (c("total_return") <= 0))


@query("STR-05")
def str_05(spark, sf_dir):
    """The fractional order a step up and down: correlation of each with the label."""
    from barloom.operators.fractional import transformed

    df = transformed(labelled(spark, sf_dir), "log_close", {f"f{k}": d for k, d in enumerate((0.25, 0.3, 0.35, 0.4, 0.45))}, ("y",))
    return df.groupBy("instrument").agg(*[M.safe_corr(f"f{k}", "y").alias(f"step_{k - 2}".replace("-", "m")) for k in range(5)])


@query("SAN-01")
def san_01(spark, sf_dir):
    """Reversed and shifted forecasts must lose their edge; SAN-01-refits has shuffled labels and inputs, permutations and costs."""
    rows = sim_rows(spark, sf_dir)
    w = by_time()
    variants = {"base": c("er"), "reversed": -c("er"), "shifted": F.coalesce(F.lag("er", 20).over(w), F.lit(0.0)), "zero": F.lit(0.0)}
    out = None
    for name, er in variants.items():
        one = FO.simulate_frame(rows.withColumn("er", er), {name: BASE})
        out = one if out is None else out.unionByName(one)
    return out.groupBy("key").agg(F.sum("pnl").alias("total"), F.count("*").alias("n"))


@query("SAN-02",
    sql_of(f"select instrument, max(abs(y - (ln(o5) - ln(o1)))) as largest, count(y) as n from (select *, lead(open, 5) {ORDER} as o5, lead(open, 1) {ORDER} as o1 from lab) group by 1",
    "largest", LAB))
def san_02(spark, sf_dir):
    df = labelled(spark, sf_dir)
    again = F.log(F.lead("open", 5).over(by_time())) - F.log(F.lead("open", 1).over(by_time()))
    return df.withColumn("d", F.abs(c("y") - again)).groupBy("instrument").agg(F.max("d").alias("largest"), F.count("y").alias("n"))


@query("SAN-03", "select 0::bigint as changed")
def san_03(spark, sf_dir):
    """Bars after a cut are rewritten; features up to it may not change."""
    import datetime as dt

    from barloom.operators import features as X
    from barloom.sources.bars import bars_daily

    at = F.lit(dt.datetime(1998, 1, 1)).cast("timestamp")
    bars = bars_daily(spark, sf_dir)
    other = bars.withColumns({k: F.when(c("timestamp") > at, c(k) * 1.37).otherwise(c(k)) for k in ("open", "high", "low", "close",
        "volume")})
    f = lambda b: X.volume_features(X.return_features(X.with_returns(b))).where(c("timestamp") <= at).select("instrument", "timestamp",
        "return_1", "return_16", "volume_z")
    return f(bars).exceptAll(f(other)).agg(F.count("*").alias("changed"))


@query("SAN-04",
    sql_of(f"select count(*)::bigint as rows, count_if(not (available <= decided and decided <= executed))::bigint as violations from (select \"timestamp\" + interval 1 day as available, \"timestamp\" + interval 1 day as decided, greatest(lead(\"timestamp\") {ORDER}, \"timestamp\" + interval 1 day) as executed from bars) where executed is not null"))
def san_04(spark, sf_dir):
    from barloom.sources.bars import bars_daily

    df = bars_daily(spark, sf_dir)
    close = F.unix_seconds("timestamp") + 86400
    df = df.select(close.alias("available"), close.alias("decided"),
        F.greatest(F.lead(F.unix_seconds("timestamp")).over(by_time()), close).alias("executed")).where("executed is not null")
    return df.agg(F.count("*").alias("rows"),
        F.count_if(~((c("available") <= c("decided")) & (c("decided") <= c("executed")))).alias("violations"))


@query("ABL-02")
def abl_02(spark, sf_dir):
    tags = tag_regimes(ret(spark, sf_dir)).select("instrument", "timestamp", "vol_tag")
    rows = FO.simulate_frame(sim_rows(spark, sf_dir), {"full": BASE}).withColumn("instrument", F.split("key", "/")[0])
    return rows.join(tags, ["instrument", "timestamp"]).groupBy("instrument",
        "vol_tag").agg((M.ratio(F.avg("pnl"), F.stddev_pop("pnl")) * 252**0.5).alias("sharpe"))


SABOTAGE = {"s_flip": lambda x: -x, "s_freeze": lambda x: F.avg(x).over(Window.partitionBy("instrument")),
    "s_delay": lambda x: F.lag(x, 1).over(by_time()), "s_delay2": lambda x: F.lag(x, 2).over(by_time()), "s_remove": lambda x: F.lit(0.0)}


@query("ABL-03",
    sql_of(f"select instrument, sum(-r) as s_flip, count(r) * avg(r) as s_freeze, sum(d1) as s_delay, sum(d2) as s_delay2, 0.0::double as s_remove from (select *, lag(r, 1) {ORDER} as d1, lag(r, 2) {ORDER} as d2 from r1) group by 1",
    "s_flip s_freeze s_delay s_delay2", RET))
def abl_03(spark, sf_dir):
    df = ret(spark, sf_dir).withColumns({k: F.when(c("r").isNotNull() | F.lit(k != "s_freeze"), f(c("r"))) for k, f in SABOTAGE.items()})
    return df.groupBy("instrument").agg(*[F.sum(k).alias(k) for k in SABOTAGE])


@query("BAS-01",
    sql_of("select instrument, 0.0::double as cash, product(1 + coalesce(exp(r) - 1, 0)) - 1 as buy_hold, sum(case when sigma_h > 0 then least(1, 0.1 / (sigma_h * sqrt(252))) * nr end) as vol_scaled from (select *, lead(r) " + ORDER + " as nr from r1) group by 1",
    "cash buy_hold vol_scaled", RET))
def bas_01(spark, sf_dir):
    from barloom.functions.scalars import vol_scaled_exposure

    df = ret(spark, sf_dir).withColumn("nr", F.lead("r").over(by_time()))
    return df.groupBy("instrument").agg(F.lit(0.0).alias("cash"), M.compounded(F.coalesce(F.exp("r") - 1, F.lit(0.0))).alias("buy_hold"),
        F.sum(F.when(c("sigma_h") > 0, vol_scaled_exposure(c("sigma_h"), 252.0)) * c("nr")).alias("vol_scaled"))


