"""Queries: scalar decision functions, labels, folds, and path-dependent operators."""

from __future__ import annotations


from pyspark.sql import functions as F

from barloom.functions import scalars as S
from barloom.functions import windows as W
from barloom.operators import features as X
from barloom.operators import folds as FO
from barloom.operators import labels as L
from barloom.plans.base import BARS_15M, BARS_DAILY, ORDER, DEALS, full, over, query, sql_of
from barloom.plans.windows import RET, ret
from barloom.sources import bars as B

ID = 'instrument, "timestamp"'
#: a forecast without a model: against the last 20 bars' return
FC = RET + f""", f0 as (select *, (ask - bid) / ((ask + bid) / 2) as relative_spread, {full('r', 20, f'avg(r) {over(20)}')} as m20, {full('r', 20, f'stddev_pop(r) {over(20)}')} as s20, median(sigma_h) {over(390)} as sigma_ref from r1),
f1 as (select *, (r - m20) / (s20 + 1e-12) as z from f0), f2 as (select *, case when abs(z) > 1 then -z * sigma_h / 10 else 0 end as er, case when z > 2 then 0.8 else 0.1 end as stress_p from f1),
f3 as (select *, 2e-4 + relative_spread + 0.1 * range_rel as cost, 1e-4 + relative_spread / 2 + 0.05 * range_rel as side_cost from f2)"""


def forecasts(spark, sf_dir, bars=None):
    """bars with returns (the daily ones if none are given), a forecast and its costs."""
    df = B.with_bar_columns(ret(spark, sf_dir) if bars is None else bars)
    return forecast_columns(df.withColumns({"m20": W.rolling_mean("r", 20), "s20": W.rolling_std("r", 20), "sigma_ref": W.reference_sigma("sigma_h", X.REFERENCE)}))


def forecast_columns(df):
    """A forecast of each bar and its costs, from its columns and its windows'."""
    z = (F.col("r") - F.col("m20")) / (F.col("s20") + 1e-12)
    df = df.withColumn("z", z).withColumns({"er": F.when(F.abs("z") > 1, -F.col("z") * F.col("sigma_h") / 10).otherwise(0.0),
        "stress_p": F.when(F.col("z") > 2, 0.8).otherwise(0.1)})
    return df.withColumns({"cost": S.round_trip_cost(F.col("range_rel"), F.col("relative_spread")),
        "side_cost": S.per_side_cost(F.col("range_rel"), F.col("relative_spread"))})


def scalar(key, columns, sql_expr, doubles):
    @query(key, sql_of(f"select {ID}, {sql_expr} from f3", doubles, FC))
    def _(spark, sf_dir):
        return forecasts(spark, sf_dir).select("instrument", "timestamp", *columns())


c = F.col
scalar("SCA-01", lambda: [S.round_trip_cost(c("range_rel"), c("relative_spread")).alias("round_trip"),
    S.per_side_cost(c("range_rel"), c("relative_spread")).alias("per_side")], "cost as round_trip, side_cost as per_side",
    "round_trip per_side")
scalar("SCA-02", lambda: [F.lit(2e-4).alias("commission"), S.spread(c("relative_spread")).alias("spread"),
    (2 * S.slippage_per_side(c("range_rel"))).alias("slippage")],
    "2e-4::double as commission, relative_spread as spread, 0.1 * range_rel as slippage", "commission spread slippage")
scalar("SCA-03", lambda: [S.direction_from_edge(c("er"), c("cost"), 0.1).alias("direction")],
    "case when abs(er) > 0.1 * cost then sign(er)::int else 0 end as direction", "")
scalar("SCA-04", lambda: [S.net_edge(c("er"), c("cost")).alias("net"), S.confidence_from_edge(c("er"), c("cost")).alias("confidence")],
    "abs(er) - 3 * cost as net, case when er is not null then least(1, abs(er) / (6 * cost + 1e-12)) else 1 end as confidence",
    "net confidence")
VM = "case when sigma_ref is not null and sigma_h > 0 then greatest(0.25, least(1.5, sigma_ref / sigma_h)) else 0.25 end"
scalar("SCA-05", lambda: [S.volatility_multiplier(c("sigma_ref"), c("sigma_h")).alias("vm")], f"{VM} as vm", "vm")
scalar("SCA-06", lambda: [S.turnover_suppressed(c("er") * 100, c("z") / 10).alias("q")],
    "case when sign(er * 100) <> sign(z / 10) or abs(er * 100 - z / 10) >= 0.15 then er * 100 else z / 10 end as q", "q")
NET = "(abs(er) - cost - 3e-4)"
EM, XM = "(case when stress_p > 0.7 then 1.5 else 1 end)", "(case when stress_p > 0.7 then 0.4 else 1 end)"
DEAL = f"(er is not null and {NET} > 8e-4 * {EM})"
CONF = f"least(1, {NET} / (6 * greatest(cost, 8e-4) * {EM} + 1e-12))"
def zero():
    return F.lit(0.0)


scalar("SCA-07", lambda: [S.decide(c("er"), c("cost"), zero(), zero(), c("stress_p"))[k].alias(k) for k in ("direction", "confidence",
    "required", "reason")],
       f"case when {DEAL} then sign(er)::int else 0 end as direction, case when {DEAL} then {CONF} else 0 end as confidence, 8e-4 * {EM} as required, case when er is null then 'non-finite forecast' when not {DEAL} then 'edge below requirement' else '' end as reason",
           "confidence required")
scalar("SCA-08", lambda: [S.stress_factors(c("stress_p"))[0].alias("exposure"), S.stress_factors(c("stress_p"))[1].alias("edge")],
    f"{XM}::double as exposure, {EM}::double as edge", "exposure edge")
scalar("SCA-09", lambda: [S.stop_distance(c("sigma_h")).alias("distance"), S.stop_triggered(c("r"), c("sigma_h") / 10).alias("hit")],
    "8 * sigma_h as distance, r < -0.8 * sigma_h as hit", "distance")
TARGET = f"case when {DEAL} then greatest(-{XM}, least({XM}, sign(er) * {CONF} * {VM})) else 0 end"


def _target():
    d = S.decide(c("er"), c("cost"), zero(), zero(), c("stress_p"))
    cap = d["exposure_factor"]
    return F.when(d["direction"] != 0, F.greatest(-cap, F.least(cap,
        d["direction"] * d["confidence"] * S.volatility_multiplier(c("sigma_ref"), c("sigma_h"))))).otherwise(0.0)


scalar("SCA-11", lambda: [_target().alias("target")], f"{TARGET} as target", "target")
scalar("SCA-12", lambda: [W.reference_sigma("sigma_h", 390).alias("reference")], "sigma_ref as reference", "reference")
scalar("SCA-13", lambda: [S.cost_bps(c("range_rel"), c("relative_spread"), zero(), zero())[k].alias(k) for k in ("spread_bps",
    "slippage_bps", "fee_bps", "total_bps")],
    "relative_spread * 1e4 as spread_bps, 0.1 * range_rel * 1e4 as slippage_bps, 2.0::double as fee_bps, relative_spread * 1e4 + 1e3 * range_rel + 2 as total_bps",
    "spread_bps slippage_bps fee_bps total_bps")
scalar("SCA-14", lambda: [S.fill_price(F.lit(1), c("open"), c("high"), c("low"), c("close"), c("relative_spread")).alias("buy"),
    S.fill_price(F.lit(-1), c("open"), c("high"), c("low"), c("close"), c("relative_spread")).alias("sell")],
       "open * (1 + relative_spread / 2 + 0.05 * range_rel) as buy, open * (1 - relative_spread / 2 - 0.05 * range_rel) as sell",
           "buy sell")
scalar("SCA-15", lambda: [S.volatility_bucket(c("sigma_h") / c("sigma_ref")).alias("vol"),
    S.time_bucket(F.pmod(F.unix_seconds("timestamp") / 86400, F.lit(390)), F.lit(390)).alias("tod")],
       "case when sigma_h is null then 'unknown' when sigma_h / sigma_ref < 0.8 then 'low' when sigma_h / sigma_ref > 1.2 then 'high' else 'normal' end as vol, case when (epoch(\"timestamp\") / 86400) % 390 < 60 then 'open' when (epoch(\"timestamp\") / 86400) % 390 >= 330 then 'close' else 'mid' end as tod",
           "")
scalar("SCA-16", lambda: [((F.abs("er") - c("cost")) * 1e4).alias("net_edge_bps"), (c("cost") * 1e4).alias("total_bps")],
    "(abs(er) - cost) * 1e4 as net_edge_bps, cost * 1e4 as total_bps", "net_edge_bps total_bps")
scalar("SCA-18", lambda: [S.round_trip_cost((c("high") - c("low")) / c("close"), c("relative_spread")).alias("cost")],
    "2e-4 + relative_spread + 0.1 * (high - low) / close as cost", "cost")
scalar("SCA-19", lambda: [(c("z") * c("sigma_h") * 2).alias("er")], "z * sigma_h * 2 as er", "er")
scalar("MOD-03", lambda: [S.combine(c("z"), F.when(c("volume") > 200, 0.8).otherwise(0.3)).alias("a")],
    "case when z is null or z = 0 then 0 when volume > 200 and z > 0 then z * 0.6 when volume <= 200 and z < 0 then z * 0.4 else 0 end as a",
    "a")


@query("SCA-10")
def sca_10(spark, sf_dir):
    """The position rules on a fixed target, hold limit 12: what the fold's exposure is in each row."""
    rows = sim_rows(spark, sf_dir)
    return FO.simulate_frame(rows, {"base": FO.SimParams()}).select("key", "timestamp", "exposure")


@query("SCA-17",
    sql_of("select instrument, count(cost)::bigint as n, avg(cost) as mean, median(cost) as median, quantile_cont(cost, 0.9) as p90, quantile_cont(cost, 0.95) as p95, max(cost) as worst, min(cost) as best from f3 group by 1",
    "mean median p90 p95 worst best", FC))
def sca_17(spark, sf_dir):
    p = lambda q: F.percentile("cost", F.lit(q))
    return forecasts(spark, sf_dir).groupBy("instrument").agg(F.count("cost").alias("n"), F.avg("cost").alias("mean"),
        p(0.5).alias("median"), p(0.9).alias("p90"), p(0.95).alias("p95"), F.max("cost").alias("worst"), F.min("cost").alias("best"))


# --- labels
LAB = FC + f""", lab as (select *, ln(lead(open, 5) {ORDER}) - ln(lead(open, 1) {ORDER}) as y, lead(open, 1) {ORDER} as open_next, lead(open, 2) {ORDER} as open_next2, lead(close, 1) {ORDER} as close_next, lead(side_cost, 1) {ORDER} as cost_side_exec from f3)"""


def labelled(spark, sf_dir, **kw):
    return L.labels(forecasts(spark, sf_dir), **kw)


@query("LAB-01",
    sql_of(f"select {ID}, y, y / (sigma_h * 2 + 1e-12) as y_norm, open_next, open_next2, close_next, cost as cost_roundtrip, cost_side_exec, ln(close_next) - ln(open_next) as r_fill from lab",
    "y y_norm open_next open_next2 close_next cost_roundtrip cost_side_exec r_fill", LAB))
def lab_01(spark, sf_dir):
    return labelled(spark, sf_dir).select("instrument", "timestamp", "y", "y_norm", "open_next", "open_next2", "close_next",
        "cost_roundtrip", "cost_side_exec", "r_fill")


@query("LAB-02",
    sql_of("select k::int as fold, floor(2000 * (0.4 + (k - 1) * 0.1))::bigint - 5 as train_end, floor(2000 * (0.4 + (k - 1) * 0.1))::bigint + 5 as val_start, floor(2000 * (0.4 + k * 0.1))::bigint as val_end from generate_series(1, 5) t(k)",
    "", "one as (select 1)"))
def lab_02(spark, sf_dir):
    return spark.createDataFrame(L.folds(2000), "fold int, train_end long, val_start long, val_end long")


@query("LAB-03",
    sql_of(f"""select fold, part, count(*)::bigint as n from (select f.k::int as fold, case when i < 1000 * (0.4 + (f.k - 1) * 0.1) - 5 then 'train' else 'validation' end as part
 from (select row_number() {ORDER} - 1 as i from bars) b join generate_series(1, 5) f(k) on i < round(1000 * (0.4 + (f.k - 1) * 0.1)) - 5 or (i >= round(1000 * (0.4 + (f.k - 1) * 0.1)) + 5 and i < round(1000 * (0.4 + f.k * 0.1)))) group by 1, 2"""))
def lab_03(spark, sf_dir):
    layout = [(k + 1, 400 + 100 * k - 5, 400 + 100 * k + 5, 500 + 100 * k) for k in range(5)]
    return L.assign_folds(B.bars_daily(spark, sf_dir), layout).groupBy("fold", "part").agg(F.count("*").alias("n"))


EDGE = "floor(n * (0.4::double + {} * 0.1::double))"


@query("LAB-03-instruments",
    sql_of(f"""select instrument, fold, part, count(*)::bigint as n from (select instrument, f.k::int as fold, case when i < {EDGE.format('(f.k - 1)')} - 5 then 'train' else 'validation' end as part
 from (select instrument, row_number() {ORDER} - 1 as i, count(*) over (partition by instrument) as n from bars) b join generate_series(1, 5) f(k) on i < {EDGE.format('(f.k - 1)')} - 5 or (i >= {EDGE.format('(f.k - 1)')} + 5 and i < least(n, {EDGE.format('f.k')}))) group by 1, 2, 3"""))
def lab_03_instruments(spark, sf_dir):
    """Folds over all rows of each instrument."""
    return L.assign_own_folds(B.bars_daily(spark, sf_dir)).groupBy("instrument", "fold", "part").agg(F.count("*").alias("n"))


@query("LAB-04",
    sql_of("select k::int as \"window\", 250 * k as train_start, 3000 + 250 * k as train_end, least(3250 + 250 * k, 8500) as oos_end from generate_series(0, 21) t(k)",
    "", "one as (select 1)"))
def lab_04(spark, sf_dir):
    return L.schedule_frame(spark, n_bars=10_000, train=3_000, oos=250, holdout_fraction=0.15)


@query("LAB-05", sql_of("select 22::bigint as windows, 3250::bigint as bars_needed", "", "one as (select 1)"))
def lab_05(spark, sf_dir):
    return L.schedule_frame(spark, n_bars=10_000, train=3_000, oos=250,
        holdout_fraction=0.15).agg(F.count("*").alias("windows")).withColumn("bars_needed", F.lit(3250).cast("long"))


@query("LAB-06",
    sql_of("select 1::int as fold, (795 * 0.75)::int::bigint - 5 as fit_end, (795 * 0.75)::int::bigint + 5 as cal_start, 795::bigint as cal_end",
    "", "one as (select 1)"))
def lab_06(spark, sf_dir):
    n = L.folds(2000)[0][1]
    return spark.createDataFrame([(1, round(n * 0.75) - 5, round(n * 0.75) + 5, n)], "fold int, fit_end long, cal_start long, cal_end long")


@query("LAB-08",
    sql_of("select k::int as \"window\", 1500 - 1000 + 250 * k as train_start, 1500 + 250 * k as train_end, least(1750 + 250 * k, 2000) as oos_end from generate_series(0, 1) t(k)",
    "", "one as (select 1)"))
def lab_08(spark, sf_dir):
    rows = [(k - 0, s - 1000, s, min(s + 250, 2000)) for k, s in enumerate(range(1500, 2000, 250))]
    return spark.createDataFrame(rows, "window int, train_start long, train_end long, oos_end long")


@query("LAB-09", sql_of(f"select {ID}, er, sigma_h as sigma, cost from lab where y is not null and sigma_h is not null", "er sigma cost",
    LAB))
def lab_09(spark, sf_dir):
    return L.valid_rows(labelled(spark, sf_dir), ["y", "sigma_h"]).select("instrument", "timestamp", "er", c("sigma_h").alias("sigma"),
        "cost")


# --- folds
def engine_bars(spark, sf_dir):
    """Bars with what the per-bar engine knows at their close."""
    return forecasts(spark, sf_dir).withColumns({"sigma": c("sigma_h"), "day": F.floor(F.unix_seconds("timestamp") / 86400).cast("double")})


def sim_rows(spark, sf_dir):
    df = labelled(spark, sf_dir)
    row = F.row_number().over(B.by_time()) - 1
    return L.valid_rows(df, ["sigma_h", "open_next2", "cost_side_exec"]).select(
        "instrument", "timestamp", "er", c("sigma_h").alias("sigma"), "sigma_ref", "cost", c("cost_side_exec").alias("cost_side"),
            "log_close", "open_next", "open_next2",
        F.lit(0.0).alias("adverse"), F.lit(0.0).alias("uncertainty"), "stress_p",
            F.unix_seconds("timestamp").cast("double").alias("session"), F.floor(row / 250).cast("double").alias("window"))


EMA = f"""o as (select instrument, row_number() {ORDER} as n, "timestamp", close from bars), e(instrument, n, ts, x) as (select instrument, n, "timestamp", close from o where n = 1
 union all select o.instrument, o.n, o."timestamp", e.x + (o.close - e.x) / 3.0 from e join o on o.instrument = e.instrument and o.n = e.n + 1)"""


@query("WIN-10", sql_of("select instrument, ts as \"timestamp\", x as value from e", "value", BARS_DAILY + ", " + EMA))
def win_10(spark, sf_dir):
    return FO.fold_column(B.bars_daily(spark, sf_dir), "close", lambda x: FO.ema_kernel(x, 5))


SIM = LAB + f""", s0 as (select *, {TARGET} as want, row_number() {ORDER} - 1 as row0 from lab), s1 as (select *, row_number() {ORDER} as n from s0 where sigma_h is not null and open_next2 is not null and cost_side_exec is not null and sigma_h is not null),
sim(instrument, n, q, hold, ep, es, q_prev) as (select instrument, 0::bigint, 0.0::double, 0::bigint, 0.0::double, 0.0::double, 0.0::double from s1 where n = 1
 union all select s.instrument, s.n,
  {{Q}}, case when {{Q}} = 0 then 0 when {{ENTRY}} then 0 else m.hold + 1 end, case when {{ENTRY}} then s.open_next else m.ep end, case when {{ENTRY}} then s.sigma_h else m.es end, m.q
  from sim m join s1 s on s.instrument = m.instrument and s.n = m.n + 1)"""
STOP = "(m.q <> 0 and sign(m.q) * (s.log_close - ln(m.ep)) < -8 * m.es)"
FULLHOLD = "(m.q <> 0 and m.hold + 1 >= 12)"
Q = f"(case when {STOP} then 0 when {FULLHOLD} then s.want when sign(s.want) <> sign(m.q) or abs(s.want - m.q) >= 0.15 then s.want else m.q end)"
ENTRY = f"({Q} <> 0 and (m.q = 0 or sign({Q}) <> sign(m.q) or (not {STOP} and {FULLHOLD})))"
SIM = SIM.replace("{Q}", Q).replace("{ENTRY}", ENTRY)
PNL = "select s.instrument, s.\"timestamp\", m.q as exposure, m.q * (s.open_next2 / s.open_next - 1) - abs(m.q - m.q_prev) * s.cost_side_exec as pnl, abs(m.q - m.q_prev) * s.cost_side_exec as cost_bar from sim m join s1 s on s.instrument = m.instrument and s.n = m.n"


@query("FLD-01", sql_of(f"select instrument || '/base' as key, \"timestamp\", exposure, pnl, cost_bar from ({PNL})",
    "exposure pnl cost_bar", SIM))
def fld_01(spark, sf_dir):
    return FO.simulate_frame(sim_rows(spark, sf_dir), {"base": FO.SimParams()}).select("key", "timestamp", "exposure", "pnl", "cost_bar")


@query("FLD-02")
def fld_02(spark, sf_dir):
    params = {"base": FO.SimParams(), "double": FO.scenario(cost_scale=2.0), "delay1": FO.scenario(delay=1),
        "halts": FO.scenario(daily_loss=0.025, drawdown_halt=0.10), "legacy": FO.scenario(rule="legacy")}
    return FO.simulate_frame(sim_rows(spark, sf_dir), params)


EXPO = f"qq as (select *, case when n % 40 < 20 then 1.0 when n % 40 < 30 then -0.5 else 0.0 end as q from s1), q2 as (select *, coalesce(lag(q) {ORDER}, 0) as q0 from qq)"


#: the made-up prices jump, so moves are clipped here
PRESCRIBED = "q * greatest(-0.05, least(0.05, open_next2 / open_next - 1)) - abs(q - q0) * least(cost_side_exec, 0.001)"


def prescribed(spark, sf_dir):
    n = F.row_number().over(B.by_time())
    df = sim_rows(spark, sf_dir).withColumn("n", n)
    q = F.when(c("n") % 40 < 20, 1.0).when(c("n") % 40 < 30, -0.5).otherwise(0.0)
    df = df.withColumn("q", q).withColumn("q0", F.coalesce(F.lag("q").over(B.by_time()), F.lit(0.0)))
    move = F.greatest(F.lit(-0.05), F.least(F.lit(0.05), c("open_next2") / c("open_next") - 1))
    return df.withColumn("pnl", c("q") * move - F.abs(c("q") - c("q0")) * F.least(c("cost_side"), F.lit(0.001)))


@query("FLD-03", sql_of(f"select {ID}, q, {PRESCRIBED} as pnl from q2", "q pnl", SIM.split(", sim(")[0] + ", " + EXPO))
def fld_03(spark, sf_dir):
    return prescribed(spark, sf_dir).select("instrument", "timestamp", "q", "pnl")


@query("FLD-04")
def fld_04(spark, sf_dir):
    return FO.fold_column(ret(spark, sf_dir), ["log_close", "sigma_h"], FO.momentum_exposure, "exposure")


@query("FLD-05",
    sql_of(f"select {ID}, case when sigma_h > 0 then least(1, greatest(0, 0.1 / (sigma_h * sqrt(252)))) else 0 end as exposure from r1",
    "exposure", RET))
def fld_05(spark, sf_dir):
    return ret(spark, sf_dir).select("instrument", "timestamp", S.vol_scaled_exposure(c("sigma_h"), 252.0).alias("exposure"))


LED = f"""o as (select *, row_number() {ORDER} as n from bars), f as (select *, case when n % 25 = 1 then 10 * ((n // 25) % 5 - 2) else 0 end::double as units_dealt from o),
l as (select *, sum(units_dealt) {ORDER} as units, 100000 - sum(units_dealt * close) {ORDER} - count(case when units_dealt <> 0 then 1 end) {ORDER} as cash from f)"""


def fills(spark, sf_dir):
    n = F.row_number().over(B.by_time())
    df = B.bars_daily(spark, sf_dir).withColumn("n", n)
    return df.withColumn("fill", F.when(c("n") % 25 == 1, 10 * (F.floor(c("n") / 25) % 5 - 2)).otherwise(0).cast("double"))


def ledger_frame(spark, sf_dir):
    import pandas as pd

    def run(pdf):
        pdf = pdf.sort_values("timestamp")
        out = FO.ledger(pdf["fill"].to_numpy(float), pdf["close"].to_numpy(float), commission=1.0)
        return pd.DataFrame({"instrument": pdf["instrument"].to_numpy(), "timestamp": pdf["timestamp"].to_numpy(),
            **out})[[f.split()[0] for f in FO.LEDGER.split(", ")]]

    return fills(spark, sf_dir).select("instrument", "timestamp", "close", "fill").groupBy("instrument").applyInPandas(run, FO.LEDGER)


@query("FLD-06", sql_of(f"select {ID}, units, cash, cash + units * close as equity from l", "units cash equity", BARS_DAILY + ", " + LED))
def fld_06(spark, sf_dir):
    return ledger_frame(spark, sf_dir).select("instrument", "timestamp", "units", "cash", "equity")


@query("FLD-16",
    sql_of(f"select {ID}, units * close / (cash + units * close) as exposure, 1 - (cash + units * close) / max(greatest(cash + units * close, 100000)) over (partition by instrument order by \"timestamp\" rows unbounded preceding) as drawdown from l",
    "exposure drawdown", BARS_DAILY + ", " + LED))
def fld_16(spark, sf_dir):
    return ledger_frame(spark, sf_dir).select("instrument", "timestamp", "exposure", "drawdown")


@query("FLD-17")
def fld_17(spark, sf_dir):
    return FO.simulate_frame(sim_rows(spark, sf_dir), {"base": FO.SimParams()}, want_deals=True)


@query("FLD-08", digits=4)  # a capital that many fills went through
def fld_08(spark, sf_dir):
    """Bars on which a halt is on, with what was wanted, what the halt leaves of it and what is ordered."""
    from barloom.operators import engine

    rows = engine.run_engine(engine_bars(spark, sf_dir)).where("status = 'HALTED'")
    return rows.select("instrument", "timestamp", "target", "approved", "reason", "ordered", "equity")


@query("FLD-10",
    sql_of(f"select {ID}, case when abs(100000 * 0.5 / close - units) * close >= 100 then 100000 * 0.5 / close - units else 0 end as delta from l",
    "delta", BARS_DAILY + ", " + LED))
def fld_10(spark, sf_dir):
    led = ledger_frame(spark, sf_dir).select("instrument", "timestamp",
        "units").join(B.bars_daily(spark, sf_dir).select("instrument", "timestamp", "close"), ["instrument", "timestamp"])
    delta = 100_000 * 0.5 / c("close") - c("units")
    return led.select("instrument", "timestamp", F.when(F.abs(delta) * c("close") >= 100, delta).otherwise(0.0).alias("delta"))


@query("FLD-11",
    sql_of(f"select {ID}, lead(open) {ORDER} * (1 + lead(relative_spread) {ORDER} / 2 + 0.05 * lead(range_rel) {ORDER}) as fill from f3",
    "fill", FC))
def fld_11(spark, sf_dir):
    nxt = lambda x: F.lead(x).over(B.by_time())
    df = forecasts(spark, sf_dir)
    return df.select("instrument", "timestamp", S.fill_price(F.lit(1), nxt("open"), nxt("high"), nxt("low"), nxt("close"),
        nxt("relative_spread")).alias("fill"))


@query("FLD-18",
    sql_of(f"select {ID}, case when d < -0.1 and r < -0.025 then 'daily_loss,drawdown' when r < -0.025 then 'daily_loss' when d < -0.1 then 'drawdown' else '' end as halt_reason from (select *, close / max(close) over (partition by instrument order by \"timestamp\" rows unbounded preceding) - 1 as d from r1)",
    "", RET))
def fld_18(spark, sf_dir):
    df = ret(spark, sf_dir).withColumn("d", W.drawdown("close"))
    return df.select("instrument", "timestamp", F.concat_ws(",", F.when(c("r") < -0.025, "daily_loss"),
        F.when(c("d") < -0.1, "drawdown")).alias("halt_reason"))


@query("FLD-12",
    sql_of("select vol, count(*)::bigint as n, avg(cost) * 1e4 as expected_bps, avg(range_rel) * 1e4 as realised_bps, quantile_cont(cost, 0.95) * 1e4 as p95_bps from (select *, case when sigma_h is null then 'unknown' when sigma_h / sigma_ref < 0.8 then 'low' when sigma_h / sigma_ref > 1.2 then 'high' else 'normal' end as vol from f3) group by 1",
    "expected_bps realised_bps p95_bps", FC))
def fld_12(spark, sf_dir):
    df = forecasts(spark, sf_dir).withColumn("vol", S.volatility_bucket(c("sigma_h") / c("sigma_ref")))
    return df.groupBy("vol").agg(F.count("*").alias("n"), (F.avg("cost") * 1e4).alias("expected_bps"),
        (F.avg("range_rel") * 1e4).alias("realised_bps"), (F.percentile("cost", F.lit(0.95)) * 1e4).alias("p95_bps"))


# --- event bars
SEQ = DEALS + """, t as (select *, row_number() over (partition by instrument order by "timestamp", sequence_id) as n, ("timestamp")::date as d from deals)"""
RSM = SEQ + """, b(instrument, n, d, acc, bar, vol) as (select instrument, 0::bigint, null::date, 0.0::double, 0::bigint, 0.0::double from t where n = 1
 union all select t.instrument, t.n, t.d, case when b.acc >= TARGET or (b.d is not null and b.d <> t.d) then 0 else b.acc end + t.size, b.bar + case when b.n > 0 and (b.acc >= TARGET or b.d <> t.d) then 1 else 0 end, t.size
 from b join t on t.instrument = b.instrument and t.n = b.n + 1)"""


@query("RSM-01",
    sql_of("select b.instrument, b.bar, arg_min(t.price, t.n) as open, max(t.price) as high, min(t.price) as low, arg_max(t.price, t.n) as close, sum(t.size) as volume, count(*) as deal_count from b join t on t.instrument = b.instrument and t.n = b.n group by 1, 2",
    "open high low close volume", RSM.replace("TARGET", "1000")))
def rsm_01(spark, sf_dir):
    out = FO.event_bars(B.deals(spark, sf_dir), "volume", 1000.0)
    return out.select("instrument", F.regexp_extract("bar_id", r"-(\d+)", 1).cast("long").alias("bar"), "open", "high", "low", "close",
        "volume", "deal_count")


@query("RSM-02")
def rsm_02(spark, sf_dir):
    return FO.event_bars(B.deals(spark, sf_dir), "dollar", 50_000.0)


TICKS = "select instrument, min(\"timestamp\") as start, count(*) as deal_count, sum(size) as volume from (select *, (row_number() over (partition by instrument, d order by n) - 1) // 20 as k from t) group by instrument, d, k"


@query("RSM-03", sql_of(TICKS, "volume", SEQ))
def rsm_03(spark, sf_dir):
    return FO.event_bars(B.deals(spark, sf_dir), "tick", 20).select("instrument", "start", "deal_count", "volume")


@query("RSM-04",
    sql_of("select instrument, list_sort(list(n))[len(list(n)) // 2 + 1] as bars_per_session from (select instrument, \"timestamp\"::date as d, count(*) as n from bars group by 1, 2) group by 1",
    "", BARS_15M))
def rsm_04(spark, sf_dir):
    n = B.bars_15m(spark, sf_dir).groupBy("instrument", F.to_date("timestamp").alias("d")).agg(F.count("*").alias("n"))
    values = F.sort_array(F.collect_list("n"))
    return n.groupBy("instrument").agg(F.get(values, F.floor(F.count("*") / 2).cast("int")).alias("bars_per_session"))


@query("RSM-05",
    sql_of("select * from (values ('dollar_250m', 'dollar', 250e6::double), ('volume_500k', 'volume', 500e3::double), ('tick_20', 'tick', 20::double), ('time_30', 'time', 30::double)) t(name, kind, target)",
    "target", "one as (select 1)"))
def rsm_05(spark, sf_dir):
    return spark.createDataFrame([(n, *FO.parse_target(n)) for n in ("dollar_250m", "volume_500k", "tick_20", "time_30")],
        "name string, kind string, target double")


@query("RSM-06",
    sql_of("select instrument, time_bucket(interval 30 minutes, \"timestamp\") as \"timestamp\", sum(size) as volume, count(*) as deal_count from deals group by 1, 2",
    "volume", DEALS))
def rsm_06(spark, sf_dir):
    return B.time_bars(B.deals(spark, sf_dir), "30 minutes").select("instrument", "timestamp", "volume", "deal_count")


@query("RSM-07",
    sql_of("select 'tick_20' as candidate, instrument, count(*)::bigint as bars from (" + TICKS + ") group by 2 union all select 'tick_50', instrument, count(*)::bigint from (" + TICKS.replace("// 20",
    "// 50") + ") group by 2", "", SEQ))
def rsm_07(spark, sf_dir):
    out = None
    for name in ("tick_20", "tick_50"):
        one = FO.event_bars(B.deals(spark, sf_dir),
            *FO.parse_target(name)).groupBy("instrument").agg(F.count("*").alias("bars")).select(F.lit(name).alias("candidate"),
            "instrument", "bars")
        out = one if out is None else out.unionByName(one)
    return out


# --- filters and hidden states
@query("FEA-20")
def fea_20(spark, sf_dir):
    return FO.fold_column(ret(spark, sf_dir), "log_close", lambda y: FO.kalman(y, 1e-4, 1e-6, 1e-4)[0][:, 0], "level")


@query("FEA-21")
def fea_21(spark, sf_dir):
    return FO.fit_kalman(ret(spark, sf_dir))


@query("FEA-22")
def fea_22(spark, sf_dir):
    """All features of the filter with fixed noises."""
    import pandas as pd

    def run(pdf):
        pdf = pdf.sort_values("timestamp")
        made = FO.kalman_features(pdf["log_close"].to_numpy(float), pdf["sigma_h"].to_numpy(float), 1e-4, 1e-6, 1e-4)
        return pd.DataFrame({"instrument": pdf["instrument"].to_numpy(), "timestamp": pdf["timestamp"].to_numpy(), **made})

    schema = "instrument string, timestamp timestamp, " + ", ".join(f"kalman_{n} double" for n in FO.KALMAN_FEATURES)
    return ret(spark, sf_dir).select("instrument", "timestamp", "log_close", "sigma_h").groupBy("instrument").applyInPandas(run, schema)


@query("FEA-23")
def fea_23(spark, sf_dir):
    return FO.fold_column(ret(spark, sf_dir), "log_close", lambda y: FO.rts_smooth(y, 1e-4, 1e-6, 1e-4), "smoothed")


OBS = ["obs_return", "obs_abs_return", "obs_log_vol", "obs_log_volume", "obs_spread", "obs_trend"]
#: the share of an instrument's rows that fits its components; what comes after is only filtered
TRAINING = 0.6


def hmm_frame(spark, sf_dir, what):
    """Fitted on the training block of each instrument, then run over all of its rows."""
    import numpy as np
    import pandas as pd

    obs = OBS

    def run(pdf):
        pdf = pdf.sort_values("timestamp")
        x = pdf[obs].to_numpy(float)
        m = FO.GaussianHMM().fit(x[: int(len(x) * TRAINING)])
        p = m.smooth(x) if what == "smooth" else m.filter(x)
        out = pd.DataFrame({"instrument": pdf["instrument"].to_numpy(), "timestamp": pdf["timestamp"].to_numpy()})
        for k in range(3):
            out[f"p{k}"] = p[:, k]
            out[f"leave{k}"] = float(1 - m.trans[k, k])
        return out.replace([np.inf, -np.inf], np.nan)

    schema = "instrument string, timestamp timestamp, " + ", ".join(f"p{k} double, leave{k} double" for k in range(3))
    return X.hmm_observations(ret(spark, sf_dir)).select("instrument", "timestamp", *obs).groupBy("instrument").applyInPandas(run, schema)


@query("FEA-15")
def fea_15(spark, sf_dir):
    return hmm_frame(spark, sf_dir, "filter").groupBy("instrument").agg(*[F.avg(f"p{k}").alias(f"occupancy_{k}") for k in range(3)])


@query("FEA-16")
def fea_16(spark, sf_dir):
    return hmm_frame(spark, sf_dir, "filter").select("instrument", "timestamp", "p0", "p1", "p2")


@query("FEA-17")
def fea_17(spark, sf_dir):
    return hmm_frame(spark, sf_dir, "smooth").select("instrument", "timestamp", "p0", "p1", "p2")


@query("FEA-18")
def fea_18(spark, sf_dir):
    p = hmm_frame(spark, sf_dir, "filter")
    state = F.array_position(F.array("p0", "p1", "p2"), F.greatest("p0", "p1", "p2")) - 1
    return p.groupBy("instrument", state.alias("state")).agg(F.count("*").alias("n"),
        F.avg(F.get(F.array("leave0", "leave1", "leave2"), state.cast("int"))).alias("leave"))


@query("FEA-19",
    sql_of(f"""select {ID}, -(a * ln(a) + b * ln(b)) / ln(2) as regime_entropy, (b > a)::int as regime_most_likely, row_number() over (partition by instrument, island order by "timestamp") - 1 as regime_age from
 (select *, sum(change) {ORDER} as island from (select *, case when lag(b > a) {ORDER} is null or lag(b > a) {ORDER} <> (b > a) then 1 else 0 end as change from (select *, 0.2 + 0.6 * (r > 0)::int as b, 0.8 - 0.6 * (r > 0)::int as a from r1 where r is not null)))""",
     "regime_entropy", RET))
def fea_19(spark, sf_dir):
    up = (c("r") > 0).cast("int")
    df = ret(spark, sf_dir).where("r is not null").withColumns({"p0": 0.8 - 0.6 * up, "p1": 0.2 + 0.6 * up})
    out = X.regime_state(df, ["p0", "p1"], [0.05, 0.1])
    return out.select("instrument", "timestamp", "regime_entropy", "regime_most_likely", c("regime_age").cast("long").alias("regime_age"))


@query("FEA-25", "select 39::bigint as inputs, 4::bigint as families")
def fea_25(spark, sf_dir):
    from barloom.plans.schema import build_schema

    s = build_schema()
    return spark.createDataFrame([(len(s.names), len(s.families))], "inputs long, families long")


@query("FEA-27",
    "select 'xa_breadth' as name union all select 'xa_dispersion' union all select 'xa_a_' || c from (values ('rel_return_1'), ('rel_return_4'), ('divergence'), ('rel_volume'), ('vol_divergence'), ('corr_short'), ('corr_breakdown'), ('age_s')) t(c)")
def fea_27(spark, sf_dir):
    from barloom.plans.schema import cross_asset_names

    return spark.createDataFrame([(n,) for n in cross_asset_names(["a"])], "name string")


@query("FEA-09",
    sql_of("select instrument, avg(case when bid_size + ask_size > 0 then 1.0 else 0.0 end) >= 0.9 as ofi, count(volume) > 0 as volume from bars group by 1"))
def fea_09(spark, sf_dir):
    return B.bars_daily(spark, sf_dir).groupBy("instrument").agg((F.avg(F.when(c("bid_size") + c("ask_size") > 0,
        1.0).otherwise(0.0)) >= 0.9).alias("ofi"), (F.count("volume") > 0).alias("volume"))


