"""Queries: rolling windows, fractional operators, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import windows as W
from barloom.operators import features as X
from barloom.operators import fractional as FR
from barloom.operators.asof import asof_join
from barloom.operators.chunks import in_chunks
from barloom.plans.base import BARS_15M, BARS_DAILY, ORDER, full, over, query, sql_of, z_sql
from barloom.sources.bars import bars_15m, bars_daily

RET = BARS_DAILY + f""", r0 as (select *, ln(close) as log_close, ln(close) - lag(ln(close)) {ORDER} as r from bars),
r1 as (select *, {full("r", 50, f"stddev_pop(r) {over(50)}")} as sigma_h, (high - low) / close as range_rel from r0)"""
RET15 = RET.replace(BARS_DAILY, BARS_15M)
ID = 'instrument, "timestamp"'
S = {n: full("r", n, f"stddev_pop(r) {over(n)}") for n in (10, 20, 50, 200)}


def ret(spark, sf_dir):
    return X.with_returns(bars_daily(spark, sf_dir))


def ret15(spark, sf_dir):
    return X.with_returns(bars_15m(spark, sf_dir))


def simple(key, column, sql_expr, doubles="x", views=RET):
    """A query of one expression over the bars with returns."""
    @query(key, sql_of(f"select {ID}, {sql_expr} as x from r1", doubles, views))
    def _(spark, sf_dir):
        return ret(spark, sf_dir).select("instrument", "timestamp", column().alias("x"))


simple("WIN-01", lambda: W.lag("close", 4), f"lag(close, 4) {ORDER}")
simple("WIN-02", lambda: W.rolling_mean("close", 20), full("close", 20, f"avg(close) {over(20)}"))
simple("WIN-03", lambda: W.rolling_std("r", 50), S[50])
simple("WIN-04", lambda: W.rolling_median("close", 50), full("close", 50, f"median(close) {over(50)}"))
simple("WIN-05", lambda: W.rolling_mad("close", 50), full("close", 50, f"mad(close) {over(50)}"))
simple("WIN-06", lambda: W.robust_z("close", 50), z_sql("close", 50))
CORR50 = full("log_close", 50,
    f"coalesce(covar_pop(log_close, rn) {over(50)} / nullif(stddev_pop(log_close) {over(50)} * stddev_pop(rn) {over(50)}, 0), 0)")
RN = RET + f", r2 as (select *, row_number() {ORDER} as rn from r1)"


@query("WIN-07", sql_of(f"select {ID}, {CORR50} as x from r2", "x", RN))
def win_07(spark, sf_dir):
    return ret(spark, sf_dir).select("instrument", "timestamp", W.corr_with_index("log_close", 50).alias("x"))


def dot(x: str, taps: list[float]) -> str:
    n = len(taps)
    return full(x, n, f"list_dot_product(list(coalesce({x}, 0)) {over(n)}, [{', '.join(map(repr, reversed(taps)))}]::double[])")


simple("WIN-08", lambda: W.ewma_variance("r", 0.94, 450) * 1e4, f"({dot('(r * r)', W.ewma_weights(0.94, 450))}) * 1e4")
simple("WIN-09", lambda: W.safe_corr("r", "range_rel", 50),
    f"case when count(case when r is not null and range_rel is not null then 1 end) {over(50)} = 50 then covar_pop(r, range_rel) {over(50)} / nullif(stddev_pop(r) {over(50)} * stddev_pop(range_rel) {over(50)}, 0) end")
simple("WIN-11", lambda: W.reference_sigma("sigma_h", 390), f"median(sigma_h) {over(390)}")
simple("WIN-12", lambda: W.rolling_sharpe("r", 65, 252.0), full("r", 65,
    f"coalesce(avg(r) {over(65)} / nullif(stddev_pop(r) {over(65)}, 0), 0) * sqrt(252)"))
RUNNING = 'over (partition by instrument order by "timestamp" rows unbounded preceding)'
simple("WIN-13", lambda: W.drawdown("close"), f"close / max(close) {RUNNING} - 1")


@query("WIN-14",
    sql_of(f"select instrument, -min(d) as x from (select instrument, close / max(close) {RUNNING} - 1 as d from bars) group by 1", "x"))
def win_14(spark, sf_dir):
    d = bars_daily(spark, sf_dir).select("instrument", W.drawdown("close").alias("d"))
    return d.groupBy("instrument").agg((-F.min("d")).alias("x"))


WIN15 = f"""select {ID}, case when rn <= 200 then 'warmup' when s20 > s200 then 'high_vol' else 'low_vol' end as vol_tag,
 case when rn <= 200 then 'warmup' when log_close > m200 then 'up' else 'down' end as trend_tag from (select *, stddev_pop(coalesce(r, 0)) {over(20)} as s20, stddev_pop(coalesce(r, 0)) {over(200)} as s200,
 avg(log_close) {over(200)} as m200 from r2)"""


def tag_regimes(df, short: int = 20, long: int = 200):
    """Ex-ante volatility and trend tags; the first return counts as 0."""
    r = F.coalesce("r", F.lit(0.0))
    warm = F.row_number().over(W.by_time()) <= long
    vol = F.stddev_pop(r).over(W.trailing(short)) > F.stddev_pop(r).over(W.trailing(long))
    up = F.col("log_close") > F.avg("log_close").over(W.trailing(long))
    return df.withColumns({"vol_tag": F.when(warm, "warmup").when(vol, "high_vol").otherwise("low_vol"),
        "trend_tag": F.when(warm, "warmup").when(up, "up").otherwise("down")})


@query("WIN-15", sql_of(WIN15, "", RN))
def win_15(spark, sf_dir):
    return tag_regimes(ret(spark, sf_dir)).select("instrument", "timestamp", "vol_tag", "trend_tag")


# --- fractional
GL = """k(d, n, w, small) as (select d, 0, 1.0::double, 0 from (values (0.0::double), (0.25), (0.35), (0.4), (0.5), (0.75), (1.0)) t(d)
 union all select d, n + 1, -w * (d - n) / (n + 1), case when abs(-w * (d - n) / (n + 1)) < 1e-5 then small + 1 else 0 end from k where n < 500 and small < 10)"""


@query("FRC-01", sql_of("select d, n::int as k, w from k", "w", GL, 9), 9)
def frc_01(spark, sf_dir):
    rows = [(d, k, w) for d in (0.0, 0.25, 0.35, 0.4, 0.5, 0.75, 1.0) for k, w in enumerate(FR.weights(d))]
    return spark.createDataFrame(rows, "d double, k int, w double")


@query("FRC-02", sql_of("select d, n::int as k, w from k where d in (0.25, 0.5, 0.75) and n <= 50", "w", GL, 9), 9)
def frc_02(spark, sf_dir):
    return spark.createDataFrame([(d, k, FR.weight_closed_form(d, k)) for d in (0.25, 0.5, 0.75) for k in range(51)],
        "d double, k int, w double")


for _key, _d in (("FRC-03", 0.5), ("FRC-05", 0.75)):
    @query(_key, sql_of(f"select {ID}, {dot('log_close', list(FR.weights(_d)))} as x from r1", "x", RET))
    def _(spark, sf_dir, _d=_d):
        return FR.transformed(bars_daily(spark, sf_dir).withColumn("log_close", F.log("close")), "log_close",
            {"x": _d}).select("instrument", "timestamp", "x")


@query("FRC-04",
    sql_of(f"select {ID}, x as value from (select *, {dot('log_close', list(FR.weights(0.5)))} as x, row_number() over (partition by instrument order by \"timestamp\" desc) as back from r1) where back = 1",
    "value", RET))
def frc_04(spark, sf_dir):
    return FR.latest(ret(spark, sf_dir), "log_close", 0.5)


@query("FRC-08")
def frc_08(spark, sf_dir):
    return FR.evaluate_orders(ret(spark, sf_dir))


@query("FRC-06")
def frc_06(spark, sf_dir):
    return FR.evaluate_orders(ret(spark, sf_dir), (0.0,)).select("instrument", "adf", "p_adf")


@query("FRC-07")
def frc_07(spark, sf_dir):
    return FR.evaluate_orders(ret(spark, sf_dir), (0.0,)).select("instrument", "kpss", "p_kpss")


@query("FRC-09")
def frc_09(spark, sf_dir):
    return FR.choose_order(FR.evaluate_orders(ret(spark, sf_dir)))


# --- features
_names = [f"return_{k}" for k in X.LAGS]


@query("FEA-02",
    sql_of(f"select {ID}, " + ", ".join(f"(log_close - lag(log_close, {k}) {ORDER}) / (sigma_h * sqrt({k}) + 1e-12) as return_{k}" for k in X.LAGS) + " from r1",
    " ".join(_names), RET))
def fea_02(spark, sf_dir):
    return X.return_features(ret(spark, sf_dir)).select("instrument", "timestamp", *_names)


FV = dot("lv", list(FR.weights(0.4)))
V3 = RET + f", ew as (select *, {dot('(r * r)', W.ewma_weights(0.94, 450))} as ewma_variance from r1), ew2 as (select *, ln(ewma_variance + 1e-12) as lv from ew)"


@query("FEA-03",
    sql_of(f"select {ID}, ln({S[10]} + 1e-12) as vol_10, ln({S[50]} + 1e-12) as vol_50, ln({S[200]} + 1e-12) as vol_200, {S[10]} / ({S[50]} + 1e-12) as vol_ratio_short, {S[50]} / ({S[200]} + 1e-12) as vol_ratio_long, {z_sql('range_rel', 250)} as range_z, (2 * close - high - low) / (high - low + 1e-12) as close_location, {FV} as fractional_volatility from ew2",
    "vol_10 vol_50 vol_200 vol_ratio_short vol_ratio_long range_z close_location fractional_volatility", V3, 5), 5)
def fea_03(spark, sf_dir):
    out = in_chunks(bars_daily(spark, sf_dir), lambda df: X.fractional_volatility(X.volatility_features(X.with_returns(df), range_z=False)),
        X.required_history() + 1)
    return out.select("instrument", "timestamp", "vol_10", "vol_50", "vol_200", "vol_ratio_short", "vol_ratio_long", "range_z",
        "close_location", "fractional_volatility")


@query("FEA-04",
    sql_of(f"select {ID}, {z_sql('v', 50)} as volume_z, v - lag(v) {ORDER} as volume_change from (select *, ln(1 + volume) as v from bars)",
    "volume_z volume_change"))
def fea_04(spark, sf_dir):
    return X.volume_features(bars_daily(spark, sf_dir)).select("instrument", "timestamp", "volume_z", "volume_change")


FD = RET + ", fd as (select *, " + ", ".join(f"{dot('log_close', list(FR.weights(d)))} as fd_{n}" for n,
    d in (("adaptive", 0.35), ("025", 0.25), ("050", 0.5), ("075",
    0.75))) + " from r1), fz as (select *, " + ", ".join(f"{z_sql(f'fd_{n}', 250)} as fd_{n}_z" for n in ("adaptive", "025", "050",
    "075")) + " from fd)"
_fd = [f"fd_{n}{s}" for n in ("adaptive", "025", "050", "075") for s in ("", "_z")] + [f"fd_slope_{k}_{n}" for n in ("adaptive", "025",
    "050", "075") for k in (1, 4)] + [f"fd_curvature_{n}" for n in ("adaptive", "025", "050", "075")] + ["fd_cross_sm", "fd_cross_mf",
    "fd_cross_sf", "fractional_state"]
_fd_sql = ", ".join([f"fd_{n}, fd_{n}_z, fd_{n} - lag(fd_{n}) {ORDER} as fd_slope_1_{n}, fd_{n} - lag(fd_{n}, 4) {ORDER} as fd_slope_4_{n}, fd_{n} - 2 * lag(fd_{n}) {ORDER} + lag(fd_{n}, 2) {ORDER} as fd_curvature_{n}" for n in ("adaptive",
    "025", "050", "075")])


@query("FEA-01",
    sql_of(f"select {ID}, {_fd_sql}, fd_025_z - fd_050_z as fd_cross_sm, fd_050_z - fd_075_z as fd_cross_mf, fd_025_z - fd_075_z as fd_cross_sf, abs(fd_025_z) / (abs(fd_075_z) + 0.1) as fractional_state from fz",
    " ".join(_fd), FD, 5), 5)
def fea_01(spark, sf_dir):
    return X.fractional_features(bars_daily(spark, sf_dir).withColumn("log_close", F.log("close"))).select("instrument", "timestamp", *_fd)


@query("FEA-05", sql_of(f"select {ID}, {CORR50} as trend_state, {S[20]} / ({S[200]} + 1e-12) as volatility_state from r2",
    "trend_state volatility_state", RN))
def fea_05(spark, sf_dir):
    return X.regime_columns(ret(spark, sf_dir)).select("instrument", "timestamp", "trend_state", "volatility_state")


@query("FEA-06",
    sql_of(f"select {ID}, sigma_h, range_rel, sin(2 * pi() * m / 390) as time_sin, cos(2 * pi() * m / 390) as time_cos from (select *, date_part('hour', l) * 60 + date_part('minute', l) - 570 as m from (select *, timezone('America/New_York', \"timestamp\" at time zone 'UTC') as l from r1))",
    "sigma_h range_rel time_sin time_cos", RET15))
def fea_06(spark, sf_dir):
    return X.time_of_session(ret15(spark, sf_dir)).select("instrument", "timestamp", "sigma_h", "range_rel", "time_sin", "time_cos")


@query("FEA-07",
    sql_of(f"select {ID}, sigma_h, return_1 from (select *, (log_close - lag(log_close) {ORDER}) / (sigma_h + 1e-12) as return_1, row_number() over (partition by instrument order by \"timestamp\" desc) as back from r1) where back = 1",
    "sigma_h return_1", RET))
def fea_07(spark, sf_dir):
    """The newest row, from the last rows that it looks back on only."""
    from barloom.sources.bars import last_rows

    recent = last_rows(bars_daily(spark, sf_dir), X.required_history())
    return last_rows(X.return_features(X.with_returns(recent), (1,)), 1).select("instrument", "timestamp", "sigma_h", "return_1")


@query("FEA-08", "select 952::int as bars")
def fea_08(spark, sf_dir):
    return spark.range(1).select(F.lit(X.required_history()).cast("int").alias("bars"))


E_SQL = f"""case when bid >= lag(bid) {ORDER} then bid_size else 0 end - case when bid <= lag(bid) {ORDER} then lag(bid_size) {ORDER} else 0 end
 - case when ask <= lag(ask) {ORDER} then ask_size else 0 end + case when ask >= lag(ask) {ORDER} then lag(ask_size) {ORDER} else 0 end"""
OFI = RET + f", o as (select *, case when lag(bid) {ORDER} is not null then {E_SQL} end as ofi_raw, bid_size + ask_size as depth, (ask - bid) / ((bid + ask) / 2) as ofi_spread from r1), o2 as (select *, ofi_raw / (depth + 1e-12) as ofi_normalized from o)"


@query("FEA-10", sql_of(f"select {ID}, ofi_raw from o", "ofi_raw", OFI))
def fea_10(spark, sf_dir):
    return X.order_flow(bars_daily(spark, sf_dir)).select("instrument", "timestamp", "ofi_raw")


@query("FEA-11",
    sql_of(f"select {ID}, ofi_normalized, (bid_size - ask_size) / (depth + 1e-12) as quote_imbalance, ofi_spread, {z_sql('ofi_normalized', 100)} as ofi_zscore, {z_sql('ofi_normalized', 100)} - {z_sql('r', 100)} as ofi_price_divergence from o2",
    "ofi_normalized quote_imbalance ofi_spread ofi_zscore ofi_price_divergence", OFI))
def fea_11(spark, sf_dir):
    return X.ofi_features(ret(spark, sf_dir)).select("instrument", "timestamp", "ofi_normalized", "quote_imbalance", "ofi_spread",
        "ofi_zscore", "ofi_price_divergence")


_obs = "obs_return obs_abs_return obs_log_vol obs_log_volume obs_spread obs_trend"


@query("FEA-14",
    sql_of(f"select {ID}, r as obs_return, abs(r) as obs_abs_return, ln({S[20]} + 1e-12) as obs_log_vol, ln(1 + volume) as obs_log_volume, (ask - bid) / ((ask + bid) / 2) as obs_spread, {CORR50} as obs_trend from r2",
    _obs, RN))
def fea_14(spark, sf_dir):
    return X.hmm_observations(ret(spark, sf_dir)).select("instrument", "timestamp", *_obs.split())


PHI = "0.5 * (1 + sign(u) * (1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-y * y)))"
VPIN = RET + f""", p1 as (select *, r / (sigma_h + 1e-12) as u from r1), p2 as (select *, abs(u) / sqrt(2) as y from p1), p3 as (select *, 1 / (1 + 0.3275911 * y) as t from p2),
p4 as (select *, 2 * {PHI} * volume - volume as imb from p3), p5 as (select *, {full('imb', 5, f'abs(sum(imb) {over(5)})')} as bi, {full('volume', 5, f'sum(volume) {over(5)}')} as bv from p4)"""


@query("FEA-13",
    sql_of(f"select {ID}, (" + " + ".join(f"lag(bi, {249 - 5 * k}) {ORDER}" for k in range(50)) + ") / (" + " + ".join(f"lag(bv, {249 - 5 * k}) {ORDER}" for k in range(50)) + ") as vpin from p5",
    "vpin", VPIN))
def fea_13(spark, sf_dir):
    return X.vpin(ret(spark, sf_dir)).select("instrument", "timestamp", "vpin")


def _series(spark, sf_dir, name):
    out = ret15(spark, sf_dir).where(F.col("instrument") == name).withColumns({"all": F.lit(1),
        "r4": F.col("log_close") - W.lag("log_close", 4)})
    return out


def _xa_join(n):
    return f"left join lateral (select r, r4, log_close, \"timestamp\" as ts from x where x.instrument = '{n}' and x.\"timestamp\" <= p.\"timestamp\" and x.\"timestamp\" >= p.\"timestamp\" - interval 1800 seconds order by x.\"timestamp\" desc limit 1) {n} on true"


XA = RET15 + f", x as (select *, log_close - lag(log_close, 4) {ORDER} as r4 from r1), j as (select p.*, c.r as click_r, c.r4 as click_r4, c.log_close as click_lc, c.\"timestamp\" as click_t, s.r as purchase_r, s.r4 as purchase_r4, s.log_close as purchase_lc, s.\"timestamp\" as purchase_t from (select * from x where instrument = 'view') p asof left join (select * from x where instrument = 'click') c on p.\"timestamp\" >= c.\"timestamp\" asof left join (select * from x where instrument = 'purchase') s on p.\"timestamp\" >= s.\"timestamp\")"
XA += ", k as (select * replace (" + ", ".join(f"case when date_diff('microsecond', {n}_t, \"timestamp\") <= 1800000000 then {n}_{c} end as {n}_{c}" for n in ("click",
    "purchase") for c in ("r", "r4", "lc")) + ") from j)"


def _xa_cols(n):
    c = lambda w: f"case when count(*) {over(w)} = {w} then covar_pop(coalesce(r, 0), coalesce({n}_r, 0)) {over(w)} / nullif(stddev_pop(coalesce(r, 0)) {over(w)} * stddev_pop(coalesce({n}_r, 0)) {over(w)}, 0) end"
    return f"({n}_r - r) / (sigma_h + 1e-12) as xa_{n}_rel_return_1, ({n}_r4 - r4) / (2 * sigma_h + 1e-12) as xa_{n}_rel_return_4, {c(20)} as xa_{n}_corr_short, {c(20)} - {c(200)} as xa_{n}_corr_breakdown"


_xa = [f"xa_{n}_{c}" for n in ("click", "purchase") for c in ("rel_return_1", "rel_return_4", "corr_short",
    "corr_breakdown")] + ["xa_breadth", "xa_dispersion"]


@query("FEA-12",
    sql_of(f"select {ID}, {_xa_cols('click')}, {_xa_cols('purchase')}, (coalesce((click_r > 0)::int, 0) + coalesce((purchase_r > 0)::int, 0)) / 2.0::double as xa_breadth, case when click_r is null and purchase_r is null then null when click_r is null or purchase_r is null then 0 else abs(click_r - purchase_r) / 2 end / (sigma_h + 1e-12) as xa_dispersion from k",
    " ".join(_xa), XA, 5), 5)
def fea_12(spark, sf_dir):
    out = X.cross_asset(_series(spark, sf_dir, "view"), {n: _series(spark, sf_dir, n) for n in ("click", "purchase")})
    return out.select("instrument", "timestamp", *_xa)


@query("JOI-01",
    sql_of('select p.instrument, p."timestamp", p.close, c.close as other, date_diff(\'microsecond\', c."timestamp", p."timestamp") / 1e6 as age_s from (select * from bars where instrument = \'view\') p asof left join (select * from bars where instrument = \'click\') c on p."timestamp" >= c."timestamp"',
    "close other age_s", BARS_15M))
def joi_01(spark, sf_dir):
    bars = bars_15m(spark, sf_dir).withColumn("all", F.lit(1))
    other = bars.where("instrument = 'click'").select("all", "timestamp", F.col("close").alias("other"))
    return asof_join(bars.where("instrument = 'view'"), other, ["all"], ["other"]).select("instrument", "timestamp", "close", "other",
        "age_s")
