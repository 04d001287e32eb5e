"""SQL for queries of recursions and simulations, as recursive and windowed SQL over the same tables."""

from __future__ import annotations

from barloom.operators import fractional as FR
from barloom.plans import metrics as PM
from barloom.plans.base import BARS_DAILY, ORDER, SQL, sql_of
from barloom.plans.decisions import EM, FC, LAB, PNL, RSM, SIM, TARGET, VM, XM
from barloom.plans.windows import RET, RN, WIN15, dot

ID = 'instrument, "timestamp"'
READY = "sigma_h is not null and open_next2 is not null and cost_side_exec is not null"


def simulated(series: str) -> str:
    """The views of a simulation over series: rows with the columns of lab, one for each key of `instrument`."""
    return SIM.replace("from lab)", "from series)").replace(LAB,
        LAB + f", ready as (select *, row_number() {ORDER} as vn from lab where {READY}), series as ({series})")


# --- folds
SQL["SCA-10"] = sql_of(f"select instrument || '/base' as key, \"timestamp\", exposure from ({PNL})", "exposure", SIM)
MOMENTUM = RET + f""", o as (select instrument, row_number() {ORDER} as n, "timestamp", case when sigma_h > 0 and lag(log_close, 65) {ORDER} is not null then greatest(-1, least(1, (log_close - lag(log_close, 65) {ORDER}) / (sigma_h * sqrt(65)))) end as want from r1),
e(instrument, n, ts, q) as (select instrument, n, "timestamp", 0.0::double from o where n = 1
 union all select o.instrument, o.n, o."timestamp", case when o.want is null then e.q when sign(o.want) <> sign(e.q) or abs(o.want - e.q) >= 0.15 then o.want else e.q end from e join o on o.instrument = e.instrument and o.n = e.n + 1)"""
SQL["FLD-04"] = sql_of('select instrument, ts as "timestamp", q as exposure from e', "exposure", MOMENTUM)

# local linear trend with level noise 1e-4, velocity noise 1e-6 and measurement noise 1e-4: predicted a and b, then updated x and p
KALMAN = RET + f""", o as (select instrument, row_number() {ORDER} as n, "timestamp", log_close as y, sigma_h from r1),
k(instrument, n, x0, x1, p00, p01, p11, inn, s) as (select instrument, n, y, 0.0::double, 1e-3 * (1 - 1e-3 / 1.1e-3), 0.0::double, 1e-4::double, 0.0::double, 1.1e-3::double from o where n = 1
 union all select instrument, n, a0 + b00 / (b00 + 1e-4) * (y - a0), a1 + b01 / (b00 + 1e-4) * (y - a0), b00 * (1 - b00 / (b00 + 1e-4)), b01 * (1 - b00 / (b00 + 1e-4)), b11 - b01 * b01 / (b00 + 1e-4), y - a0, b00 + 1e-4
 from (select o.instrument, o.n, o.y, k.x0 + k.x1 as a0, k.x1 as a1, k.p00 + 2 * k.p01 + k.p11 + 1e-4 as b00, k.p01 + k.p11 as b01, k.p11 + 1e-6 as b11 from k join o on o.instrument = k.instrument and o.n = k.n + 1)),
f as (select o.instrument, o."timestamp", o.y, k.*  exclude (instrument, n), case when o.sigma_h > 0 then o.sigma_h + 1e-12 end as unit from k join o on o.instrument = k.instrument and o.n = k.n)"""
SQL["FEA-20"] = sql_of(f"select {ID}, x0 as level from f", "level", KALMAN)
SQL["FEA-22"] = sql_of(f"""select {ID}, (x0 - y) / unit as kalman_price, x1 / unit as kalman_velocity, (x1 - lag(x1) {ORDER}) / unit as kalman_acceleration, inn / unit as kalman_innovation,
 inn / sqrt(greatest(s, 1e-12)) as kalman_innovation_z, sqrt(greatest(p00, 0)) / unit as kalman_state_uncertainty, (y - x0) / unit as kalman_observed_minus_filtered from f""",
                       "kalman_price kalman_velocity kalman_acceleration kalman_innovation kalman_innovation_z kalman_state_uncertainty kalman_observed_minus_filtered",
                           KALMAN)
DOLLARS = RSM.replace("t.size", "t.price * t.size").replace("TARGET", "50000")
SQL["RSM-02"] = sql_of("""select b.instrument, min(t."timestamp") as start, arg_min(t.price, t.n) as open, max(t.price) as high, min(t.price) as low, arg_max(t.price, t.n) as close, sum(t.size) as volume,
 sum(t.price * t.size) as dollar_volume, count(*) as deal_count, 'dollar-' || b.bar || case when sum(t.price * t.size) < 50000 then '-partial' else '' end as bar_id
 from b join t on t.instrument = b.instrument and t.n = b.n group by b.instrument, b.bar""", "open high low close volume dollar_volume",
     DOLLARS)


# --- orders against the label
def order_corr(orders: dict[str, float]) -> str:
    return LAB + ", fo as (select *, " + ", ".join(f"{dot('log_close', list(FR.weights(d)))} as {n}" for n,
        d in orders.items()) + " from lab)"


def corr(a: str, b: str) -> str:
    both = f"({a} is not null and {b} is not null)"
    return f"case when count_if({both}) < 3 then 0 else coalesce(covar_pop({a}, {b}) / nullif(stddev_pop(case when {both} then {a} end) * stddev_pop(case when {both} then {b} end), 0), 0) end"


SQL["AGG-13"] = sql_of(" union all ".join(f"select instrument, {d}::double as d, {corr(n, 'y')} as score from fo group by 1" for n,
    d in (("f0", 0.25), ("f1", 0.5), ("f2", 0.75))), "d score",
                       order_corr({"f0": 0.25, "f1": 0.5, "f2": 0.75}))
STEPS = {"step_m2": 0.25, "step_m1": 0.3, "step_0": 0.35, "step_1": 0.4, "step_2": 0.45}
SQL["STR-05"] = sql_of("select instrument, " + ", ".join(f"{corr('f' + n, 'y')} as {n}" for n in STEPS) + " from fo group by 1",
    " ".join(STEPS), order_corr({"f" + n: d for n, d in STEPS.items()}))

# --- the per-bar engine on daily bars: fill of what the bar before ordered, marks, halts (a bar is a day of its own), rules, the next order
ENGINE = FC + f""", b as (select *, row_number() {ORDER} as n, row_number() {ORDER} // 250 as win, {TARGET} as goal from f3),
e(instrument, n, cash, units, pending, q, hold, ep, es, peak, wh, filled, price, equity, status, target, why) as (
 select instrument, 0::bigint, 100000.0::double, 0.0::double, 0.0::double, 0.0::double, 0::bigint, 1.0::double, 0.0::double, 100000.0::double, -1::bigint, 0.0::double, null::double, null::double, '', 0.0::double, '' from b where n = 1
 union all select instrument, n, cash, units, case when not changed then 0 when new = 0 then -units when abs(equity * new / close - units) * close >= 100 then equity * new / close - units else 0 end, new,
  case when new = 0 or enters then 0 else held end, case when enters then close else ep end, case when enters then coalesce(sigma_h, 0) else es end, peak, wh, pending, price, equity, status, want, why
 from (select *, new <> 0 and (entry or q = 0) as enters, new <> q or entry as changed
 from (select *, case when n <= 200 or stop then 0 when hit then 0 when q <> 0 and held >= 12 then want when sign(want) <> sign(q) or abs(want - q) >= 0.15 then want else q end as new,
   n > 200 and not stop and not hit and want <> 0 and ((q <> 0 and held >= 12) or sign(want) <> sign(q)) as entry,
   case when n <= 200 then '' when stop then case when q <> 0 then 'halt' else '' end when hit then 'stop' when q <> 0 and held >= 12 then case when want <> 0 then 'reentry' else 'max_holding' end
    when sign(want) = sign(q) or q = 0 then '' when want <> 0 then 'flip' else 'flat' end as why, case when n <= 200 then 'INITIALIZING' when stop then 'HALTED' else 'RUNNING' end as status
 from (select *, equity <= 0 or wh = win or (day_start > 0 and equity / day_start - 1 < -0.025) as stop, case when n > 200 then goal else 0 end as want, case when n > 200 and q <> 0 then hold + 1 else hold end as held,
   n > 200 and q <> 0 and sign(q) * (ln(close) - ln(ep)) < -8 * es as hit
 from (select * exclude (wh), case when equity <= 0 then wh when equity / peak - 1 < -0.10 or wh = win then win else -1 end as wh
 from (select * exclude (peak), case when equity <= 0 then peak when wh not in (-1, win) then equity else greatest(peak, equity) end as peak
 from (select *, cash + units * open as day_start, cash + units * close as equity
 from (select * exclude (cash, units), cash - case when pending <> 0 then pending * price + abs(pending) * price * 1e-4 else 0 end as cash, units + pending as units
 from (select b.*, e.* exclude (instrument, n, filled, price, equity, status, target, why), case when e.pending <> 0 then b.open * (1 + sign(e.pending) * (coalesce(b.relative_spread, 0) / 2 + 0.05 * coalesce(b.range_rel, 0))) end as price
 from e join b on b.instrument = e.instrument and b.n = e.n + 1))))))))),
g as (select b."timestamp", e.*, q as approved, pending as ordered from e join b on b.instrument = e.instrument and b.n = e.n)"""
SQL["FLD-13"] = sql_of(f"select {ID}, status, target, approved, why as reason, ordered from g", "target approved ordered", ENGINE)
SQL["FLD-14"] = sql_of(f"select {ID}, filled, price as fill_price, units, cash, equity from g where filled <> 0", "filled fill_price units cash equity", ENGINE, 4)
SQL["FLD-08"] = sql_of(f"select {ID}, target, approved, why as reason, ordered, equity from g where status = 'HALTED'", "target approved ordered equity", ENGINE, 4)

# --- simulations and what is measured of them
SAN = " union all ".join(f"select * replace (instrument || '/{n}' as instrument, {er} as er) from ready" for n, er in
                         (("base", "er"), ("reversed", "-er"), ("shifted", f"coalesce(lag(er, 20) {ORDER}, 0)"), ("zero", "0.0::double")))
SQL["SAN-01"] = sql_of(f"select instrument as key, sum(pnl) as total, count(*) as n from ({PNL}) group by 1", "total", simulated(SAN))
SQL["MOD-10"] = sql_of(f"select instrument as key, sum(pnl) as net, count(*) as n from ({PNL}) group by 1", "net",
    simulated("select * replace (instrument || '/holdout' as instrument) from ready where vn > 2000"))
BACKTEST = simulated("select * replace (instrument || '/backtest' as instrument) from ready") + f""", pn as ({PNL}), p1 as (select instrument, "timestamp", exposure as q, pnl, exp(sum(case when pnl > -1 then ln(1 + pnl) end) {ORDER}) as equity from pn),
p as (select *, 1 - equity / greatest(max(equity) {ORDER}, 1) as drawdown from p1), a as ({PM.AGG1}), m as (select *, (select avg(pnl) from p where p.instrument = a.instrument and pnl <= a.var_95) as es_95,
 (select sqrt(avg(pow(least(pnl, 0), 2))) from p where p.instrument = a.instrument) as downside, (select count_if(pnl > 0) from p where p.instrument = a.instrument)::bigint as up_bars, pow(greatest(1 + total_return, 1e-9), 252.0 / n) - 1 as cagr from a)"""
SQL["API-01"] = sql_of("select instrument as key, * exclude (instrument), coalesce(cagr / nullif(max_drawdown, 0), 0) as calmar from m",
    PM.A1 + " es_95 downside cagr calmar", BACKTEST)
SQL["ABL-02"] = sql_of("select pn.instrument, vol_tag, coalesce(avg(pnl) / nullif(stddev_pop(pnl), 0), 0) * sqrt(252) as sharpe from pn join tags on tags.instrument = pn.instrument and tags.\"timestamp\" = pn.\"timestamp\" group by 1, 2",
    "sharpe",
                       SIM + f", r2 as (select *, row_number() {ORDER} as rn from r1), tags as ({WIN15}), pn as ({PNL})")
SQL["RUN-03"] = sql_of("""select avg(delta) as mean, median(delta) as median, case when count(*) > 2 then (sum(delta) - max(delta) - min(delta)) / (count(*) - 2) else list_sort(list(delta))[2] end as trimmed,
 (sum(delta) - max(delta)) / greatest(count(*) - 1, 1) as without_best from (select (vn - 1) // 250 as w, sum(er * (open_next2 / open_next - 1)) as delta from ready group by 1)""",
     "mean median trimmed without_best",
                       LAB + f", ready as (select *, row_number() {ORDER} as vn from lab where {READY})")

# --- simulated rows and deals, with the equity, the drawdown halt of a window and what each deal cost. Daily bars are sessions of their
# own, so a daily loss halts nothing. A row's side cost, opens and target are those of its scenario
LEGACY = f"case when abs(er) - 3 * cost * {EM} > 0 then greatest(-{XM}, least({XM}, sign(er) * least(1, abs(er) / (6 * cost * {EM} + 1e-12)) * {VM})) else 0 end"


def folded(series: dict[str, tuple[str, float, int, bool]]) -> str:
    """Views up to e, a row for each bar of series: name -> target, times the side cost, bars of delay, whether a drawdown halts."""
    one = lambda name, goal, times, d, halts: f"""select instrument || '/{name}' as instrument, "timestamp", vn as n, last_n - {d} as last_n, (vn - 1) // 250 as win, {goal} as want, log_close, sigma_h, {times} * lead(cost_side_exec, {d}) {ORDER} as side,
  lead(open_next, {d}) {ORDER} as deal_price, lead(open_next2, {d}) {ORDER} / lead(open_next, {d}) {ORDER} - 1 as move, {halts} as halts from placed"""  # noqa: E731
    return LAB + f""", placed as (select *, row_number() {ORDER} as vn, count(*) over (partition by instrument) as last_n from lab where {READY}),
x as materialized (select * from ({" union all ".join(one(n, *v) for n, v in series.items())}) where n <= last_n),
e(instrument, n, q, hold, ep, es, equity, peak, win, off, pnl, cost_bar, since, gross, paid, ends, d_since, d_side, d_gross, d_cost, why) as (
 select instrument, 0::bigint, 0.0::double, 0::bigint, 1.0::double, 0.0::double, 1.0::double, 1.0::double, -1::bigint, false, 0.0::double, 0.0::double, 0::bigint, 0.0::double, 0.0::double, false, 0::bigint, 0, 0.0::double, 0.0::double, '' from x where n = 1
 union all select instrument, n, new, case when new = 0 or opens then 0 else held end, case when opens then deal_price else ep end, case when opens then coalesce(sigma_h, 0) else es end, equity * (1 + new * move - cost), greatest(peak, equity * (1 + new * move - cost)), win, off,
  new * move - cost, cost, case when opens then n else since end, case when ends then 0 else gross end + new * move,
  case when opens then case when ends and turned then cost - abs(q) * side else cost end when new <> 0 then paid + cost when ends then 0 else paid end, ends, since, sign(q)::int, gross, paid + case when turned then abs(q) * side else 0 end, case when why = '' then 'flat' else why end
 from (select *, ends and new <> 0 or q = 0 and new <> 0 as opens, abs(new - q) * side as cost, sign(new) <> sign(q) as turned
 from (select *, q <> 0 and (new = 0 or sign(new) <> sign(q) or entry) as ends
 from (select *, case when off or hit then 0 when q <> 0 and held >= 12 then want when sign(want) <> sign(q) or abs(want - q) >= 0.15 then want else q end as new, not off and not hit and want <> 0 and ((q <> 0 and held >= 12) or sign(want) <> sign(q)) as entry,
   case when off then case when q <> 0 then 'halt' else '' end when hit then 'stop' when q <> 0 and held >= 12 then case when want <> 0 then 'reentry' else 'max_holding' end when sign(want) <> sign(q) and q <> 0 then case when want <> 0 then 'flip' else 'flat' end else '' end as why
 from (select * exclude (off), off or (halts and equity / peak - 1 < -0.10) as off, case when q <> 0 then hold + 1 else hold end as held, q <> 0 and sign(q) * (log_close - ln(ep)) < -8 * es as hit
 from (select x.*, e.q, e.hold, e.ep, e.es, e.equity, case when e.off and e.win <> x.win then e.equity else e.peak end as peak, e.off and e.win = x.win as off, e.since, e.gross, e.paid
 from e join x on x.instrument = e.instrument and x.n = e.n + 1))))))"""


FOLDED = {"base": (TARGET, 1.0, 0, False), "double": (TARGET, 2.0, 0, False), "delay1": (TARGET, 1.0, 1, False), "halts": (TARGET, 1.0, 0, True), "legacy": (LEGACY, 1.0, 0, False)}
SQL["FLD-02"] = sql_of("""select e.instrument as key, x."timestamp", q as exposure, pnl, cost_bar, equity from e join x on x.instrument = e.instrument and x.n = e.n
 union all select p.instrument || '/delay1', p."timestamp", 0, 0, 0, e.equity from placed p join e on e.instrument = p.instrument || '/delay1' and e.n = p.last_n - 1 and p.vn = p.last_n""", "exposure pnl cost_bar equity", folded(FOLDED))
SQL["FLD-17"] = sql_of("""select instrument as key, d_since - 1 as entry_row, n - 1 as exit_row, d_side as side, d_gross as gross, d_cost as cost, d_gross - d_cost as net, why as reason from e where ends
 union all select instrument, since - 1, n - 1, sign(q)::int, gross, paid, gross - paid, 'end' from e join (select instrument, max(n) as n from e group by 1) using (instrument, n) where q <> 0""", "gross cost net", folded({"base": FOLDED["base"]}))

# --- scenarios: costs of decisions and of fills, and fills that come some bars later. A row without a later fill deals nothing
def scenarios(named: dict[str, tuple[str, str, int]]) -> str:
    """Views up to m (instrument, scenario, total_return, sharpe, max_drawdown, mean_exposure) of scenarios: cost that decisions expect,
    cost of a side, delay."""
    one = lambda name, cost, side, d: f"""select * replace (instrument || '/{name}' as instrument, {cost} as cost, {later(side, d)} as cost_side_exec, {later('open_next', d)} as open_next, {later('open_next2', d)} as open_next2) from ready"""
    later = lambda x, d: f"lead({x}, {d}) {ORDER}" if d else x
    idle = [f"""select instrument || '/{n}' as instrument, "timestamp", 0.0::double as q, 0.0::double as pnl from (select *, count(*) over (partition by instrument) - vn as left_over from ready) where left_over < {d}""" for n, (_, _, d) in named.items() if d]
    rows = " union all ".join([f"select instrument, \"timestamp\", exposure as q, pnl from ({PNL})", *idle])
    return simulated(" union all ".join(one(n, *v) for n, v in named.items())) + f""", p1 as (select *, exp(sum(case when pnl > -1 then ln(1 + pnl) end) {ORDER}) as equity from ({rows})), p as (select *, 1 - equity / greatest(max(equity) {ORDER}, 1) as drawdown from p1),
 m as (select split_part(instrument, '/', 1) as instrument, split_part(instrument, '/', 2) as scenario, product(1 + pnl) - 1 as total_return, coalesce(avg(pnl) / nullif(stddev_pop(pnl), 0), 0) * sqrt(252) as sharpe, max(drawdown) as max_drawdown, avg(abs(q)) as mean_exposure from p group by all)"""


MEASURED = "total_return sharpe max_drawdown mean_exposure"
SQL["STR-03"] = sql_of("select * from m", MEASURED, scenarios({f"delay_{d}": ("cost", "cost_side_exec", d) for d in (0, 1, 2)}))
LEVELS = (0.5, 1.0, 1.5, 2.0, 3.0)
SQL["STR-02"] = sql_of("select *, total_return > 0 as survives from m", MEASURED,
                       scenarios({f"x{x}_d{d}": ("cost", f"cost_side_exec * {x}", d) for x in LEVELS for d in (0, 1, 2, 3)} | {f"adaptive_x{x}": (f"cost * {x}", f"cost_side_exec * {x}", 0) for x in LEVELS}))
COSTS = {f"realised_{x}": ("cost", f"cost_side_exec * {x}", 0) for x in (0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 5.0)} | {f"signal_{x}": (f"cost * {x}", "cost_side_exec", 0) for x in (0.5, 1.0, 2.0)}
COSTS |= {f"bps_{x}": ("cost", f"{x} / 2e4::double", 0) for x in (0, 1, 2, 5, 10, 20, 50)}
SQL["STR-01"] = sql_of("""select * exclude (x), min(x) over (partition by instrument, kind) as break_even from (select *, case when lag(total_return) over w > 0 and total_return <= 0
 then lag(level) over w + (level - lag(level) over w) * lag(total_return) over w / (lag(total_return) over w - total_return) end as x from (select *, split_part(scenario, '_', 1) as kind, split_part(scenario, '_', 2)::double as level from m) window w as (partition by instrument, kind order by level))""",
                       MEASURED + " level break_even", scenarios(COSTS), 3)

# --- ridge of three inputs, by Cramer's rule on its normal equations
GRAM = LAB + """, x as (select range_rel as a, relative_spread as b, greatest(-0.1, least(0.1, ln(close_next) - ln(open_next))) as t from lab where range_rel is not null and relative_spread is not null),
g as (select count(*)::double as n, sum(a) as sa, sum(b) as sb, sum(a * a) + 1 as aa, sum(a * b) as ab, sum(b * b) + 1 as bb, sum(t) as st, sum(a * t) as ta, sum(b * t) as tb from x),
d as (select *, n * (aa * bb - ab * ab) - sa * (sa * bb - ab * sb) + sb * (sa * ab - aa * sb) as det from g)"""
SQL["MOD-07"] = sql_of("""select 'one' as input, (st * (aa * bb - ab * ab) - sa * (ta * bb - ab * tb) + sb * (ta * ab - aa * tb)) / det as weight from d
 union all select 'range_rel', (n * (ta * bb - ab * tb) - st * (sa * bb - ab * sb) + sb * (sa * tb - ta * sb)) / det from d
 union all select 'relative_spread', (n * (aa * tb - ta * ab) - sa * (sa * tb - ta * sb) + st * (sa * ab - aa * sb)) / det from d""",
     "weight", GRAM)
SQL["RUN-05"] = sql_of("select k::bigint as run, k / 10.0::double as sharpe from generate_series(0, 2) t(k)", "sharpe", "one as (select 1)")
