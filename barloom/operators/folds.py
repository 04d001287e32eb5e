"""Path-dependent operators: one ordered pass over each instrument (or scenario), the same kernels in batch and streaming."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.sources.bars import KEY, TIME

SIM_COLUMNS = ["er", "sigma", "sigma_ref", "cost", "cost_side", "log_close", "open_next", "open_next2", "adverse", "uncertainty",
    "stress_p", "session", "window"]


@dataclass(frozen=True)
class SimParams:
    """The system's defaults."""

    rule: str = "net_edge"
    min_edge: float = 8e-4
    buffer: float = 3e-4
    cost_multiple: float = 3.0
    confidence_multiple: float = 6.0
    rebalance: float = 0.15
    max_holding: int = 12
    reevaluate_every: int = 1
    horizon: int = 4
    stop_multiple: float = 4.0
    vm_low: float = 0.25
    vm_high: float = 1.5
    max_abs: float = 1.0
    stress: float = 0.70
    stress_exposure: float = 0.40
    stress_edge: float = 1.5
    cost_scale: float = 1.0
    signal_cost_scale: float = 1.0
    cost_bps: float | None = None
    delay: int = 0
    daily_loss: float | None = None
    drawdown_halt: float | None = None
    eps: float = 1e-12


def targets(a: dict[str, np.ndarray], p: SimParams) -> np.ndarray:
    """Wanted exposure of each row; needs no state, so it is vectorised."""
    clean = lambda x: np.where(np.isfinite(x), x, 0.0)
    er, cost = a["er"], clean(a["cost"]) * p.signal_cost_scale
    size = np.abs(clean(er))
    hit = np.isfinite(a["stress_p"]) & (a["stress_p"] > p.stress)
    edge, cap = np.where(hit, p.stress_edge, 1.0), p.max_abs * np.where(hit, p.stress_exposure, 1.0)
    if p.rule == "net_edge":
        net = size - cost - clean(a["adverse"]) - p.buffer - np.maximum(clean(a["uncertainty"]), 0)
        deal, conf = net > p.min_edge * edge, net / (p.confidence_multiple * np.maximum(cost, p.min_edge) * edge + p.eps)
    else:
        net = size - p.cost_multiple * cost * edge
        deal, conf = net > 0, size / (p.confidence_multiple * cost * edge + p.eps)
    good = np.isfinite(a["sigma_ref"]) & np.isfinite(a["sigma"]) & (a["sigma"] > 0)
    vm = np.where(good, np.clip(a["sigma_ref"] / np.where(good, a["sigma"], 1.0), p.vm_low, p.vm_high), p.vm_low)
    q = np.sign(clean(er)) * np.minimum(1.0, conf) * vm
    return np.where(deal & np.isfinite(er), np.clip(q, -cap, cap), 0.0)


def sign(x: float) -> int:
    return (x > 0) - (x < 0)


def step_rules(want: float, q: float, holding: int, stopped: bool, p: SimParams) -> tuple[float, bool, str]:
    """Next exposure, whether it is a new entry, and why: stop, holding limit, hold to horizon, turnover."""
    if q and stopped:
        return 0.0, False, "stop"
    if q and holding >= p.max_holding:
        return (want, True, "reentry") if want else (0.0, False, "max_holding")
    if q and p.reevaluate_every > 1 and holding % p.reevaluate_every:
        return q, False, ""
    if sign(want) != sign(q):
        return want, want != 0, "flip" if want and q else "flat" if q else ""
    return (want, False, "") if abs(want - q) >= p.rebalance else (q, False, "")


def simulate(a: dict[str, np.ndarray], p: SimParams) -> tuple[dict[str, np.ndarray], list[tuple]]:
    """Rows (exposure, pnl, cost, equity) and deals (entry, exit, side, gross, cost, net, reason) of one ordered series."""
    n = len(a["er"])
    plain = lambda x: np.where(np.isfinite(x), x, 0.0).tolist()  # noqa: E731  (the loop takes plain numbers, one at a time)
    want, sessions, windows, log_close = targets(a, p).tolist(), a["session"].tolist(), a["window"].tolist(), a["log_close"].tolist()
    prices, sigmas = a["open_next"].tolist(), plain(a["sigma"])
    with np.errstate(all="ignore"):
        moves = plain(a["open_next2"] / a["open_next"] - 1)
        side_costs = plain(a["cost_side"] * p.cost_scale) if p.cost_bps is None else [p.cost_bps / 2e4] * n
    out = {k: np.zeros(n) for k in ("exposure", "pnl", "cost_bar")}
    exposures, pnls, costs, values = [], [], [], []
    equity = np.ones(n)
    deals: list[tuple] = []
    value = peak = day_start = 1.0
    q, holding, entry_price, entry_sigma = 0.0, 0, math.nan, math.nan
    gross = paid = 0.0
    since, day_halt, window_halt = -1, None, None
    session = window = None

    def close(row: int, why: str) -> None:
        deals.append((since, row, sign(q), gross, paid, gross - paid, why))

    for i in range(n - p.delay):
        if sessions[i] != session:
            session, day_start = sessions[i], value
        if windows[i] != window:
            if window_halt is not None:  # only a halt that ends moves the peak: losses spread over windows still add up
                window_halt, peak = None, value
            window = windows[i]
        if q:
            holding += 1
        stopped = bool(q) and sign(q) * (log_close[i] - math.log(entry_price)) < -p.stop_multiple * entry_sigma * math.sqrt(p.horizon)
        new, entry, why = step_rules(want[i], q, holding, stopped, p)
        if p.daily_loss is not None and day_start and value / day_start - 1 < -p.daily_loss:
            day_halt = session
        if p.drawdown_halt is not None and value / peak - 1 < -p.drawdown_halt:
            window_halt = window
        if (day_halt is not None and day_halt == session) or window_halt is not None:
            new, entry, why = 0.0, False, "halt" if q else ""
        j = i + p.delay
        move, side_cost = moves[j], side_costs[j]
        cost = abs(new - q) * side_cost
        ends = bool(q) and (new == 0 or sign(new) != sign(q) or entry)
        if ends:
            if sign(new) != sign(q):  # the old size pays for its own close, a re-entry closes free
                paid += abs(q) * side_cost
            close(i, why or "flat")
            gross, paid, since = 0.0, 0.0, -1
        if new and (not q or ends):
            since, holding = i, 0
            entry_price, entry_sigma = prices[j], sigmas[i]
            paid = cost - abs(q) * side_cost if ends and sign(new) != sign(q) else cost
        elif new:
            paid += cost
        if not new:
            holding = 0
        q = new
        pnl = q * move - cost
        gross += q * move
        value *= 1 + pnl
        peak = max(peak, value)
        exposures.append(q)
        pnls.append(pnl)
        costs.append(cost)
        values.append(value)
    for column, made in ((out["exposure"], exposures), (out["pnl"], pnls), (out["cost_bar"], costs), (equity, values)):
        column[: len(made)] = made
    if p.delay:
        equity[max(n - p.delay, 0):] = value
    if q:
        close(n - p.delay - 1, "end")
    return out | {"equity": equity}, deals


ROWS = "key string, timestamp timestamp, exposure double, pnl double, cost_bar double, equity double"
#: tasks of a key over which scenarios are dealt
SCENARIO_GROUPS = 4
DEALS = "key string, entry_row long, exit_row long, side int, gross double, cost double, net double, reason string"


def _arrays(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
    return {c: pdf[c].to_numpy(float) for c in SIM_COLUMNS}


def simulate_frame(rows: DataFrame, params: dict[str, SimParams], key: str = KEY, want_deals: bool = False) -> DataFrame:
    """Simulated rows, or deals, of each key and scenario. Rows are copied to SCENARIO_GROUPS tasks of their key at most, whatever the
    number of scenarios; a task runs its share of them one after the other."""
    names = list(params)
    groups = min(len(names), SCENARIO_GROUPS)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(TIME)
        arrays, done = _arrays(pdf), []
        for name in names[int(pdf["_group"].iloc[0]) :: groups]:
            out, deals = simulate(arrays, params[name])
            label = f"{pdf[key].iloc[0]}/{name}"
            if want_deals:
                done.append(pd.DataFrame([(label, *t) for t in deals], columns=[f.split()[0] for f in DEALS.split(", ")]))
            else:
                done.append(pd.DataFrame({"key": label, "timestamp": pdf[TIME].to_numpy(), **out})[[f.split()[0] for f in ROWS.split(", ")]])
        return pd.concat(done)

    picked = rows.select(key, TIME, *SIM_COLUMNS, F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_group"))
    return picked.groupBy(key, "_group").applyInPandas(run, DEALS if want_deals else ROWS)


def scenario(**changes) -> SimParams:
    return replace(SimParams(), **changes)


# --- simpler folds
def ema_kernel(x: np.ndarray, span: int, start: float = math.nan) -> np.ndarray:
    """Recursive EMA; missing values hold the last one."""
    alpha, last, out = 2 / (span + 1), start, np.empty(len(x))
    for i, v in enumerate(x):
        if math.isfinite(v):
            last = v if not math.isfinite(last) else last + alpha * (v - last)
        out[i] = last
    return out


def fold_column(df: DataFrame, x: str | list[str], kernel, name: str = "value") -> DataFrame:
    """instrument, timestamp and what kernel(values in time order) returns for each row."""
    xs = [x] if isinstance(x, str) else x

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(TIME)
        out = kernel(*[pdf[c].to_numpy(float) for c in xs])
        return pd.DataFrame({KEY: pdf[KEY].to_numpy(), TIME: pdf[TIME].to_numpy(), name: out})

    return df.select(KEY, TIME, *xs).groupBy(KEY).applyInPandas(run, f"{KEY} string, {TIME} timestamp, {name} double")


def momentum_exposure(log_close: np.ndarray, sigma: np.ndarray, lookback: int = 65, rebalance: float = 0.15) -> np.ndarray:
    """Hysteresis exposure: the lookback's z, clipped to 1, taken on when it differs enough or changes sign."""
    out, q = np.zeros(len(log_close)), 0.0
    for i in range(len(log_close)):
        if i >= lookback and math.isfinite(sigma[i]) and sigma[i] > 0:
            want = float(np.clip((log_close[i] - log_close[i - lookback]) / (sigma[i] * math.sqrt(lookback)), -1, 1))
            if np.sign(want) != np.sign(q) or abs(want - q) >= rebalance:
                q = want
        out[i] = q
    return out


def kalman(y: np.ndarray, q_level: float, q_velocity: float, r: float) -> tuple[np.ndarray, float]:
    """Local linear trend: columns level, velocity, innovation, S, P00 and the log likelihood. Missing values are only predicted."""
    out, ll = np.full((len(y), 5), math.nan), 0.0
    start = next((i for i, v in enumerate(y) if math.isfinite(v)), None)
    if start is None:
        return out, -math.inf
    x, p = np.array([y[start], 0.0]), np.diag([10 * r, r])
    f, q = np.array([[1.0, 1.0], [0.0, 1.0]]), np.diag([q_level, q_velocity])
    for i in range(start, len(y)):
        if i > start:
            x, p = f @ x, f @ p @ f.T + q
        innovation, s = math.nan, p[0, 0] + r
        if math.isfinite(y[i]):
            innovation = y[i] - x[0]
            gain = p[:, 0] / s
            x = x + gain * innovation
            p = p - np.outer(gain, p[0])
            if i > start:
                ll -= 0.5 * (math.log(2 * math.pi * s) + innovation**2 / s)
        out[i] = x[0], x[1], innovation, s, p[0, 0]
    return out, ll


KALMAN_GRID = [(v, r) for v in (1e-4, 1e-3, 1e-2, 1e-1) for r in (0.25, 0.5, 1.0, 2.0, 4.0)]


def fit_kalman(df: DataFrame, x: str = "log_close") -> DataFrame:
    """The grid point of largest innovation likelihood of each instrument: a task for each (instrument, point)."""
    points = F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.lit(r).alias("m"), F.lit(k).alias("k")) for k,
        (v, r) in enumerate(KALMAN_GRID)]))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(TIME)["x"].to_numpy(float)
        base = max(float(np.nanvar(np.diff(y))), 1e-12)
        v, m, k = float(pdf["v"].iloc[0]), float(pdf["m"].iloc[0]), int(pdf["k"].iloc[0])
        return pd.DataFrame([(pdf[KEY].iloc[0], base, base * v, base * m, kalman(y, base, base * v, base * m)[1], k)],
            columns=["instrument", "q_level", "q_velocity", "r", "ll", "k"])

    grid = df.select(KEY, TIME, F.col(x).alias("x"), points.alias("g")).select(KEY, TIME, "x", "g.*")
    scored = grid.groupBy(KEY, "k").applyInPandas(run, "instrument string, q_level double, q_velocity double, r double, ll double, k int")
    return scored.groupBy(KEY).agg(F.max_by(F.struct("q_level", "q_velocity", "r", "ll"),
        F.struct("ll", -F.col("k"))).alias("b")).select(KEY, "b.*")


KALMAN_FEATURES = ("price", "velocity", "acceleration", "innovation", "innovation_z", "state_uncertainty", "observed_minus_filtered")


def kalman_features(y: np.ndarray, sigma: np.ndarray, q_level: float, q_velocity: float, r: float, eps: float = 1e-12) -> dict[str,
    np.ndarray]:
    """The filter's level, velocity, acceleration, innovation and uncertainty in units of sigma (or of the innovation's own)."""
    level, velocity, innovation, s, p = kalman(y, q_level, q_velocity, r)[0].T
    unit = np.where(np.isfinite(sigma) & (sigma > 0), sigma, math.nan) + eps
    before = np.r_[math.nan, velocity[:-1]]
    values = ((level - y) / unit, velocity / unit, (velocity - before) / unit, innovation / unit, innovation / np.sqrt(np.maximum(s, eps)),
        np.sqrt(np.maximum(p, 0)) / unit, (y - level) / unit)
    return {f"kalman_{n}": v for n, v in zip(KALMAN_FEATURES, values, strict=True)}


def rts_smooth(y: np.ndarray, q_level: float, q_velocity: float, r: float) -> np.ndarray:
    """Backward-smoothed levels, for diagnostics only."""
    f, q = np.array([[1.0, 1.0], [0.0, 1.0]]), np.diag([q_level, q_velocity])
    x, p, xs, ps, xp, pp = np.array([y[0], 0.0]), np.diag([10 * r, r]), [], [], [], []
    for i, v in enumerate(y):
        a, b = (x, p) if i == 0 else (f @ x, f @ p @ f.T + q)
        xp.append(a), pp.append(b)
        x, p = a, b
        if math.isfinite(v):
            gain = b[:, 0] / (b[0, 0] + r)
            x, p = a + gain * (v - a[0]), b - np.outer(gain, b[0])
        xs.append(x), ps.append(p)
    out = [xs[-1]]
    for i in range(len(y) - 2, -1, -1):
        c = ps[i] @ f.T @ np.linalg.inv(pp[i + 1])
        out.append(xs[i] + c @ (out[-1] - xp[i + 1]))
    return np.array([o[0] for o in out[::-1]])


class GaussianHMM:
    """Diagonal Gaussian hidden Markov model: scaled EM, causal filter, smoother; states ordered by volatility."""

    def __init__(self, states: int = 3, iterations: int = 30, floor: float = 1e-6):
        self.k, self.iterations, self.floor = states, iterations, floor

    def _likelihood(self, z: np.ndarray) -> np.ndarray:
        ok = np.isfinite(z).all(axis=1)
        log = -0.5 * (((np.where(ok[:, None], z, 0)[:, None, :] - self.mean) ** 2) / self.var + np.log(2 * math.pi * self.var)).sum(axis=2)
        top = log.max(axis=1, keepdims=True)
        out = np.exp(log - top)
        self._shift = np.where(ok, top[:, 0], 0.0)
        out[~ok] = 1.0
        return out

    def _forward(self, like: np.ndarray, initial: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        alpha, scale = np.empty_like(like), np.empty(len(like))
        prior = initial
        for t in range(len(like)):
            a = prior * like[t]
            scale[t] = max(a.sum(), 1e-300)
            alpha[t] = a / scale[t]
            prior = alpha[t] @ self.trans
        return alpha, scale

    def _posterior(self, like):
        alpha, scale = self._forward(like, self.start)
        beta = np.ones_like(like)
        for t in range(len(like) - 2, -1, -1):
            beta[t] = self.trans @ (like[t + 1] * beta[t + 1]) / scale[t + 1]
        gamma = alpha * beta
        return alpha, beta, gamma / gamma.sum(axis=1, keepdims=True), scale

    def fit(self, x: np.ndarray, vol: int = 2, size: int = 1) -> GaussianHMM:
        ok = np.isfinite(x).all(axis=1)
        if ok.sum() < 10 * self.k:
            raise ValueError("too few complete rows")
        self.centre, self.scale = x[ok].mean(axis=0), np.maximum(x[ok].std(axis=0), 1e-9)
        z = (x - self.centre) / self.scale
        chunks = np.array_split(np.flatnonzero(ok)[np.argsort(z[ok][:, vol], kind="stable")], self.k)
        self.mean = np.array([z[c].mean(axis=0) for c in chunks])
        self.var = np.maximum(np.array([z[c].var(axis=0) for c in chunks]), self.floor)
        self.trans = np.full((self.k, self.k), 0.05 / max(self.k - 1, 1))
        np.fill_diagonal(self.trans, 0.95)
        self.start = np.full(self.k, 1 / self.k)
        last = -math.inf
        for _ in range(self.iterations):
            like = self._likelihood(z)
            alpha, beta, gamma, scale = self._posterior(like)
            ll = float(np.log(scale).sum() + self._shift.sum())
            xi = np.einsum("ti,ij,tj->ij", alpha[:-1], self.trans,
                like[1:] * beta[1:] / scale[1:, None]) if len(z) < 2 else (alpha[:-1].T @ (like[1:] * beta[1:] / scale[1:,
                None])) * self.trans
            self.trans = np.maximum(xi / xi.sum(axis=1, keepdims=True), self.floor)
            self.trans /= self.trans.sum(axis=1, keepdims=True)
            self.start = gamma[0]
            w = gamma[ok]
            total = np.maximum(w.sum(axis=0), 1e-12)[:, None]
            self.mean = w.T @ z[ok] / total
            self.var = np.maximum(w.T @ (z[ok] ** 2) / total - self.mean**2, self.floor)
            if ll - last < 1e-4 * max(1, abs(ll)):
                break
            last = ll
        order = np.argsort(self.mean[:, vol] + self.mean[:, size], kind="stable")
        self.mean, self.var, self.start, self.trans = self.mean[order], self.var[order], self.start[order], self.trans[np.ix_(order, order)]
        return self

    def filter(self, x: np.ndarray, initial: np.ndarray | None = None) -> np.ndarray:
        return self._forward(self._likelihood((x - self.centre) / self.scale), self.start if initial is None else initial)[0]

    def smooth(self, x: np.ndarray) -> np.ndarray:
        return self._posterior(self._likelihood((x - self.centre) / self.scale))[2]

    def meta(self, x: np.ndarray) -> list[dict]:
        state = self.filter(x).argmax(axis=1)
        return [{"state": k, "occupancy": float((state == k).mean()),
            "expected_duration": float(1 / max(1 - self.trans[k, k], 1e-9))} for k in range(self.k)]


# --- ledger
LEDGER = "instrument string, timestamp timestamp, units double, cash double, equity double, exposure double, drawdown double, realised double"


def ledger(fills: np.ndarray, prices: np.ndarray, capital: float = 100_000.0, commission: float = 0.0) -> dict[str, np.ndarray]:
    """Marks of a series: fills[t] units dealt at prices[t] (0: none). Average price is size-weighted on adds, the fill's on flips."""
    n = len(prices)
    out = {k: np.zeros(n) for k in ("units", "cash", "equity", "exposure", "drawdown", "realised")}
    units = average = realised = 0.0
    cash = peak = capital
    for t in range(n):
        f, px = fills[t], prices[t]
        if f:
            cash -= f * px + commission
            closed = min(abs(f), abs(units)) if units * f < 0 else 0.0
            realised += closed * (px - average) * np.sign(units)
            after = units + f
            if abs(after) < 1e-9:
                after, average = 0.0, 0.0
            elif units * f >= 0:
                average = (units * average + f * px) / after
            elif units * after < 0:
                average = px
            units = after
        value = cash + units * px
        peak = max(peak, value)
        for k, v in (("units", units), ("cash", cash), ("equity", value), ("exposure", units * px / value), ("drawdown", 1 - value / peak),
            ("realised", realised)):
            out[k][t] = v
    return out


def order_units(equity: float, price: float, current_units: float, target: float, min_notional: float = 100.0) -> float:
    """Units to deal for a target exposure; 0 below the smallest notional."""
    delta = equity * target / price - current_units
    return delta if abs(delta) * price >= min_notional else 0.0


# --- event bars
EVENT_BARS = "instrument string, start timestamp, open double, high double, low double, close double, volume double, dollar_volume double, deal_count long, bar_id string"


class BarBuilder:
    """Accumulate and reset: a bar ends with the event that reaches the target; what it overshoots isn't carried over."""

    def __init__(self, kind: str, target: float):
        self.kind, self.target, self.session, self.bar, self.n = kind, target, None, None, 0

    def push(self, t, price: float, size: float, session) -> list[tuple]:
        out = []
        if self.bar is not None and session != self.session:
            out.append(self.flush())
        self.session = session
        if self.bar is None:
            self.bar = [t, price, price, price, price, 0.0, 0.0, 0]
        b = self.bar
        b[2], b[3], b[4] = max(b[2], price), min(b[3], price), price
        b[5] += size
        b[6] += price * size
        b[7] += 1
        if {"volume": b[5], "dollar": b[6], "tick": b[7]}[self.kind] >= self.target:
            out.append(self._emit(""))
        return out

    def _emit(self, suffix: str) -> tuple:
        row, self.bar, self.n = (*self.bar, f"{self.kind}-{self.n}{suffix}"), None, self.n + 1
        return row

    def flush(self) -> tuple | None:
        return self._emit("-partial") if self.bar is not None else None


def bar_ends(amount: np.ndarray, target: float) -> np.ndarray:
    """Ends (exclusive) of the bars of a session: each runs until its amounts reach the target; the last one may be short."""
    out, at, size = [], 0, 64
    while at < len(amount):
        total = np.cumsum(amount[at : at + size])
        if total[-1] >= target:
            at += int(np.argmax(total >= target)) + 1
        elif at + size < len(amount):
            size *= 2
            continue
        else:
            at = len(amount)
        out.append(at)
    return np.array(out, int)


def event_bars(ticks: DataFrame, kind: str, target: float) -> DataFrame:
    """Volume, dollar or tick bars of events (price, size). No bar crosses a session (date), so each session of an instrument is
    cut by a task of its own; bars are numbered afterwards."""
    names = [f.split()[0] for f in EVENT_BARS.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([TIME, "sequence_id"])
        p, s = pdf["price"].to_numpy(float), pdf["size"].to_numpy(float)
        amount = {"volume": s, "dollar": p * s, "tick": np.ones(len(s))}[kind]
        ends = bar_ends(amount, target)
        starts = np.r_[0, ends[:-1]]
        add = lambda x: np.add.reduceat(x, starts)
        out = pd.DataFrame({"start": pdf[TIME].to_numpy()[starts], "open": p[starts], "high": np.maximum.reduceat(p, starts),
            "low": np.minimum.reduceat(p, starts), "close": p[ends - 1],
                            "volume": add(s), "dollar_volume": add(p * s), "deal_count": ends - starts, "bar_id": ""})
        if np.cumsum(amount[starts[-1] :])[-1] < target:
            out.loc[len(out) - 1, "bar_id"] = "-partial"
        return out.assign(**{KEY: pdf[KEY].iloc[0], "session": pdf["session"].iloc[0], "k": np.arange(len(out))})[[*names, "session", "k"]]

    cut = ticks.withColumn("session", F.to_date(TIME).cast("string")).groupBy(KEY, "session").applyInPandas(run,
        EVENT_BARS + ", session string, k long")
    n = F.row_number().over(Window.partitionBy(KEY).orderBy("session", "k")) - 1
    return cut.withColumn("bar_id", F.concat(F.lit(f"{kind}-"), n.cast("string"), "bar_id")).select(*names)


def parse_target(name: str) -> tuple[str, float]:
    """"dollar_250m" is ("dollar", 250e6); k, m and b multiply."""
    kind, _, amount = name.partition("_")
    scale = {"k": 1e3, "m": 1e6, "b": 1e9}.get(amount[-1:].lower(), 1.0) if kind != "time" else 1.0
    return kind, float(amount.rstrip("kmbKMB") if kind != "time" else amount) * scale
