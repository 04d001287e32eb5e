"""The per-bar engine: one state machine for each instrument, the same in batch and in Structured Streaming.

Each bar first fills what the bar before ordered, at its open; then it is validated, marked, judged by the halts, and decides what
the next bar's open is to fill. A bar out of order or out of shape fills nothing and decides nothing. While too few bars have come
the state is INITIALIZING and nothing is ordered; while a halt is on it is HALTED and only what flattens is ordered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.operators.folds import SimParams, order_units, scenario, step_rules, targets
from barloom.sources.bars import KEY, TIME

INPUTS = ["open", "high", "low", "close", "er", "sigma", "sigma_ref", "cost", "stress_p", "relative_spread", "range_rel", "day"]
ROW = f"{KEY} string, {TIME} timestamp, status string, target double, approved double, reason string, ordered double, filled double, fill_price double, units double, cash double, equity double"
#: bars before the first decision, capital, commission on each side, a window of the drawdown halt in bars
WARM_UP, CAPITAL, COMMISSION, WINDOW = 200, 100_000.0, 1e-4, 250
LIVE = scenario(daily_loss=0.025, drawdown_halt=0.10)


@dataclass
class State:
    """What an instrument carries from bar to bar."""

    bars: int = 0
    last: float = -math.inf
    cash: float = CAPITAL
    units: float = 0.0
    pending: float = 0.0
    exposure: float = 0.0
    holding: int = 0
    entry_price: float = math.nan
    entry_sigma: float = 0.0
    peak: float = CAPITAL
    day: float = -1.0
    day_start: float = CAPITAL
    day_halt: float = -1.0
    window_halt: int = -1


STATE = ", ".join(f"{name} {'long' if kind == 'int' else 'double'}" for name, kind in State.__annotations__.items())


def in_shape(b: dict[str, float]) -> bool:
    prices = [b[k] for k in ("open", "high", "low", "close")]
    return all(math.isfinite(p) and p > 0 for p in prices) and b["high"] >= max(prices) and b["low"] <= min(prices)


def halted(s: State, value: float, p: SimParams) -> bool:
    """Whether a halt is on, once the bar's value is known: a day's for the rest of the day, a drawdown's until its window ends, and
    one for good while nothing is left."""
    if value <= 0:
        return True
    window = s.bars // WINDOW
    if s.window_halt not in (-1, window):
        s.window_halt, s.peak = -1, value
    s.peak = max(s.peak, value)
    if p.daily_loss is not None and s.day_start > 0 and value / s.day_start - 1 < -p.daily_loss:
        s.day_halt = s.day
    if p.drawdown_halt is not None and value / s.peak - 1 < -p.drawdown_halt:
        s.window_halt = window
    return s.day_halt == s.day or s.window_halt == window


def on_bar(s: State, at: float, b: dict[str, float], p: SimParams = LIVE) -> tuple:
    """status, target, approved, reason, ordered, filled, fill price, units, cash, equity of one bar; s moves on."""
    if at <= s.last or not in_shape(b):
        return "REJECTED", 0.0, s.exposure, "order" if at <= s.last else "shape", s.pending, 0.0, math.nan, s.units, s.cash, math.nan
    filled, price = s.pending, math.nan
    if filled:
        half = np.nan_to_num(b["relative_spread"]) / 2 + 0.05 * np.nan_to_num(b["range_rel"])
        price = float(b["open"] * (1 + np.sign(filled) * half))
        s.cash -= filled * price + abs(filled) * price * COMMISSION
        s.units += filled
    if b["day"] != s.day:
        s.day, s.day_start = b["day"], s.cash + s.units * b["open"]
    value = s.cash + s.units * b["close"]
    s.bars, s.last, s.pending = s.bars + 1, at, 0.0
    stop = halted(s, value, p)
    status = "INITIALIZING" if s.bars <= WARM_UP else "HALTED" if stop else "RUNNING"
    want, new, why = 0.0, 0.0, ""
    if status != "INITIALIZING":
        one = {k: np.array([b[k]], float) for k in ("er", "sigma", "sigma_ref", "cost", "stress_p")} | {"adverse": np.zeros(1),
            "uncertainty": np.zeros(1)}
        want = float(targets(one, p)[0])
        s.holding += s.exposure != 0
        side = np.sign(s.exposure)
        stopped = bool(side) and side * (math.log(b["close"]) - math.log(s.entry_price)) < -p.stop_multiple * s.entry_sigma * math.sqrt(p.horizon)
        new, entry, why = step_rules(want, s.exposure, s.holding, stopped, p)
        if stop:
            new, entry, why = 0.0, False, "halt" if s.exposure else ""
        if new and (entry or not s.exposure):
            s.holding, s.entry_price, s.entry_sigma = 0, b["close"], b["sigma"] if math.isfinite(b["sigma"]) else 0.0
        changed = new != s.exposure or entry
        s.exposure, s.holding = new, s.holding if new else 0
        if changed:
            s.pending = order_units(value, b["close"], s.units, new) if new else -s.units
    return status, want, new, why, s.pending, filled, price, s.units, s.cash, value


def _rows(key: str, pdf: pd.DataFrame, s: State) -> pd.DataFrame:
    pdf = pdf.sort_values(TIME, kind="stable")
    seconds = pdf[TIME].astype("datetime64[us]").astype("int64").to_numpy() / 1e6
    columns = {c: pdf[c].to_numpy(float) for c in INPUTS}
    out = [(key, t, *on_bar(s, at, {c: v[k] for c, v in columns.items()})) for k,
        (t, at) in enumerate(zip(pdf[TIME], seconds, strict=True))]
    return pd.DataFrame(out, columns=[f.split()[0] for f in ROW.split(", ")])


def run_engine(bars: DataFrame) -> DataFrame:
    """ROW for each bar (KEY, TIME, INPUTS), one ordered pass for each instrument."""
    return bars.select(KEY, TIME, *INPUTS).groupBy(KEY).applyInPandas(lambda pdf: _rows(pdf[KEY].iloc[0], pdf, State()), ROW)


def stream_engine(bars: DataFrame, delay: str = "1 day") -> DataFrame:
    """The same over a stream of bars: the state of an instrument is a few numbers, kept in the state store."""
    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = State(*state.get) if state.exists else State()
        out = _rows(key[0], pd.concat(list(frames)), s)
        state.update(astuple(s))
        yield out

    return bars.withWatermark(TIME, delay).groupBy(KEY).applyInPandasWithState(step, ROW, STATE, "append", GroupStateTimeout.NoTimeout)
