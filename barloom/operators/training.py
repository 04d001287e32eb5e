"""Training of one instrument inside a task: folds, orders, calibration, execution model, and the walk over its windows."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd

from barloom.operators import folds as FO
from barloom.operators import fractional as FR
from barloom.operators import labels as L
from barloom.operators import models as MO
from barloom.sources.bars import KEY, TIME

FAMILIES = {"PRICE": ["return_1", "return_4"], "VOLATILITY": ["vol_50", "volatility_state"], "FRACTIONAL": ["frac"]}
FULL = [n for names in FAMILIES.values() for n in names]
BASELINE = [n for f, names in FAMILIES.items() if f != "FRACTIONAL" for n in names]
EXEC = ["range_rel", "relative_spread"]
HORIZON, PURGE, INNER = 4, 5, 0.25
#: bars that a task needs
COLUMNS = list(dict.fromkeys([*FO.SIM_COLUMNS, *BASELINE, *EXEC, "y", "y_norm", "r_fill"]))


class Ridge:
    """Ridge on standardised inputs."""

    def __init__(self, x: np.ndarray, y: np.ndarray, alpha: float = 1.0):
        self.mean, self.scale, self.base = x.mean(axis=0), np.where(x.std(axis=0) > 1e-12, x.std(axis=0), 1.0), float(y.mean())
        z = (x - self.mean) / self.scale
        self.w = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - self.base))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.w + self.base


class Pair:
    """Forecast m, probability p of a rise (L2 logistic by Newton steps), and both combined: a is 0 where they disagree."""

    def __init__(self, x: np.ndarray, y_norm: np.ndarray):
        self.m = Ridge(x, y_norm)
        z = np.column_stack([np.ones(len(x)), (x - self.m.mean) / self.m.scale])
        self.w, up = np.zeros(z.shape[1]), (y_norm > 0).astype(float)
        penalty = np.diag([1e-9, *[2.0] * x.shape[1]])
        for _ in range(12):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            self.w += np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, z.T @ (up - p) - penalty @ self.w)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = self.m.predict(x)
        z = np.column_stack([np.ones(len(x)), (x - self.m.mean) / self.m.scale])
        p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
        return np.where(np.sign(m) == np.sign(p - 0.5), m * np.abs(2 * p - 1), 0.0), p


class Adverse:
    """Adverse selection: a quarter of the expected move less what the fill bar gave, winsorised, on execution inputs."""

    def __init__(self, s: Series, rows: np.ndarray, e: np.ndarray, p: np.ndarray, least: int = 50, floor: float = 0.0, z: float = 0.0):
        self.floor, self.z, self.model, self.residual, self.r2 = floor, z, None, 0.0, math.nan
        d, side = self._design(s, rows, e, p)
        y = np.abs(e) * s.of("sigma", rows) * math.sqrt(HORIZON) / HORIZON - side * s.of("r_fill", rows)
        ok = np.isfinite(d).all(axis=1) & np.isfinite(y) & (side != 0)
        self.n = int(ok.sum())
        if self.n >= least:
            y = np.clip(y[ok], y[ok].mean() - 4 * y[ok].std(), y[ok].mean() + 4 * y[ok].std())
            self.model = Ridge(d[ok], y)
            left = y - self.model.predict(d[ok])
            self.residual = float(left.std())
            self.r2 = float(1 - left @ left / max(float(((y - y.mean()) ** 2).sum()), 1e-12))

    @staticmethod
    def _design(s, rows, e, p):
        x, side = np.column_stack([s.of(c, rows) for c in EXEC]), np.sign(e)
        return np.column_stack([x, np.abs(e) * s.of("sigma", rows) * math.sqrt(HORIZON), np.abs(2 * p - 1), side, side[:, None] * x]), side

    def predict(self, s, rows, e, p) -> tuple[np.ndarray, np.ndarray]:
        """Adverse cost and its uncertainty; zeros where too few rows fitted."""
        if self.model is None:
            return np.zeros(len(rows)), np.zeros(len(rows))
        d, _ = self._design(s, rows, e, p)
        return np.maximum(self.model.predict(np.where(np.isfinite(d), d, self.model.mean)), self.floor), np.full(len(rows),
            self.z * self.residual)


class Series:
    """One instrument's bars in time order. Rows count those that have every input and label, whatever order is chosen."""

    def __init__(self, pdf: pd.DataFrame):
        pdf = pdf.sort_values(TIME)
        self.name, self.a = str(pdf[KEY].iloc[0]), {c: pdf[c].to_numpy(float) for c in COLUMNS}
        need = [*BASELINE, *EXEC, "y_norm", "sigma", "open_next2", "cost_side", "log_close"]
        ok = np.isfinite(np.column_stack([self.a[c] for c in need])).all(axis=1)
        ok[: FR.MAX_LAGS] = False
        self.bars = np.flatnonzero(ok)
        self.order, self.frac = lru_cache(None)(self._order), lru_cache(None)(lambda d: FR.np_transform(self.a["log_close"], d))

    def of(self, name: str, rows: np.ndarray) -> np.ndarray:
        return self.a[name][self.bars[rows]]

    def x(self, names: list[str], rows: np.ndarray, d: float) -> np.ndarray:
        return np.column_stack([self.frac(d)[self.bars[rows]] if n == "frac" else self.of(n, rows) for n in names])

    def label_end(self, row: int) -> int:
        """The newest bar in the label of a row."""
        return int(self.bars[row]) + 1 + HORIZON

    def _order(self, upto: int) -> float:
        """The smallest stationary order of the bars up to and with upto; without one, that of the smallest statistic."""
        x, seen = self.a["log_close"][: upto + 1], []
        for d in FR.CANDIDATES:
            f = FR.np_transform(x, d)
            f = f[np.isfinite(f)]
            if len(f) >= FR.LEAST and np.ptp(f) > 0:
                (stat, p), (_, q) = FR.adf(f), FR.kpss(f)
                if p < 0.05 and q > 0.05:
                    return float(d)
                seen.append((stat, d))
        return float(min(seen)[1]) if seen else 0.4

    def kalman(self, upto: int) -> tuple[float, float, float]:
        """Level and velocity noise and measurement noise of the largest likelihood up to a bar."""
        y = self.a["log_close"][: upto + 1]
        base = max(float(np.nanvar(np.diff(y))), 1e-12)
        v, r = max(FO.KALMAN_GRID, key=lambda g: FO.kalman(y, base, base * g[0], base * g[1])[1])
        return base, base * v, base * r

    def simulate(self, rows: np.ndarray, e: np.ndarray, adverse: np.ndarray, uncertainty: np.ndarray, **changes) -> np.ndarray:
        return self.simulated(rows, e, adverse, uncertainty, **changes)[0]

    def simulated(self, rows: np.ndarray, e: np.ndarray, adverse: np.ndarray, uncertainty: np.ndarray, **changes) -> tuple[np.ndarray, int]:
        """Results of the rows, and how many positions were closed."""
        a = {c: self.of(c, rows) for c in FO.SIM_COLUMNS} | {"er": e * self.of("sigma", rows) * math.sqrt(HORIZON), "adverse": adverse,
            "uncertainty": uncertainty}
        out, closed = FO.simulate(a, FO.scenario(**changes))
        return out["pnl"], len(closed)


def measure(pnl: np.ndarray, e: np.ndarray, y: np.ndarray) -> dict[str, float]:
    eq = np.cumprod(1 + pnl)
    active, won, lost = e != 0, pnl[pnl > 0].sum(), -pnl[pnl < 0].sum()
    moves = len(e) > 1 and e.std() > 0 and y.std() > 0
    return {
        "net": float(pnl.sum()),
        "sharpe": float(pnl.mean() / pnl.std() * math.sqrt(252)) if len(pnl) and pnl.std() > 0 else 0.0,
        "n": len(pnl),
        "total_return": float(eq[-1] - 1) if len(eq) else 0.0,
        "max_drawdown": float((1 - eq / np.maximum(np.maximum.accumulate(eq), 1)).max()) if len(eq) else 0.0,
        "corr": float(np.corrcoef(e, y)[0, 1]) if moves else 0.0,
        "accuracy": float((np.sign(e[active]) == np.sign(y[active])).mean()) if active.any() else 0.0,
        "profit_factor": float(won / lost) if lost > 0 else 0.0,
    }


def evaluate(s: Series, rows: np.ndarray, names: list[str]) -> tuple[list[dict], tuple]:
    """Folds of the rows: order and models from the training block, calibration and execution model only from forecasts made before
    the validation rows. Returns a record for each fold, and all calibration rows with their a and p. No folds if rows are too few."""
    if len(rows) < 200:
        return [], ()
    records, kept = [], []
    for fold, train_end, start, end in L.folds(len(rows)):
        train, val = rows[:train_end], rows[start:end]
        if not kept:  # the later part of the first training block, forecast from the earlier
            cut = int(len(train) * (1 - INNER))
            fit, held = train[: cut - PURGE], train[cut + PURGE :]
            d0 = s.order(s.label_end(fit[-1]))
            kept.append((held, *Pair(s.x(names, fit, d0), s.of("y_norm", fit)).predict(s.x(names, held, d0))))
        d = s.order(s.label_end(train[-1]))
        a, p = Pair(s.x(names, train, d), s.of("y_norm", train)).predict(s.x(names, val, d))
        cal, ca, cp = (np.concatenate(x) for x in zip(*kept, strict=True))
        g = MO.Calibrator().fit(ca, s.of("y_norm", cal))
        ex, e = Adverse(s, cal, g.predict(ca), cp), g.predict(a)
        adverse, uncertainty = ex.predict(s, val, e, p)
        records.append({"fold": fold, "d": d, "train_bars": s.label_end(train[-1]) + 1, "calibration_rows": len(cal), "exec_rows": ex.n,
            "residual_std": ex.residual, "r2": ex.r2,
                        "adverse": float(adverse.mean()), "uncertainty": float(uncertainty.mean())} | measure(s.simulate(val, e, adverse,
                            uncertainty), e, s.of("y", val)))
        kept.append((val, a, p))
    return records, tuple(np.concatenate(x) for x in zip(*kept, strict=True))


def accepted(full: list[dict], base: list[dict]) -> bool:
    """Acceptance of a candidate by its folds and those of the baseline."""
    if not full:
        return False
    mean = {k: float(np.mean([r[k] for r in full])) for k in ("accuracy", "corr", "profit_factor")}
    total = {"net": sum(r["net"] for r in full), "max_drawdown": max(r["max_drawdown"] for r in full)}
    return all(MO.accept(mean | total, sum(a["net"] > b["net"] for a, b in zip(full, base, strict=True))).values())


class Fitted:
    """A model of a window: everything from the training rows and their folds' forecasts."""

    def __init__(self, s: Series, window: int, rows: np.ndarray, names: list[str], kept: tuple):
        self.window, self.names, self.d = window, names, s.order(s.label_end(rows[-1]))
        self.pair = Pair(s.x(names, rows, self.d), s.of("y_norm", rows))
        cal, a, p = kept
        self.g = MO.Calibrator().fit(a, s.of("y_norm", cal))
        self.ex = Adverse(s, cal, self.g.predict(a), p)

    def forecast(self, s: Series, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, p = self.pair.predict(s.x(self.names, rows, self.d))
        e = self.g.predict(a)
        return e, *self.ex.predict(s, rows, e, p)


def retrain(s: Series) -> list[dict]:
    """A retrain on all rows: folds of the candidate and of the baseline, acceptance, and the model that it leaves."""
    rows = np.arange(len(s.bars))
    full, kept = evaluate(s, rows, FULL)
    if not full:
        return []
    base, _ = evaluate(s, rows, BASELINE)
    m = Fitted(s, 0, rows, FULL, kept)
    weights = [f"{x:.9g}" for x in (m.d, *m.pair.m.w, *m.pair.w, *m.g.x, *m.g.y)]
    return [{"folds": len(full), "mean_sharpe": float(np.mean([r["sharpe"] for r in full])), "wins": sum(a["net"] > b["net"] for a, b in zip(full, base, strict=True)), "accepted": accepted(full, base), "d": m.d,
             "train_end": s.label_end(rows[-1]), "calibration_rows": len(kept[0]), "residual_std": m.ex.residual, "model": MO.digest(weights)}]


def light_refits(s: Series, shift: int = 20) -> list[dict]:
    """One refit as it is, and with shuffled labels, shuffled inputs, or a target that lies some bars later."""
    if len(s.bars) < 200:
        return []
    y, cut = s.of("y_norm", np.arange(len(s.bars))), int(len(s.bars) * 0.6)
    later = np.r_[y[shift:], np.full(shift, np.nan)]
    later[cut - PURGE - shift : cut] = np.nan
    runs = {"plain": Light(s, FULL), "shuffled_labels": Light(s, FULL, y=_seed(s, 1).permutation(y[:cut])), "shuffled_features": Light(s, FULL, shuffle=_seed(s, 2)), "target_shift": Light(s, FULL, y=later)}
    return [{"variant": k, "d": m.d, **{n: v for n, v in m.deal(m.e).items() if n in ("net", "sharpe", "corr", "n")}} for k, m in runs.items()]


#: windows of a walk, and the share of the rows that trains the first
WINDOWS, FIRST = 21, 0.4


class Light:
    """One refit on the first 60 % of the rows, its last quarter held for the calibration; the rest is run."""

    def __init__(self, s: Series, names: list[str], y: np.ndarray | None = None, shuffle: np.random.Generator | None = None,
        step: float = 0.0):
        n, cut = len(s.bars), int(len(s.bars) * 0.6)
        inner = int(cut * (1 - INNER))
        fit, cal, self.rows = np.arange(inner - PURGE), np.arange(inner + PURGE, cut - PURGE), np.arange(cut, n)
        self.s, self.names, self.d = s, names, float(np.clip(round(s.order(s.label_end(fit[-1])) + step, 2), 0.05, 0.95))
        y, x = s.of("y_norm", np.arange(n)) if y is None else y, s.x(names, fit, self.d)
        fit_ok, cal_ok = np.isfinite(y[fit]), np.isfinite(y[cal])
        self.pair = Pair((shuffle.permutation(x) if shuffle else x)[fit_ok], y[fit][fit_ok])
        self.g = MO.Calibrator().fit(self.pair.predict(s.x(names, cal, self.d))[0][cal_ok], y[cal][cal_ok])
        self.x = s.x(names, self.rows, self.d)
        self.e = self.forecast(self.x)

    def forecast(self, x: np.ndarray) -> np.ndarray:
        return self.g.predict(self.pair.predict(x)[0])

    def deal(self, e: np.ndarray, **changes) -> dict[str, float]:
        zero = np.zeros(len(e))
        return measure(self.s.simulate(self.rows, e, zero, zero, **changes), e, self.s.of("y", self.rows))


def _seed(s: Series, *parts: int) -> np.random.Generator:
    return np.random.default_rng([*s.name.encode(), *parts])


def sanity(s: Series, shift: int = 20, draws: int = 20) -> list[dict]:
    """The refit as it is, on destroyed labels or inputs or a shifted target, and its forecasts permuted or at other costs."""
    if len(s.bars) < 200:
        return []
    full, y = Light(s, FULL), s.of("y_norm", np.arange(len(s.bars)))
    moved = np.r_[y[shift:], np.full(shift, np.nan)]
    moved[int(len(y) * 0.6) - PURGE - shift : int(len(y) * 0.6)] = np.nan  # no label from the rows that are run
    refits = {"shuffled_labels": Light(s, FULL, y=_seed(s, 1).permutation(y[: int(len(y) * 0.6)])),
        "shuffled_features": Light(s, FULL, shuffle=_seed(s, 2)), "target_shift": Light(s, FULL, y=moved)}
    runs = {"strategy": full.deal(full.e), "reversed": full.deal(-full.e), "zero_cost": full.deal(full.e, cost_scale=0.0),
        "double_cost": full.deal(full.e, cost_scale=2.0)}
    runs |= {k: m.deal(m.e) for k, m in refits.items()} | {f"random_{k}": full.deal(_seed(s, 3,
        k).permutation(full.e)) for k in range(draws)}
    return [{"scenario": k, **r} for k, r in runs.items()]


#: fixed value: the share of a Sharpe ratio that a collapse loses
COLLAPSE = 0.75


def around_order(s: Series, steps: tuple[int, ...] = (-2, -1, 0, 1, 2)) -> list[dict]:
    """Refits with the fractional order some steps of 0.05 beside the chosen one; collapsed: it loses
    COLLAPSE of the chosen one's Sharpe ratio and earns nothing."""
    if len(s.bars) < 200:
        return []
    runs = {k: (m := Light(s, FULL, step=0.05 * k)) and (m.d, m.deal(m.e)) for k in steps}
    return [{"step": k, "d": d, "net": r["net"], "sharpe": r["sharpe"], "corr": r["corr"],
        "collapsed": bool(runs[0][1]["sharpe"] > 0 and r["sharpe"] < (1 - COLLAPSE) * runs[0][1]["sharpe"] and r["total_return"] <= 0)} for k, (d, r) in runs.items()]


def ablation(s: Series) -> list[dict]:
    """Net results of refits with and without each optional family: base, base with it, full without it, full."""
    if len(s.bars) < 200:
        return []
    net = lambda families: (lambda m: m.deal(m.e)["net"])(Light(s,
        [n for f in FAMILIES if f in families for n in FAMILIES[f]]))
    base, full = net({"PRICE"}), net(set(FAMILIES))
    return [{"family": f, "baseline": base, "base_plus": net({"PRICE", f}), "full_minus": net(set(FAMILIES) - {f}),
        "full": full} for f in FAMILIES if f != "PRICE"]


def sabotage(s: Series, seeds: int = 3) -> list[dict]:
    """Net results when a family's inputs are shuffled, frozen, random, flipped, delayed or taken out after the fit."""
    if len(s.bars) < 200:
        return []
    m, out = Light(s, FULL), []
    for k, (family, names) in enumerate(FAMILIES.items()):
        at = [FULL.index(n) for n in names]
        sub = m.x[:, at]
        ways = {"flip": -sub, "freeze": np.repeat(sub.mean(axis=0, keepdims=True), len(sub), axis=0),
            "delay": np.vstack([sub[:1], sub[:-1]]), "delay2": np.vstack([sub[:2], sub[:-2]]), "remove": np.zeros_like(sub)}
        for i in range(seeds):
            g = _seed(s, 4, k, i)
            ways |= {f"shuffle_{i}": g.permutation(sub), f"random_{i}": g.standard_normal(sub.shape) * sub.std(axis=0) + sub.mean(axis=0)}
        for mode, v in ways.items():
            x = m.x.copy()
            x[:, at] = v
            out.append({"family": family, "mode": mode, "net": m.deal(m.forecast(x))["net"]})
    return out


def baselines(s: Series, draws: int = 20) -> list[dict]:
    """Net results over the rows that are run: the strategy, without fractional inputs, momentum, and the strategy's exposure permuted."""
    if len(s.bars) < 200:
        return []
    m, less = Light(s, FULL), Light(s, BASELINE)
    a = {c: s.of(c, m.rows) for c in FO.SIM_COLUMNS}
    move, cost = a["open_next2"] / a["open_next"] - 1, a["cost_side"]
    net = lambda q: float((q * move - np.abs(np.diff(q, prepend=0.0)) * cost).sum())
    held = FO.simulate(a | {"er": m.e * a["sigma"] * math.sqrt(HORIZON), "adverse": np.zeros(len(m.e)), "uncertainty": np.zeros(len(m.e))},
        FO.SimParams())[0]["exposure"]
    momentum = FO.momentum_exposure(s.a["log_close"], s.a["sigma"])[s.bars[m.rows]]
    runs = {"strategy": net(held), "no_fractional": less.deal(less.e)["net"],
        "momentum": net(momentum)} | {f"random_{k}": net(_seed(s, 5, k).permutation(held)) for k in range(draws)}
    return [{"scenario": k, "net": v} for k, v in runs.items()]


def task(kernel, schema: str):
    """For applyInPandas: kernel(series) -> records, with the instrument in front."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = Series(pdf)
        return pd.DataFrame([{KEY: s.name, **r} for r in kernel(s)], columns=names)

    return run


FOLDS = "instrument string, fold int, d double, train_bars long, calibration_rows long, exec_rows long, residual_std double, r2 double, adverse double, uncertainty double, net double, sharpe double, n long, total_return double, max_drawdown double, corr double, accuracy double, profit_factor double"
