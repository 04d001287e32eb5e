"""Forecast models: boosted trees and logistic regression (pyspark.ml), isotonic calibration and ridge (numpy or aggregates)."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def direction(features: list[str], n_rows: int, c: float = 0.5) -> Pipeline:
    """P(y > 0): standardised inputs, L2 logistic; the penalty 1 / (c n) matches a loss that is summed."""
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="x0"),
        StandardScaler(inputCol="x0", outputCol="xs", withMean=True, withStd=True),
                            LogisticRegression(featuresCol="xs", labelCol="up", probabilityCol="prob", predictionCol="up_pred",
                                rawPredictionCol="raw", regParam=1 / (c * n_rows), elasticNetParam=0.0, standardization=False, maxIter=50)])


def probability() -> Column:
    return F.get(vector_to_array("prob"), 1)


def pav(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted isotonic levels by pooling neighbours that decrease."""
    blocks: list[list[float]] = []
    for v, k in zip(y, w, strict=True):
        blocks.append([v, k, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            v1, k1, n1 = blocks.pop()
            v0, k0, n0 = blocks.pop()
            blocks.append([(v0 * k0 + v1 * k1) / (k0 + k1), k0 + k1, n0 + n1])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks])


class Calibrator:
    """Isotonic or binned map from a combined forecast to an expected normalised return. 0 maps to 0."""

    def __init__(self, kind: str = "isotonic", bins: int = 20, least: int = 10):
        self.kind, self.bins, self.least = kind, bins, least
        self.x, self.y, self.slope = np.empty(0), np.empty(0), None

    def fit(self, a: np.ndarray, y: np.ndarray) -> Calibrator:
        ok = np.isfinite(a) & np.isfinite(y) & (a != 0)
        a, y = a[ok], y[ok]
        if len(a) < self.least or np.ptp(a) == 0:
            self.slope = float(a @ y / max(a @ a, 1e-12)) if len(a) else 0.0
            return self
        order = np.argsort(a, kind="stable")
        a, y = a[order], y[order]
        if self.kind == "binned":
            edges = np.unique(np.quantile(a, np.linspace(0, 1, self.bins + 1)))
            at = np.clip(np.searchsorted(edges, a, "right") - 1, 0, len(edges) - 2)
            n = np.bincount(at, minlength=len(edges) - 1)
            mean = np.bincount(at, y, len(edges) - 1) / np.maximum(n, 1)
            self.x, self.y = edges, pav(mean[n > 0], n[n > 0].astype(float))
            self._full = np.flatnonzero(n > 0)
        else:
            xs, first, n = np.unique(a, return_index=True, return_counts=True)
            self.x, self.y = xs, pav(np.add.reduceat(y, first) / n, n.astype(float))
        return self

    def predict(self, a: np.ndarray) -> np.ndarray:
        a = np.asarray(a, float)
        safe = np.where(np.isfinite(a), a, 0.0)
        if self.slope is not None:
            out = self.slope * safe
        elif self.kind == "binned":
            at = np.clip(np.searchsorted(self.x, safe, "right") - 1, 0, len(self.x) - 2)
            out = self.y[np.clip(np.searchsorted(self._full, at, "right") - 1, 0, len(self.y) - 1)]
        else:
            out = np.interp(safe, self.x, self.y)
        return np.where(safe == 0, 0.0, out)

    def curve(self, n: int = 50) -> list[tuple[float, float]]:
        grid = np.linspace(self.x[0], self.x[-1], n) if len(self.x) else np.linspace(-1, 1, n)
        return list(zip(grid.tolist(), self.predict(grid).tolist(), strict=True))


def ridge(rows: DataFrame, inputs: list[str], target: str, alpha: float = 1.0) -> dict[str, float]:
    """Ridge coefficients from Gram sums: one aggregation, a solve of as many equations as there are inputs on the driver."""
    ok = rows.dropna(subset=[*inputs, target])
    names = ["one", *inputs]
    col = {n: F.lit(1.0) if n == "one" else F.col(n) for n in names}
    sums = [F.sum(col[a] * col[b]).alias(f"{a}|{b}") for i,
        a in enumerate(names) for b in names[i:]] + [F.sum(col[a] * F.col(target)).alias(f"{a}|y") for a in names]
    got = ok.agg(*sums).first().asDict()
    k = len(names)
    g, b = np.zeros((k, k)), np.array([got[f"{a}|y"] or 0.0 for a in names])
    for i, a in enumerate(names):
        for j in range(i, k):
            g[i, j] = g[j, i] = got[f"{a}|{names[j]}"] or 0.0
    penalty = alpha * np.eye(k)
    penalty[0, 0] = 0.0
    return dict(zip(names, np.linalg.solve(g + penalty, b).tolist(), strict=True))


def linear(coefficients: dict[str, float]) -> Column:
    return sum((F.lit(v) * F.coalesce(F.col(n), F.lit(0.0)) for n, v in coefficients.items() if n != "one"),
        F.lit(coefficients.get("one", 0.0)))


def digest(values) -> str:
    return hashlib.sha256(repr(values).encode()).hexdigest()[:16]


def accept(metrics: dict, fold_wins: int, holdout_delta: float | None = None) -> dict[str, bool]:
    """Acceptance checks of a candidate model. The thresholds."""
    out = {"accuracy": metrics["accuracy"] > 0.51, "correlation": metrics["corr"] > 0, "net": metrics["net"] > 0,
        "profit_factor": metrics["profit_factor"] > 1.05,
           "drawdown": metrics["max_drawdown"] < 0.15, "beats_baseline": fold_wins >= 3}
    return out | ({"holdout": holdout_delta > 0} if holdout_delta is not None else {})
