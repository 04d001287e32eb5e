"""Boosted regression trees on binned inputs, several models at once: what a task of a parameter grid fits."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Depth, rate, shares and penalties of the regression's defaults."""

    depth: int = 3
    rate: float = 0.03
    rows: float = 0.8
    columns: float = 0.8
    l1: float = 0.1
    l2: float = 1.0
    bins: int = 64
    seed: int = 42


def edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Inner edges of the bins of each column, at its quantiles."""
    return [np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1])) for col in x.T]


def binned(x: np.ndarray, at: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, col, "left") for e, col in zip(at, x.T, strict=True)])


def shrunk(total: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(total) * np.maximum(np.abs(total) - l1, 0.0)


def best_splits(total: np.ndarray, count: np.ndarray, allowed: np.ndarray, least: np.ndarray, p: Trees) -> tuple[np.ndarray, np.ndarray]:
    """(column, bin) of each (model, node): rows above the bin go right. total, count: (model, node, column, bin). The column is -1
    where no split gains anything or leaves `least` rows on both sides."""
    left, n_left = total.cumsum(axis=3), count.cumsum(axis=3)
    whole, n = left[..., -1:], n_left[..., -1:]
    gain = lambda g, k: shrunk(g, p.l1) ** 2 / (k + p.l2)
    value = gain(left, n_left) + gain(whole - left, n - n_left) - gain(whole, n)
    fits = (n_left >= least[:, None, None, None]) & (n - n_left >= least[:, None, None, None]) & allowed[:, None, :, None]
    value = np.where(fits, value, 0.0).reshape(*value.shape[:2], -1)
    best = value.argmax(axis=2)
    found = np.take_along_axis(value, best[..., None], 2)[..., 0] > 1e-12
    return np.where(found, best // total.shape[3], -1), best % total.shape[3]


def deeper(codes: np.ndarray, node: np.ndarray, column: np.ndarray, split: np.ndarray) -> np.ndarray:
    """The nodes one level down: 2 node, and one more for rows above the bin that their node is split at."""
    out = node + node
    for k in np.flatnonzero(column >= 0):
        out += (node == k) & (codes[column[k]] > split[k])
    return out


def boost(x: np.ndarray, y: np.ndarray, others: np.ndarray, models: list[tuple[list[int], int]], stops: list[int], p: Trees = Trees()) -> tuple[dict, dict, dict]:
    """Predictions of `others`, uses of each column and a digest of what was fitted, by (model, rounds) for each model and each of the stops.

    models: (columns that it may use, least rows on each side of a split). All share the bins and draw the same rows in a round, as
    fits one after the other with one seed would; and since rounds build on each other, a longer fit holds the shorter ones."""
    n, width = x.shape
    at = edges(x, p.bins)
    small = np.uint8 if p.bins < 256 and p.depth <= 8 else np.int64  # bins and nodes in a byte each
    codes = np.ascontiguousarray(np.vstack([binned(x, at), binned(others, at)]).T, small)
    size, wide = codes.shape[1], np.uint16 if small is np.uint8 else np.int64
    rng, count = np.random.default_rng(p.seed), len(models)
    own = np.zeros((count, width), bool)
    for k, (columns, _) in enumerate(models):
        own[k, columns] = True
    least, most = np.array([m[1] for m in models]), np.ceil(own.sum(axis=1) * p.columns)
    out, uses = np.full((count, size), y.mean()), np.zeros((count, width))
    predictions, importance, digests = {}, {}, {}
    #: the model that each has been equal to so far: one of the same columns
    twin = [next(k for k in range(count) if (own[k] == own[m]).all()) for m in range(count)]
    sums = [hashlib.sha256(repr((y.mean(), [e.tolist() for e in at], m)).encode()) for m in models]
    for done in range(1, max(stops) + 1):
        rows = np.flatnonzero(rng.random(n) < p.rows)
        order = np.where(own, rng.random(width), 2.0).argsort(axis=1).argsort(axis=1)
        allowed = own & (order < most[:, None])
        mine = codes.take(rows, axis=1)
        left = {m: (y - out[m, :n]).take(rows) for m in set(twin)}
        #: the splits of each model in this round: those of the same splits hold the same rows in their nodes
        path, node = [b""] * count, {b"": np.zeros(size, small)}
        for level in range(p.depth):
            nodes = 1 << level
            total, held = np.zeros((count, nodes, width, p.bins)), np.zeros((count, nodes, width, p.bins), np.int64)
            for splits, at_node in node.items():
                alike = [m for m in range(count) if twin[m] == m and path[m] == splits]
                first = at_node.take(rows).astype(wide) * wide(p.bins)
                for k in np.flatnonzero(allowed[alike].any(axis=0)):
                    key = (first + mine[k]).astype(np.intp)
                    drawn = np.bincount(key, minlength=nodes * p.bins).reshape(nodes, p.bins)
                    for m in alike:
                        if allowed[m, k]:
                            total[m, :, k], held[m, :, k] = np.bincount(key, left[m], nodes * p.bins).reshape(nodes, p.bins), drawn
            for m in range(count):
                total[m], held[m] = total[twin[m]], held[twin[m]]
            column, split = best_splits(total, held, allowed, least, p)
            np.add.at(uses, (np.broadcast_to(np.arange(count)[:, None], column.shape)[column >= 0], column[column >= 0]), 1)
            before, node = node, {}
            for m in range(count):
                done_by = np.stack([column[m], split[m]]).tobytes()
                sums[m].update(done_by)
                if path[m] + done_by not in node:
                    node[path[m] + done_by] = deeper(codes, before[path[m]], column[m], split[m])
                path[m] += done_by
                t = twin[m]
                if path[m] != path[t]:
                    left[m], out[m], twin[m] = left[t], out[t], m
        leaves = 1 << p.depth
        leaf = np.zeros((count, leaves))
        ends = {splits: at_node.take(rows).astype(np.intp) for splits, at_node in node.items()}
        for m in range(count):
            if twin[m] != m:
                leaf[m] = leaf[twin[m]]
                continue
            key = ends[path[m]]
            leaf[m] = p.rate * shrunk(np.bincount(key, left[m], leaves), p.l1) / (np.bincount(key, minlength=leaves) + p.l2)
            out[m] += leaf[m].take(node[path[m]])
        for m in range(count):
            sums[m].update(leaf[m].tobytes())
            if done in stops:
                predictions[m, done], importance[m, done], digests[m, done] = out[twin[m], n:].copy(), uses[m].copy(), sums[m].hexdigest()[:16]
    return predictions, importance, digests
