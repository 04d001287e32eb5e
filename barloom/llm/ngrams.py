"""Hashed character n-grams of many texts at once, as flat numpy arrays."""

from __future__ import annotations

import numpy as np

_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)
SPACE = 32


def flatten(texts: list[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each after one space and before `pad` spaces, and where each begins."""
    tail = " " * pad
    full = [f" {t}{tail}" for t in texts]
    points = np.frombuffer("".join(full).encode("utf-32-le", "surrogatepass"), "<u4")
    starts = np.cumsum([0] + [len(t) for t in full[:-1]])
    return points, starts


def gram_hashes(points: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket of the n-gram that begins at each of the first len(points) - n + 1 places."""
    size = len(points) - n + 1
    h = points[:size] * _ODD[0] + np.uint32(n)
    for k in range(1, n):
        h ^= h >> np.uint32(15)
        h *= _ODD[k]
        h += points[k : k + size]
    h ^= h >> np.uint32(13)
    h *= _ODD[4]
    return (h >> np.uint32(32 - bits)).astype(np.int32)
