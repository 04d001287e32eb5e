"""Immutable nested configuration with overrides and a digest; run manifests; published models."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from types import MappingProxyType
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def freeze(x: Any) -> Any:
    if isinstance(x, Mapping):
        return MappingProxyType({k: freeze(v) for k, v in x.items()})
    return tuple(freeze(v) for v in x) if isinstance(x, (list, tuple)) else x


def thaw(x: Any) -> Any:
    if isinstance(x, Mapping):
        return {k: thaw(v) for k, v in x.items()}
    return [thaw(v) for v in x] if isinstance(x, tuple) else x


def merged(base: Mapping, over: Mapping) -> dict:
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def scalar(text: str) -> Any:
    """Numbers before other JSON values; what is neither is text."""
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    try:
        return json.loads(text)
    except ValueError:
        return text


def overrides(items: list[str]) -> dict:
    """["a.b=1"] is {"a": {"b": 1}}."""
    out: dict = {}
    for item in items:
        path, _, value = item.partition("=")
        node = out
        *front, last = path.split(".")
        for k in front:
            node = node.setdefault(k, {})
        node[last] = scalar(value)
    return out


def load(path: str | None = None, over: Mapping | None = None, base: Mapping | None = None) -> Mapping:
    import yaml

    data = dict(base or {})
    if path:
        with open(path) as f:
            data = merged(data, yaml.safe_load(f) or {})
    return freeze(merged(data, over or {}))


def digest(x: Any) -> str:
    return hashlib.sha256(json.dumps(thaw(x), sort_keys=True, default=str).encode()).hexdigest()[:16]


def compare_runs(a: Mapping, b: Mapping) -> dict:
    """Which hashes of two runs differ, and whether they are the same run again."""
    keys = sorted({*a, *b})
    differs = [k for k in keys if a.get(k) != b.get(k)]
    return {"identical": not differs, "differs": differs}


class ModelRegistry:
    """Published models in an append-only table on shared storage; the current one is the last version. One writer at a time."""

    SCHEMA = "version long, model string, meta string"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        spark.createDataFrame([], self.SCHEMA).write.mode("append").parquet(root)

    def versions(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.root)

    def publish(self, model_id: str, meta: Mapping | None = None) -> int:
        version = self.versions().count() + 1
        self.spark.createDataFrame([(version, model_id, json.dumps(thaw(dict(meta or {})), default=str))],
            self.SCHEMA).coalesce(1).write.mode("append").parquet(self.root)
        return version

    def current(self) -> dict | None:
        row = self.versions().orderBy("version", ascending=False).first()
        return None if row is None else {"version": row["version"], "model": row["model"], **json.loads(row["meta"])}
