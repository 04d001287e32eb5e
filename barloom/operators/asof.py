"""Backward as-of join without a range join: both sides in one sorted pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof_join(targets: DataFrame, sources: DataFrame, on: list[str], value_cols: list[str], time: str = "timestamp",
    tolerance_seconds: float | None = None) -> DataFrame:
    """targets with, of each key, the latest source row not after its time, and age_s.

    Both sides are unioned and the last source is carried forward: one shuffle by key, one sort, no pairs. Of sources at the same
    time the last by their values wins. Older than the tolerance counts as missing.
    """
    s = sources.select(*on, F.col(time).alias(time), F.struct(F.col(time).alias("_t"), *value_cols).alias("_s"), F.lit(0).alias("_side"))
    t = targets.select(*on, F.col(time), F.struct(*[F.col(c) for c in targets.columns]).alias("_row"), F.lit(1).alias("_side"))
    both = s.unionByName(t, allowMissingColumns=True)
    w = Window.partitionBy(*on).orderBy(F.col(time), F.col("_side"), F.col("_s")).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_last", F.last("_s", True).over(w)).where("_side = 1")
    age = (F.unix_micros("_row." + time) - F.unix_micros("_last._t")) / 1e6
    keep = age.isNotNull() if tolerance_seconds is None else age <= tolerance_seconds
    return out.select("_row.*", *[F.when(keep, F.col(f"_last.{c}")).alias(c) for c in value_cols], F.when(keep, age).alias("age_s"))
