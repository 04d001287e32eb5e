"""Long series in parallel: overlapping chunks, so that one instrument isn't one task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.sources.bars import KEY, TIME, stored

#: rows of a chunk of a long series
CHUNK = 50_000


def numbered(df: DataFrame) -> DataFrame:
    """df with _row, the place of each row in its instrument's series, from 0, unless it has that. Rows are numbered day by day; only the
    days' counts, not the rows of an instrument, meet in one task. df is made once and stored, since the counts and the rows both come from it."""
    if "_row" in df.columns:
        return df
    dated = stored(df.withColumn("_day", F.to_date(TIME)), name="dated")
    before = F.sum("_n").over(Window.partitionBy(KEY).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1))
    days = dated.groupBy(F.col(KEY).alias("_i"), F.col("_day").alias("_d")).agg(F.count("*").alias("_n"))
    days = days.withColumnsRenamed({"_i": KEY, "_d": "_day"}).select(KEY, "_day", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(KEY, "_day").orderBy(TIME)) - 1
    return dated.join(days, [KEY, "_day"]).withColumn("_row", F.col("_before") + place).drop("_day", "_before")


def _spread(df: DataFrame, lookback: int, chunk: int) -> DataFrame:
    """Each row in the chunks that need it: its own (_own), and those whose first rows look back on it."""
    first, last = F.floor(F.col("_row") / chunk), F.floor((F.col("_row") + lookback) / chunk)
    return numbered(df).withColumn("_chunk", F.explode(F.sequence(first, last))).withColumn("_own", first == F.col("_chunk"))


def in_chunks(df: DataFrame, features: Callable[[DataFrame], DataFrame], lookback: int, chunk: int = CHUNK) -> DataFrame:
    """features(df), worked out over chunks of `chunk` rows of each instrument, each preceded by the `lookback` rows before it.

    For windows that look back on at most `lookback` rows in all the result is the same; running and recursive columns need the
    whole series and don't belong here. Rows of the overlap are replicated, lookback / chunk of all, and dropped at the end.
    """
    keyed = _spread(df, lookback, chunk).withColumn("_instrument", F.col(KEY)).withColumn(KEY,
        F.concat_ws("#", KEY, F.col("_chunk").cast("string")))
    out = features(keyed).where("_own")
    return out.withColumn(KEY, F.col("_instrument")).drop("_instrument", "_chunk", "_own", "_row")


def map_chunks(df: DataFrame, x: str, kernel: Callable[[np.ndarray], dict[str, np.ndarray]], names: list[str], lookback: int,
    chunk: int = CHUNK,
               keep: tuple[str, ...] = ()) -> DataFrame:
    """instrument, timestamp, x, the double columns keep, and the columns that kernel makes of x in time order, looking back on at most `lookback` rows; one
    Arrow pass over chunks. What isn't finite comes back as null."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_row")
        v, own = pdf["x"].to_numpy(float), pdf["_own"].to_numpy(bool)
        made = kernel(v)
        values = {n: np.where(np.isfinite(made[n]), made[n], np.nan)[own] for n in names}  # NaN arrives as null
        return pd.DataFrame({**{c: pdf[c].to_numpy()[own] for c in (KEY, TIME)}, x: v[own],
            **{c: pdf[c].to_numpy(float)[own] for c in keep}, **values})

    schema = f"{KEY} string, {TIME} timestamp, " + ", ".join(f"{n} double" for n in (x, *keep, *names))
    place = [n for n in ("_row",) if n in df.columns]
    return _spread(df.select(KEY, TIME, F.col(x).alias("x"), *keep, *place), lookback, chunk).groupBy(KEY, "_chunk").applyInPandas(run, schema)
