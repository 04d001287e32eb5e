"""Forward labels, costs by row, chronological folds and walk-forward schedules."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions import scalars as S
from barloom.sources.bars import KEY, by_time


def labels(df: DataFrame, horizon: int = 4, offset: int = 0, price: str = "open") -> DataFrame:
    """Y_t = ln P(t + 1 + H) - ln P(t + 1), normalised by sigma sqrt(H); what a simulation of the row needs. Rows without a label stay, null.

    df has open, close, sigma_h, range_rel, and relative_spread."""
    lead = lambda c, k: F.lead(c, k).over(by_time())
    first = 1 + offset if price == "open" else offset
    y = F.log(lead(price, first + horizon)) - F.log(lead(price, first) if first else F.col(price))
    exec_range, exec_spread = lead("range_rel", 1), lead("relative_spread", 1)
    return df.withColumns({
        "y": y, "y_norm": y / (F.col("sigma_h") * horizon**0.5 + 1e-12), "open_next": lead("open", 1), "open_next2": lead("open", 2),
            "close_next": lead("close", 1),
        "cost_roundtrip": S.round_trip_cost(F.col("range_rel"), F.col("relative_spread")),
            "cost_side_exec": S.per_side_cost(exec_range, exec_spread),
        "r_fill": F.log(lead("close", 1)) - F.log(lead("open", 1))})


def valid_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def folds(n_rows: int, count: int = 5, first_train: float = 0.4, validation: float = 0.1, purge: int = 5,
    embargo: int = 5) -> list[tuple[int, int, int, int]]:
    """(fold, train_end, val_start, val_end), ends exclusive. Edges lie at shares of the rows; purge rows before an edge and
    embargo rows after it belong to neither side."""
    edges = [min(n_rows, math.floor(n_rows * (first_train + k * validation))) for k in range(count + 1)]
    out = [(k + 1, a - purge, a + embargo, b) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    if any(train < 1 or start >= stop for _, train, start, stop in out):
        raise ValueError(f"{n_rows} rows are too few for {count} folds")
    return out


def schedule(n_bars: int, train: int, oos: int, step: int | None = None, holdout_fraction: float = 0.0, expanding: bool = False,
    min_oos: int | None = None) -> list[tuple[int, int, int, int]]:
    """(window, train_start, train_end, oos_end) before the locked holdout, ends exclusive. The last window may be cut short, down
    to min_oos bars."""
    end = math.floor(n_bars * (1 - holdout_fraction))
    starts = range(train, end, step or oos)
    long_enough = [s for s in starts if min(s + oos, end) - s >= (max(1, oos // 2) if min_oos is None else min_oos)]
    return [(k, 0 if expanding else max(0, s - train), s, min(s + oos, end)) for k, s in enumerate(long_enough)]


def schedule_frame(spark: SparkSession, **kw) -> DataFrame:
    return spark.createDataFrame(schedule(**kw), "window int, train_start long, train_end long, oos_end long")


def assign_folds(df: DataFrame, layout: list[tuple[int, int, int, int]]) -> DataFrame:
    """A row for each row and fold in which it trains or validates: a range join with a table of a few folds."""
    table = df.sparkSession.createDataFrame(layout, "fold int, train_end long, val_start long, val_end long")
    rows = df.withColumn("row", (F.row_number().over(by_time()) - 1).cast("long"))
    part = F.when(F.col("row") < F.col("train_end"), "train").when((F.col("row") >= F.col("val_start")) & (F.col("row") < F.col("val_end")),
        "validation")
    return rows.join(F.broadcast(table),
        (F.col("row") < F.col("train_end")) | ((F.col("row") >= F.col("val_start")) & (F.col("row") < F.col("val_end")))).withColumn("part",
        part)


def assign_own_folds(df: DataFrame, count: int = 5, first_train: float = 0.4, validation: float = 0.1, purge: int = 5,
    embargo: int = 5) -> DataFrame:
    """As assign_folds, with the folds that folds() lays over each instrument's own number of rows."""
    rows = df.withColumns({"row": (F.row_number().over(by_time()) - 1).cast("long"), "_n": F.count("*").over(Window.partitionBy(KEY))})
    rows = rows.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(count))))
    edge = lambda k: F.least(F.col("_n"), F.floor(F.col("_n") * (first_train + k * F.lit(validation))))
    train_end, start, end = edge(F.col("fold") - 1) - purge, edge(F.col("fold") - 1) + embargo, edge(F.col("fold"))
    part = F.when(F.col("row") < train_end, "train").when((F.col("row") >= start) & (F.col("row") < end), "validation")
    return rows.withColumn("part", part).where("part is not null").drop("_n")
