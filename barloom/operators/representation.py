"""Which bars to trade on: in each window the representation whose own folds score best, windows being aligned by time.

Candidates have different bar clocks, so a window of the reference is told to the others as times: a row belongs to it by when its bar
began. Keys are <instrument>@<candidate>; every phase of a retrain then runs over all candidates at once. The choice sees the inner
folds of a window only, never the rows that it deals on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.operators import retraining as R
from barloom.operators import training as T
from barloom.sources.bars import KEY, TIME, stored

LEAST_OOS = 5
c = F.col


def keyed(rows: DataFrame, candidate: str) -> DataFrame:
    return rows.withColumn(KEY, F.concat(c(KEY), F.lit(f"@{candidate}")))


def owner():
    return F.substring_index(KEY, "@", 1)


def candidate():
    return F.substring_index(KEY, "@", -1)


#: when a bar began, in microseconds, while its place stands for its time
BEGAN = "began"


def in_place(bars: DataFrame) -> DataFrame:
    """bars with their place (_row) for their time, so that windows over bars that begin at once keep their order."""
    return bars.withColumn(BEGAN, F.unix_micros(TIME).cast("double")).withColumn(TIME, F.timestamp_micros("_row"))


def in_time(rows: DataFrame) -> DataFrame:
    return rows.withColumn(TIME, F.timestamp_micros(c(BEGAN).cast("long"))).drop(BEGAN) if BEGAN in rows.columns else rows


def aligned_windows(rows: DataFrame, reference: str, count: int = R.WINDOWS) -> DataFrame:
    """The windows of the reference, laid over the rows of each candidate by time: as many rows train as begin before the window,
    but no more than began before the first one."""
    ref = R.walk_windows(rows.where(candidate() == reference), count)
    at = rows.where(c("ok") & (candidate() == reference)).select(KEY, "row", TIME)
    start = at.select(KEY, c("row").alias("oos_start"), c(TIME).alias("from_time"))
    last = at.select(KEY, (c("row") + 1).alias("oos_end"), c(TIME).alias("to_time"))
    times = ref.join(start, [KEY, "oos_start"]).join(last, [KEY, "oos_end"]).select(owner().alias("base"), "window", "from_time", "to_time")
    met = rows.where("ok").select(KEY, TIME, owner().alias("base")).join(times, "base")
    edges = met.groupBy(KEY, "base", "window").agg(F.count_if(c(TIME) < c("from_time")).alias("oos_start"), F.count_if(c(TIME) <= c("to_time")).alias("oos_end"))
    block = F.first("oos_start").over(Window.partitionBy(KEY).orderBy("window"))
    out = edges.withColumns({"first": F.greatest(c("oos_start") - block, F.lit(0)), "last": F.greatest(c("oos_start") - T.PURGE, F.lit(0))})
    return out.where(c("oos_end") - c("oos_start") >= LEAST_OOS).select(KEY, "window", "first", "last", "oos_start", "oos_end")


def selected(picked: DataFrame, order: list[str]) -> DataFrame:
    """(base, window, candidate, score): the best mean score of the full inputs' choices; of equal ones the first of `order`."""
    place = F.array_position(F.array(*[F.lit(n) for n in order]), candidate())
    best = Window.partitionBy("base", "window").orderBy(c("mean_score").desc(), "place")
    rows = picked.where("inputs = 'full'").select(KEY, owner().alias("base"), "window", candidate().alias("candidate"), place.alias("place"), "mean_score")
    return rows.withColumn("_k", F.row_number().over(best)).where("_k = 1").select(KEY, "base", "window", "candidate", c("mean_score").alias("score"))


def selection_walk(rows: DataFrame, order: list[str], folder: str, grid: list[tuple[int, int]] = R.WALK_GRID, count: int = R.WINDOWS) -> dict[str, DataFrame]:
    """The tables of a walk over all candidates (the first of `order` is the reference), `selection`, and `results` of the account that
    trades each window on its chosen bars. rows: in time, or in_place."""
    placed = stored(in_time(R.positioned(rows)), folder, "rows")
    out = R.deal(R.retrained(placed, aligned_windows(placed, order[0], count), grid, folder), folder)
    out["selection"] = stored(selected(out["choices"], order), folder, "selection")
    trades = out["carried"].join(out["selection"].select(KEY, "base", "window"), R.AT)
    return out | {"results": stored(R.traded(trades, out["oos_forecasts"], placed, "base"), folder, "selected_results")}
