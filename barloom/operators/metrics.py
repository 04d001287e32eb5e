"""Performance metrics of returns by key, as aggregates over windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or missing."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def compounded(x: str | Column) -> Column:
    return F.product(1 + (F.col(x) if isinstance(x, str) else x)) - 1


def with_equity(rows: DataFrame, key: list[str], pnl: str = "pnl", order: str = "timestamp") -> DataFrame:
    """equity, its running peak and drawdown, from compounded returns."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("equity", F.exp(F.sum(F.log1p(pnl)).over(w)))
    peak = F.greatest(F.max("equity").over(w), F.lit(1.0))
    return out.withColumn("drawdown", 1 - F.col("equity") / peak)


def performance(rows: DataFrame, key: list[str], per_year: float = 252.0, exposure: str = "q", cost: str | None = None) -> DataFrame:
    """Return, risk, tail and activity of pnl rows with equity, in one aggregation; expected shortfall needs a second."""
    down = F.sqrt(F.avg(F.pow(F.least("pnl", F.lit(0.0)), F.lit(2))))
    out = rows.groupBy(*key).agg(
        F.count("*").alias("n"), compounded("pnl").alias("total_return"), F.avg("pnl").alias("mean"), F.stddev_pop("pnl").alias("std"),
            down.alias("downside"),
        F.skewness("pnl").alias("skew"), F.kurtosis("pnl").alias("kurt"), F.percentile("pnl", F.lit(0.05)).alias("var_95"),
            F.min("pnl").alias("worst_bar"),
        F.max("drawdown").alias("max_drawdown"), F.avg(F.abs(exposure)).alias("mean_exposure"),
            F.avg((F.col(exposure) != 0).cast("double")).alias("time_invested"), F.count_if(F.col("pnl") > 0).alias("up_bars"))
    out = out.withColumns({"sharpe": ratio(F.col("mean"), F.col("std")) * per_year**0.5,
        "sortino": ratio(F.col("mean"), F.col("downside")) * per_year**0.5,
                           "cagr": F.pow(F.greatest(1 + F.col("total_return"), F.lit(1e-9)), per_year / F.col("n")) - 1})
    out = out.withColumn("calmar", ratio(F.col("cagr"), F.col("max_drawdown")))
    tail = rows.join(out.select(*key, "var_95"), key).where(F.col("pnl") <= F.col("var_95")).groupBy(*key).agg(F.avg("pnl").alias("es_95"))
    return out.join(tail, key, "left")


def drawdown_stats(rows: DataFrame, key: list[str], order: str = "timestamp") -> DataFrame:
    """Largest drawdown, longest run under water (gaps and islands), current drawdown, ulcer index of rows with drawdown."""
    w = Window.partitionBy(*key).orderBy(order)
    run = rows.withColumn("_island", F.sum((F.col("drawdown") <= 0).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    islands = run.where("drawdown > 0").groupBy(*key,
        "_island").agg(F.count("*").alias("_len")).groupBy(*key).agg(F.max("_len").alias("longest_underwater"))
    out = rows.groupBy(*key).agg(F.max("drawdown").alias("max_drawdown"), F.max_by("drawdown", order).alias("current_drawdown"),
        F.sqrt(F.avg(F.col("drawdown") * F.col("drawdown"))).alias("ulcer"))
    return out.join(islands, key, "left").withColumn("longest_underwater", F.coalesce("longest_underwater", F.lit(0)))


def distribution(rows: DataFrame, key: list[str], x: str) -> DataFrame:
    good = rows.where(F.col(x).isNotNull() & ~F.isnan(x))
    p = lambda q: F.percentile(x, F.lit(q))
    return good.groupBy(*key).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), p(0.5).alias("median"), F.stddev_pop(x).alias("std"),
        p(0.05).alias("p05"), p(0.25).alias("p25"),
                                  p(0.75).alias("p75"), p(0.95).alias("p95"), F.min(x).alias("lowest"), F.max(x).alias("highest"),
                                      F.avg((F.col(x) > 0).cast("double")).alias("positive"))


def safe_corr(a: str, b: str) -> Column:
    """Correlation over complete pairs, 0 for fewer than three or without variance."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    return F.when(F.count_if(both) < 3, 0.0).otherwise(ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def score(sharpe: Column, turnover_per_day: Column, max_drawdown: Column) -> Column:
    return sharpe - 0.25 * turnover_per_day - 0.25 * max_drawdown / 0.10
