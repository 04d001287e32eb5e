"""Digests of stored tables that don't depend on the order of their rows, and comparisons of runs by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col


def digest(df: DataFrame, by: str | None = None) -> DataFrame:
    """(part, rows, total, mixed): the number of rows of each part, and the sum and the exclusive or of their hashes. Rows are added
    up where they are read; nothing but a row for each part is shuffled. by: the column whose values are the parts."""
    one, two = F.xxhash64(*[c(f"`{n}`") for n in df.columns]), F.xxhash64(F.lit("second"), *[c(f"`{n}`") for n in df.columns])
    part = c(f"`{by}`").cast("string") if by else F.lit("all")
    return df.select(part.alias("part"), one.alias("_1"), two.alias("_2")).groupBy("part").agg(F.count("*").alias("rows"), F.sum(c("_1").cast("decimal(20, 0)")).alias("total"), F.bit_xor("_2").alias("mixed"))


def run_digest(tables: dict[str, DataFrame], by: str = "instrument") -> DataFrame:
    """(table, part, rows, total, mixed) of a run's tables; tables without the column `by` are one part each."""
    out = None
    for name, df in sorted(tables.items()):
        one = digest(df, by if by in df.columns else None).select(F.lit(name).alias("table"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """(table, part, rows, other_rows, same) of the run digests a and b."""
    other = b.select("table", "part", c("rows").alias("other_rows"), c("total").alias("_t"), c("mixed").alias("_m"))
    both = a.join(other, ["table", "part"], "full")
    same = c("rows").eqNullSafe(c("other_rows")) & c("total").eqNullSafe(c("_t")) & c("mixed").eqNullSafe(c("_m"))
    return both.select("table", "part", "rows", "other_rows", same.alias("same"))


def verdict(compared: DataFrame) -> DataFrame:
    """One row: whether all parts are the same, how many differ, and the first of those by name."""
    first = F.min(F.when(~c("same"), F.struct("table", "part")))
    return compared.agg(F.coalesce(F.every("same"), F.lit(True)).alias("identical"), F.count_if(~c("same")).alias("differing"), first.alias("_f")).select("identical", "differing", c("_f.table").alias("first_table"), c("_f.part").alias("first_part"))


def stored_run(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(path) for name, path in paths.items()}
