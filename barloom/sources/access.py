"""The access log of a locked holdout."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession


def open_holdout(spark: SparkSession, log: str, who: str, why: str) -> DataFrame:
    """Appends a row to the access log and returns all of it. Nothing is ever taken out."""
    if not why.strip():
        raise ValueError("opening the holdout needs a reason")
    spark.createDataFrame([(dt.datetime.now(dt.UTC).replace(tzinfo=None), who, why)],
        "at timestamp, who string, why string").write.mode("append").parquet(log)
    return spark.read.parquet(log)
