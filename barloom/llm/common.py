"""Shared helpers: table access, lineage cuts, column expressions used by several operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where it is unset (tests, one machine) one of our own."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        path = spark.conf.get("barloom.checkpoint.dir", None)
        if not path:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            path = tempfile.mkdtemp(prefix="barloom-")
            spark.conf.set("barloom.checkpoint.dir", path)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(path)
    return path


#: tables that cut() wrote and nothing has dropped yet
WRITTEN: list[str] = []
_OWN: ContextVar[list[str] | None] = ContextVar("tables", default=None)


@contextmanager
def tables() -> Iterator[list[str]]:
    """The paths that are cut within the block by this thread: those of queries in other threads aren't among them."""
    own: list[str] = []
    outer = _OWN.set(own)
    try:
        yield own
    finally:
        _OWN.reset(outer)
        if (around := _OWN.get()) is not None:
            around += own


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df materialised in the shared folder and read back, and its path there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/barloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    WRITTEN.append(path)
    if (own := _OWN.get()) is not None:
        own.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and read it back: later stages don't recompute it and survive lost executors."""
    return written(df)[0]


def drop(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Deletes tables of cut(), all of this driver's if none are named: to be called once what was made of them is written."""
    for path in list(WRITTEN if paths is None else paths):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        if path in WRITTEN:
            WRITTEN.remove(path)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only. lower() does just that to text of single-byte characters, and faster."""
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def whole(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def held(col: Column) -> Column:
    """col, but never inlined into what is built on it. A filter above would else be pushed below its projection with the whole
    expression copied into each use, into lambdas too, where it is worked out again for each element. A partition's number is never below 0, which the optimiser doesn't know."""
    return F.when(F.spark_partition_id() >= 0, col)
