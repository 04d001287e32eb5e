"""Arrow plumbing for operators that work on text in Python: bounded slices of one text column, results as columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: characters of text handled at once; one longer text is a slice of its own
SLICE = 4_000_000
#: bits of the filter of ids that is sent to every executor (4 MB)
FILTER_BITS = 25
#: rows of an Arrow batch, so that a batch of very long texts stays small
ROWS = 500


#: rows of an Arrow batch between the JVM and Python, where the session allows more: batches of texts are held on both sides
BATCH = 1000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows of an Arrow batch to BATCH."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH:
        spark.conf.set(key, str(BATCH))


_TABLES: list[dict] = []


def claim(words: dict | None = None) -> None:
    """Called where a task begins: of the tables of known words in this Python worker only the task's own stays. Workers live on
    from stage to stage, and the tables of one stage would else stay in memory through all later ones."""
    for other in _TABLES:
        if other is not words:
            other.clear()
    _TABLES[:] = [] if words is None else [words]


def alone(work: Callable) -> Callable:
    """make() for map_texts of an operator without a table of known words: those of others are cleared."""
    def make():
        claim()
        return work

    return make


def slices(texts: list[str], most: int = SLICE) -> Iterator[tuple[int, int]]:
    """[start, end) of runs of texts of at most `most` characters, or of one text."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def map_texts(df: DataFrame, keep: list[str], text_col: str, fields: list[tuple[str, str]],
              make: Callable[[], Callable[[list[str | None]], list]]) -> DataFrame:
    """Columns `keep` of df, and `fields` (name, type) computed from text_col. make() runs once for each task and returns what
    turns a list of texts into the list of the fields' columns. One Arrow pass, no shuffle."""
    small_batches(df.sparkSession)
    kept = [f for f in df.select(*[F.col(f"`{c}`") for c in keep]).schema.fields]
    new = T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in fields))
    names = [f"_k{i}" for i in range(len(keep))]
    inner = T.StructType([T.StructField(n, f.dataType, True) for n, f in zip(names, kept, strict=True)] + [T.StructField(f"_n{i}", f.dataType, True) for i, f in enumerate(new.fields)])
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in new.fields]
    count = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                columns = work(part.column(count).to_pylist())
                arrays = [part.column(i) for i in range(count)] + [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=inner.names)

    picked = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.col(f"`{text_col}`").alias("_text"))
    out = picked.mapInArrow(run, inner)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], *[F.col(f"_n{i}").alias(n) for i, (n, _) in enumerate(fields)])


def filter_bits(id_col: Column) -> list[Column]:
    """The two bits of a long id."""
    return [F.shiftrightunsigned(F.xxhash64(F.lit(k), id_col.try_cast("long")), 64 - FILTER_BITS) for k in (0, 1)]


def id_filter(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of the long ids in column id, as 64-bit words; at most 2^(FILTER_BITS - 6) rows reach the driver."""
    bits = ids.select(F.explode(F.array(*filter_bits(F.col("id")))).alias("b")).select(F.shiftright("b", 6).alias("at"), F.expr("shiftleft(1L, cast(b & 63 as int))").alias("w"))
    rows = bits.groupBy("at").agg(F.bit_or("w").alias("w")).toArrow().to_pandas()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[rows["at"].to_numpy()] = rows["w"].to_numpy()
    return out.view(np.uint64)


def lets_through(words: np.ndarray, *bits: np.ndarray) -> np.ndarray:
    """Which ids may be in the filter, by their bits."""
    ok = np.ones(len(bits[0]), bool)
    for b in bits:
        ok &= (words[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1) == 1
    return ok


def mark_among(rows: DataFrame, ids: DataFrame, id_col: Column) -> DataFrame:
    """rows with _may: whether id_col may be one of the ids (column id): surely true for those, and for a few others. Rows that it is
    false for need no join, so their other columns needn't be shuffled. What is broadcast are at most 2^(FILTER_BITS - 6) words."""
    bit = lambda c: filter_bits(c)[0]
    words = ids.select(bit(F.col("id")).alias("b")).groupBy(F.shiftright("b", 6).alias("_at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("_w"))
    marked = rows.withColumn("_b", bit(id_col)).join(F.broadcast(words), F.shiftright("_b", 6) == F.col("_at"), "left")
    return marked.withColumn("_may", F.coalesce(F.expr("(_w & shiftleft(1L, cast(_b & 63 as int))) != 0"), F.lit(False))).drop("_b", "_at", "_w")
