"""Sharding by the longest processing time: what must stay together goes, the largest first, to the least-loaded shard.

Texts that are equal form a group and stay together. Sizes are added up for each group before the shuffle, so that a group of any
number of copies is one row. A heap then deals out items, from the largest: every group of at least 1 / ITEMS of all bytes is an
item of its own, and there are at most ITEMS of those; smaller groups are put together by their hash into ITEMS bundles, whose bytes
are near equal. So the heap and what is broadcast have at most 2 x ITEMS rows whatever the corpus, and no shard is further above the
least-loaded one than the last item that it took. Law: ``bytes``.

Slots number the rows of a shard without gaps: rows are dealt by shard and by a hash of the id into LANES lanes, numbered within each,
and lanes are laid one after the other; a shard is never sorted in one task.

Defined cases: a null text has 0 bytes and goes with the empty ones; each row counts one byte more. A group larger than a shard's
share stays whole, and that shard holds less besides. Repeated rows take a slot each. Rows of one lane are in order of their id, null
ids first; equal rows are interchangeable. Equal items are dealt in the order of their keys. An empty table gives no rows. The columns
returned are the id and those of the contract; others are not read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import cut, table, whole

SHARDS = 16
ITEMS = 1 << 16
LANES = 1 << 12
LAW = "bytes"


def deal(items: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """(size, key) of each item -> shard of each key: from the largest, each to the least-loaded shard, the first of equal ones."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for size, key in sorted(items, key=lambda x: (-x[0], x[1])):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        out[key] = shard
    return out


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, size, text_crc32, _k1, _k2): what is needed of a row; two 64-bit hashes and the size stand for the text."""
    text = whole(F.col(f"`{text_col}`").cast("string"))
    return docs.select(F.col(f"`{id_col}`").alias("_id"), (F.octet_length(text) + F.lit(1).cast("long")).alias("size"), F.crc32(text).alias("text_crc32"),
                       F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit("second"), text).alias("_k2"))


def bundle(items: int) -> Column:
    """The bundle of a small group, as a key that no group of its own has: those are hashes of three values."""
    return F.pmod("_k2", F.lit(items))


def shard(docs: DataFrame, shards: int = SHARDS, items: int = ITEMS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of each row."""
    spark = docs.sparkSession
    rows = cut(keyed(docs, id_col, text_col))  # the texts are read once
    groups = cut(rows.groupBy("_k1", "_k2", "size").agg((F.sum("size")).alias("_bytes")))
    total = groups.agg(F.sum("_bytes")).first()[0] or 0
    large = F.col("_bytes") * items >= total
    singles = groups.where(large).select("_k1", "_k2", "size", "_bytes").toArrow().to_pylist()  # at most `items`
    bundles = groups.where(~large).groupBy(bundle(items).alias("_b")).agg(F.sum("_bytes").alias("_bytes")).toArrow().to_pylist()
    singles.sort(key=lambda g: (g["_k1"], g["_k2"], g["size"]))
    bundles.sort(key=lambda g: g["_b"])
    where = deal([(g["_bytes"], k) for k, g in enumerate(singles)] + [(g["_bytes"], len(singles) + g["_b"]) for g in bundles], shards)
    own = spark.createDataFrame([(g["_k1"], g["_k2"], g["size"], where[k]) for k, g in enumerate(singles)], "_k1 long, _k2 long, size long, _own int")
    rest = spark.createDataFrame([(g["_b"], where[len(singles) + g["_b"]]) for g in bundles], "_b long, _rest int")
    placed = rows.join(F.broadcast(own), ["_k1", "_k2", "size"], "left").withColumn("_b", bundle(items)).join(F.broadcast(rest), "_b", "left")
    placed = placed.select("_id", "size", "text_crc32", F.coalesce("_own", "_rest").alias("shard"), F.pmod(F.xxhash64("_id"), F.lit(LANES)).cast("int").alias("_lane"))
    return numbered(placed).select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def numbered(placed: DataFrame) -> DataFrame:
    """placed (shard, _lane) with slot: lanes of a shard one after the other."""
    lanes = placed.groupBy("shard", "_lane").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_lane").rowsBetween(Window.unboundedPreceding, -1))
    starts = lanes.select("shard", "_lane", F.coalesce(before, F.lit(0)).alias("_start"))  # at most LANES rows a shard
    own = Window.partitionBy("shard", "_lane").orderBy("_id", "text_crc32", "size")
    return placed.withColumn("_at", F.row_number().over(own) - 1).join(F.broadcast(starts), ["shard", "_lane"]).withColumn("slot", F.col("_start") + F.col("_at"))


def op13_longest_first_sharding(spark, sf_dir):
    return shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
