"""A training corpus from raw documents: language, repeated lines, near-duplicates, secrets, packed sequences.

Each stage takes all columns of its documents as one struct, so columns of any other name pass through it, those that an operator
uses itself (score, lang_pred, n_lines, component_id, ...) included. Defined cases, the same in every stage but the last:
null texts stay null where the document stays; an empty table gives an empty one; rows that repeat an id are one document, and
stay or go together, but for those that repeat its text as well, of which the near-duplicate stage keeps one; rows without an id are
documents of their own. ``n_chars`` changes with the text alone.

What one stage keeps another must not lose: a repeated line stays in the document with the smallest id that holds it, since
near-duplicates too leave the smallest id of a group; and copies of a whole document keep their lines, so that the
near-duplicate stage still finds them and removes all but one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.batches import mark_among
from barloom.llm.common import cut, drop, tables, written
from barloom.llm.language_id import UNKNOWN, fit, held_out, predict
from barloom.llm.line_dedup import dedup_lines
from barloom.llm.near_dedup import near_duplicates
from barloom.llm.packing import pack
from barloom.llm.secret_scan import redact

#: a text below this calibrated probability isn't clearly in any language
LANGUAGE_SCORE = 0.4


def whole_rows(docs: DataFrame) -> DataFrame:
    """_d: all columns of a document; doc_id, text, source: what operators read."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_d"), *[F.col(c) for c in ("doc_id", "text", "source")])


def with_text(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents with the text that an operator left beside them, and its length where it is another."""
    same = F.col("text").eqNullSafe(F.col("_d.text"))
    new = {"text": F.col("text"), "n_chars": F.when(same, F.col("_d.n_chars")).otherwise(F.length("text").cast("long")) if "n_chars" in columns else None}
    return rows.select(*[(new[c] if c in new else F.col(f"_d.`{c}`")).alias(c) for c in columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language stays unclear; the rest keeps all columns. Where no language can be
    learned, none is unclear: only documents without a letter go. A null text has no letter."""
    model = fit(docs.where(~held_out()))
    if not model.languages:
        return docs.where(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    judged = predict(whole_rows(docs), model, ["_d"])
    return judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LANGUAGE_SCORE)).select("_d.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts, but for their keepers and for copies of whole documents; every document stays."""
    return with_text(dedup_lines(whole_rows(docs), keep="smallest", whole_copies=True), docs.columns)


def once(docs: DataFrame) -> DataFrame:
    """docs with one of the rows that repeat both id and text. Only rows of ids that occur again are shuffled."""
    again = cut(docs.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).count().where("count > 1").select("id"))
    if again.isEmpty():
        return docs
    rows = mark_among(whole_rows(docs).select("_d", "doc_id", "text"), again, F.col("doc_id"))
    order = Window.partitionBy("doc_id", F.xxhash64("text"), F.xxhash64(F.lit("second"), "text")).orderBy("_n")
    often = rows.where("_may and doc_id is not null").withColumn("_n", F.length("text")).withColumn("_k", F.row_number().over(order)).where("_k = 1")
    return rows.where("not _may or doc_id is null").select("_d.*").unionByName(often.select("_d.*"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component of near-duplicates, once; texts without a word have none."""
    docs = once(docs)
    gone = cut(near_duplicates(docs.select("doc_id", "text")).where("not kept").select(F.col("doc_id").alias("id")).distinct())
    rows = mark_among(whole_rows(docs).select("_d", "doc_id"), gone, F.col("doc_id"))
    # texts of documents that surely stay aren't shuffled
    return rows.where("not _may").unionByName(rows.where("_may").join(gone, F.col("doc_id") == F.col("id"), "left_anti")).select("_d.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces live-looking secrets by a mark; every document stays."""
    return with_text(redact(whole_rows(docs)), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences. A null text is an empty one; repeated rows are packed once each."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("lines", lines), ("near", near), ("secrets", secrets), ("packing", packing)]

#: language, near-duplicates and packing aren't expressible
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, corpus: str | None = None) -> DataFrame:
    """The stages one after the other, each written to the shared folder; what a stage needed is dropped once the next one is written.

    corpus: a new folder for the cleaned documents that the pieces were made of. A piece is the ids [start, start + length) of its
    document's, so both together are what a training run reads."""
    docs, old = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        with tables() as own:
            docs, path = written(stage(spark, docs, sf_dir))
        drop(spark, old + [p for p in own if p != path])
        old = [path]
    if corpus:
        docs.write.parquet(corpus)
    return STAGES[-1][1](spark, docs, sf_dir)
