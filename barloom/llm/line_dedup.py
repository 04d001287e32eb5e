"""Corpus-wide line deduplication.

Lines are exploded with their position, normalised and hashed to 128 bits; distinct documents are counted per hash, and the
lines of a hash over the threshold go, except in its keeper: the document with the largest (or smallest) id that holds it. The
rest is joined by position.

Copies: a document that takes several lines and much of its text from one keeper is a copy of that document rather than a bearer
of boilerplate. Without its lines it would be a torso that no near-duplicate search finds any more. With ``whole_copies`` such a
document keeps all its lines and is left to that search, which can then remove it as a whole; lines are kept once among the others.

Defined cases: null or empty text is one empty line, never dropped. Lines whose key is shorter than ``min_chars`` stay. Rows
with a null id are not counted and keep all lines. Rows that repeat an id count as one document. Other columns pass through,
but for own ones named like the two counts, which these replace: give the counts other names where they are to stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.batches import mark_among
from barloom.llm.common import SPACES, ascii_lower, cut, held, table, whole


#: a copy has at least COPY_LINES different lines of one keeper that make up COPY_SHARE of its text, or any that make up COPY_ALL
COPY_LINES, COPY_SHARE, COPY_ALL = 3, 0.25, 0.95


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _lines(text: Column) -> Column:
    return F.split(whole(text), "\n", -1)


def postings(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, text hash, text size, position, length, key hash) of each line that can be dropped at all."""
    lines = docs.where(F.col(id_col).isNotNull() & (F.length(text_col) >= min_chars)).select(
        F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_t"), F.length(text_col).alias("_size"), F.posexplode(_lines(F.col(text_col))).alias("_pos", "_line")
    )
    keyed = lines.select("_id", "_t", "_size", "_pos", F.length("_line").alias("_len"), line_key(F.col("_line")).alias("_key")).where(F.length("_key") >= min_chars)
    return keyed.select("_id", "_t", "_size", "_pos", "_len", F.xxhash64("_key").alias("_k1"), F.xxhash64(F.lit("second"), "_key").alias("_k2"))


def frequent_lines(posts: DataFrame, min_docs: int, keep: str = "largest") -> DataFrame:
    """(key hash, id of the document that keeps it); distinct pairs are merged before the shuffle by key."""
    keeper = {"largest": F.max, "smallest": F.min}[keep]("_id")
    counted = posts.groupBy("_k1", "_k2").agg(F.count_distinct("_id").alias("_n"), keeper.alias("_keeper"))
    return counted.where(F.col("_n") >= min_docs).select("_k1", "_k2", "_keeper")


def _copies(lost: DataFrame) -> DataFrame:
    """(_id, _t) of documents that are copies of another. lost: the lines that others keep."""
    by_keeper = lost.groupBy("_id", "_t", "_keeper", "_size").agg(F.collect_set(F.struct("_pos", "_len", "_k1")).alias("_at"))
    share = F.aggregate("_at", F.lit(0), lambda a, x: a + x["_len"]) / F.col("_size")
    several = F.size(F.array_distinct("_at._k1")) >= COPY_LINES
    return by_keeper.where((share >= COPY_ALL) | (several & (share >= COPY_SHARE))).select("_id", "_t").distinct()


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text",
                n_lines: str = "n_lines", n_dropped: str = "n_dropped", keep: str = "largest", whole_copies: bool = False) -> DataFrame:
    """docs with text_col less its repeated lines, and two long columns added: lines before, lines dropped.

    Postings and frequent keys are cut to the shared folder: read from there, both sides of the join are plain exchanges, and adaptive
    execution can split a key that a third of all lines carry.
    """
    posts = postings(docs, id_col, text_col, min_chars)
    posts = cut(posts if whole_copies else posts.drop("_size", "_len"))  # texts are split and hashed once
    frequent = cut(frequent_lines(posts, min_docs, keep))
    carried = posts.join(frequent, ["_k1", "_k2"])
    if whole_copies:  # the others agree anew on who keeps a line, since a copy may go
        carried = cut(carried)
        others = cut(carried.join(cut(_copies(carried.where(F.col("_id") != F.col("_keeper")))), ["_id", "_t"], "left_anti").drop("_keeper"))
        carried = others.join(cut(frequent_lines(others, 1, keep)), ["_k1", "_k2"])
    gone = cut(carried.where(F.col("_id") != F.col("_keeper")).groupBy("_id", "_t").agg(F.collect_set("_pos").alias("_gone")))
    rows = mark_among(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_d")), gone.select(F.col("_id").alias("id")), F.col(f"_d.`{id_col}`"))
    lose = rows.where("_may").join(gone, (F.col(f"_d.`{id_col}`") == F.col("_id")) & (F.xxhash64(F.col(f"_d.`{text_col}`")) == F.col("_t")), "left")
    # texts that surely lose nothing aren't shuffled
    rows = lose.select("_d", "_gone").unionByName(rows.where("not _may").select("_d", F.lit(None).cast("array<int>").alias("_gone")))
    rows = rows.withColumn("_lines", held(_lines(F.col(f"_d.`{text_col}`"))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    text = F.when(F.col("_gone").isNull(), F.col(f"_d.`{text_col}`")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(F.col("_lines"), i)), "\n"))
    columns = [text.alias(c) if c == text_col else F.col(f"_d.`{c}`").alias(c) for c in docs.columns if c not in (n_lines, n_dropped)]
    return rows.select(*columns, F.size("_lines").cast("long").alias(n_lines),
                       F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias(n_dropped))


def op2_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(whole("text"), 256).alias("kept_sha256"))


OP2_SQL = """
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents),
keyed as (
  select doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines),
frequent as (
  select key, max(doc_id) as keeper from keyed where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
marked as (
  select k.doc_id, k.pos, k.line, f.key is not null and k.doc_id <> f.keeper as gone
  from keyed k left join frequent f on k.key = f.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""
