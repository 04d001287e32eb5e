"""Phrase collocations: words that stand together far more often than their parts would by chance.

Two passes over the texts, then joins over what is frequent:

1. Each task counts the hashes of its n-grams (1 to ``longest`` words, per language) in a count-min sketch of saturating
   counters; the sketches are merged cell by cell. A cell never counts too little, so after the merge one bit a cell says all that
   matters: whether any n-gram in it can reach ``min_count``.
2. The bits go to every task. An n-gram whose cells all pass, and whose two parts of one word less do too, is a survivor; survivors
   are counted exactly, within a task by numbers that stand for their words and between tasks as strings. Nothing frequent is lost.
   What is frequent is cut to the shared folder, and candidates meet their parts and their extensions there in equi-joins.

The sketch has two rows of 2^25 cells, or 2^26 for much text; in proportion to the n-grams, not to the tasks, since what a task sends
is packed. It tells frequent n-grams apart while a cell holds fewer than ``min_count`` on average, which is up to about 3 GB of text for
a count of 100; a larger corpus wants a larger count. With too small a sketch more n-grams survive and are counted exactly, with the same
result. At most 16 MB of bits are broadcast; the driver sees nothing else.

Defined cases: a null text is empty; a null language is ``und``, which a language of that name joins. A text without words, and an
empty table, give nothing. Repeated rows count once each. Equal scores are ranked by count, then by phrase in byte order. A text
longer than a slice is read in parts that hand on their last words, so no n-gram is missed or counted twice. Other columns are not
read, so their names don't matter. Memory of a task: its sketch, one slice of text, and 400,000 words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.batches import claim
from barloom.llm.common import cut, table

MIN_COUNT, LONGEST, TOP, SHARE = 100, 5, 2000, 100
UNKNOWN = "und"
ROWS = 2
#: bytes of text handled at once, words that a task remembers, cells of one merged row
SLICE, WORDS, BLOCK = 4_000_000, 400_000, 1 << 17
#: bits of a cell's number: at least and at most
LEAST_BITS, MOST_BITS = 25, 26
#: counted phrases that a task holds before it adds equal ones up, and hands them on if that doesn't halve them
HELD = 600_000
#: bytes of text for each task at least: a task sends a sketch, and a row for each frequent phrase, whatever it has read
TASK_BYTES = 64_000_000
#: white space between words becomes a space, and what ends a piece a line end
TABLE = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\x09", b"\n" * 10 + b" ")
SKIP, PIECE, TEXT = b"", b"\n", b"\r"
ODD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]


def cells_for(n_bytes: int, min_count: int) -> int:
    """Bits of a cell's number: two cells for each min_count bytes of text, as a power of two between the bounds."""
    return min(max(LEAST_BITS, int(2 * n_bytes / max(min_count, 1)).bit_length()), MOST_BITS)


class Vocabulary(dict):
    """Numbers of words in the order of their appearance, and their hashes."""

    def __init__(self):
        super().__init__({SKIP: 0, PIECE: 1, TEXT: 2})
        self.hashes = [0, 0, 0]

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return number


class Slice:
    """The words of some texts: their numbers, the piece each stands in, and the language's place in `langs`. The first `carried`
    words were counted with the part before."""

    def __init__(self, words: Vocabulary, tokens: list[bytes], langs: list[str], lang_of_text: list[int], carried: int = 0):
        codes = np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens))
        marks, kept = (codes == 1) | (codes == 2), codes > 2
        self.ids, self.piece = codes[kept], np.cumsum(marks)[kept]
        self.lang = np.array(lang_of_text, np.int64)[np.cumsum(codes == 2)[kept]]
        self.langs, self.carried = langs, carried

    def hashes(self, words: Vocabulary, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, hash of the n-gram at each place, whether it lies in one piece) for n = 1, 2, ..."""
        own = np.array(words.hashes, np.uint64)[self.ids]
        h = mixed(own ^ np.array([xxhash.xxh64_intdigest(x) for x in self.langs] or [0], np.uint64)[self.lang])
        yield 1, h, np.ones(len(h), bool)
        for n in range(2, longest + 1):
            if len(self.ids) < n:
                return
            h = mixed(h[:-1] * ODD[0] + own[n - 1 :])
            yield n, h, self.piece[n - 1 :] == self.piece[: len(h)]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * ODD[1]
    return h ^ (h >> np.uint64(29))


def cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((h * ODD[row] if row else h) >> np.uint64(64 - bits)).astype(np.int64)


def slices(batches: Iterator[pa.RecordBatch], words: Vocabulary) -> Iterator[Slice]:
    """Texts (binary, language) in slices of about SLICE bytes; a longer text is cut behind a word, and each part but the first
    begins with the last words of the one before."""
    langs: dict[str, int] = {}
    held, of, size = [], [], 0

    def made():
        out = Slice(words, b" \r ".join(held).split(b" "), list(langs), of)
        held.clear()
        of.clear()
        return out

    def fresh():
        if len(words) > WORDS:
            words.clear()
            words.__init__()

    for b in batches:
        for raw, lang in zip(b.column(0), b.column(1), strict=True):
            raw, lang = raw.as_py() or b"", langs.setdefault(lang.as_py() or UNKNOWN, len(langs))
            if len(raw) <= SLICE:
                held.append(raw.lower().translate(TABLE).replace(b"\n", b" \n "))
                of.append(lang)
                size += len(raw)
                if size >= SLICE:
                    yield made()
                    size = 0
                    fresh()
                continue
            at, tail = 0, []
            while at < len(raw):
                end = at + SLICE
                while end < len(raw) and raw[end] not in b" \t\n\r":
                    end += 1
                tokens = [t for t in raw[at:end].lower().translate(TABLE).replace(b"\n", b" \n ").split(b" ") if t]
                yield Slice(words, tail + tokens, list(langs), [lang], len(tail))
                fresh()
                last = (tail + tokens)[-LONGEST_KEPT:]
                while PIECE in last:
                    last = last[last.index(PIECE) + 1 :]
                at, tail = end, last
    if held:
        yield made()


#: words that a part of a long text hands on: one less than the most words of any phrase
LONGEST_KEPT = 15


def sketch_task(bits: int, min_count: int, longest: int):
    """Batches -> (block, packed counters) of the task's sketch; counters stop at min_count."""
    kind = np.uint8 if min_count < 256 else np.uint32

    def run(batches):
        claim()
        words, counts = Vocabulary(), np.zeros((ROWS, 1 << bits), kind)
        for s in slices(batches, words):
            for n, h, whole in s.hashes(words, longest):
                whole[: max(0, s.carried - n + 1)] = False
                h = h[whole]
                for row in range(ROWS):
                    at = np.sort(cells(h, row, bits))
                    first = np.flatnonzero(np.diff(at, prepend=-1))
                    more = np.diff(first, append=len(at))
                    at = at[first]
                    counts[row, at] = np.minimum(counts[row, at] + more, min_count)
        for block, part in enumerate(counts.reshape(-1, min(BLOCK, 1 << bits))):
            if part.any():
                packed = pa.compress(part.tobytes(), "zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([packed], pa.binary())], names=["block", "counts"])

    return run


def merge_task(bits: int, min_count: int):
    """Sorted (block, packed counters) -> (block, bits of the cells that reach min_count): one block in memory at a time."""
    size, kind = min(BLOCK, 1 << bits), np.uint8 if min_count < 256 else np.uint32

    def out(block, total):
        packed = np.packbits(total >= min_count, bitorder="little").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([packed], pa.binary())], names=["block", "counts"])

    def run(batches):
        now, total = None, None
        for b in batches:
            for block, packed in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                part = np.frombuffer(pa.decompress(packed.as_py(), size * kind().nbytes, "zstd"), kind).astype(np.int64)
                if block == now:
                    total = np.minimum(total + part, min_count)
                    continue
                if now is not None:
                    yield out(now, total)
                now, total = block, part
        if now is not None:
            yield out(now, total)

    return run


def frequent_cells(texts: DataFrame, bits: int, min_count: int, longest: int) -> np.ndarray:
    """The merged sketch as bits, ROWS of 2^bits: 1 where a cell reaches min_count."""
    size = min(BLOCK, 1 << bits)
    parts = texts.mapInArrow(sketch_task(bits, min_count, longest), "block int, counts binary")
    dealt = parts.repartition("block").sortWithinPartitions("block")
    merged = dealt.mapInArrow(merge_task(bits, min_count), "block int, counts binary").toArrow()
    out = np.zeros((ROWS << bits) // 8, np.uint8)
    for block, packed in zip(merged["block"].to_pylist(), merged["counts"].to_pylist(), strict=True):
        out[block * size // 8 : (block + 1) * size // 8] = np.frombuffer(packed, np.uint8)
    return out.reshape(ROWS, -1)


def passes(sketch: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    ok = np.ones(len(h), bool)
    for row in range(ROWS):
        at = cells(h, row, bits)
        ok &= (sketch[row, at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return ok


COUNTS = "lang string, words int, phrase string, f long"


def count_task(sketch, bits: int, longest: int):
    """Batches -> COUNTS of the survivors in each slice, and (lang, 0, '', words of that language)."""
    names = [x.split()[0] for x in COUNTS.split(", ")]

    def batch(s, lang, n, phrases, f):
        langs = pa.array(s.langs, pa.string()).take(pa.array(lang))
        return pa.RecordBatch.from_arrays([langs, pa.array(np.full(len(f), n, np.int32)), phrases, pa.array(f, pa.int64())], names=names)

    def added(tables):
        sums = pa.concat_tables(tables).group_by(names[:3]).aggregate([("f", "sum")])
        return sums.rename_columns([n.replace("f_sum", "f") for n in sums.column_names]).select(names)

    def run(batches):
        """Equal phrases of the task's slices are added up before they leave it."""
        claim()
        held, size = [], 0
        for b in counted(batches):
            held.append(pa.Table.from_batches([b]))
            size += b.num_rows
            if size > HELD:
                held = [added(held)]
                size = held[0].num_rows
                if size > HELD // 2:
                    yield from held[0].to_batches(10_000)
                    held, size = [], 0
        if held:
            yield from added(held).to_batches(10_000)

    def counted(batches):
        words, merged = Vocabulary(), sketch.value
        for s in slices(batches, words):
            total = np.bincount(s.lang[s.carried :], minlength=len(s.langs))
            there = np.flatnonzero(total)
            yield batch(s, there, 0, pa.array([""] * len(there), pa.string()), total[there])
            known, size = pa.array(list(words), pa.binary()), len(words)
            alive, rank = None, s.lang
            for n, h, whole in s.hashes(words, longest):
                ok = whole if alive is None else whole & alive[:-1] & alive[1:]
                at = np.flatnonzero(ok)
                at = at[passes(merged, h[at], bits)]
                if not len(at):
                    break
                alive = np.zeros(len(h), bool)
                alive[at] = True
                # exact: the part of one word less by its number, and the last word
                _, first, number = np.unique(rank[at] * size + s.ids[at + n - 1], return_index=True, return_inverse=True)
                rank = np.zeros(len(h), np.int64)
                rank[at] = number
                f = np.bincount(number[at + n > s.carried], minlength=len(first))
                there = np.flatnonzero(f)
                where = at[first[there]]
                parts = [known.take(pa.array(s.ids[where + k])) for k in range(n)]
                phrases = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary())) if n > 1 else parts[0]
                yield batch(s, s.lang[where], n, phrases.cast(pa.string()), f[there])

    return run


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, words, phrase, f) of all phrases of 1 to `longest` words with f >= min_count, exactly, and with 0 words each
    language's number of words. Cut to the shared folder."""
    if not 1 <= longest <= LONGEST_KEPT + 1 or min_count < 1:
        raise ValueError(f"phrases have 1 to {LONGEST_KEPT + 1} words, and a count of at least 1")
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{text_col}`").cast("binary").alias("t"), F.col(f"`{lang_col}`").cast("string").alias("l"))
    size = texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    bits = cells_for(size, min_count)
    texts = texts.coalesce(max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES)))  # no shuffle
    sketch = spark.sparkContext.broadcast(frequent_cells(texts, bits, min_count, longest))
    counted = texts.mapInArrow(count_task(sketch, bits, longest), COUNTS).groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))
    return cut(counted.where((F.col("words") == 0) | (F.col("f") >= min_count)))


def scored(frequent: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, words, phrase, a, l, r, n, score) of each phrase of two words or more, by its lowest-scoring cut."""
    c = F.col
    candidates = frequent.where("words >= 2").select("lang", "words", "phrase", c("f").alias("a"))
    own = F.split("phrase", " ")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), c("words") - 1)))
    side = lambda name, part: F.struct(F.lit(name).alias("side"), F.array_join(part, " ").alias("part"))
    parts = cuts.select("lang", "words", "phrase", "a", "k", F.explode(F.array(side("l", F.slice(own, 1, c("k"))), side("r", F.slice(own, c("k") + 1, c("words") - c("k"))))).alias("p"))
    known = frequent.where("words >= 1").select("lang", c("phrase").alias("part"), "f")
    met = parts.select("lang", "words", "phrase", "a", "k", "p.side", "p.part").join(known, ["lang", "part"])
    of = lambda k, s: F.max(F.when((c("k") == k) & (c("side") == s), c("f")))
    wide = met.groupBy("lang", "words", "phrase", "a").agg(*[of(k, s).alias(f"{s}{k}") for k in range(1, longest) for s in "lr"])
    wide = wide.join(frequent.where("words = 0").select("lang", c("f").alias("n")), "lang")
    big = lambda x: f"cast({x} as decimal(20, 0))"  # noqa: E731  products pass 64 bits
    score = lambda k: F.expr(f"(cast(1000 as decimal(4, 0)) * ({big('a')} * {big('n')})) div ({big(f'l{k}')} * {big(f'r{k}')})")
    lowest = F.array_min(F.filter(F.array(*[F.when(c("words") > k, F.struct(score(k).alias("score"), F.lit(k).alias("k"), c(f"l{k}").alias("l"), c(f"r{k}").alias("r"))) for k in range(1, longest)]), lambda x: x.isNotNull()))
    return wide.withColumn("_c", lowest).select("lang", "words", "phrase", "a", "_c.l", "_c.r", "n", "_c.score")


def standing_alone(rows: DataFrame, share: int = SHARE) -> DataFrame:
    """rows less those with a longer phrase around them that is at least `share` % as frequent. If any longer phrase is, one longer
    by a word is as well, since it lies within that and is no rarer."""
    own = F.split("phrase", " ")
    part = lambda at: F.array_join(F.slice(own, at, F.col("words") - 1), " ")
    longer = rows.where("words > 2").select("lang", F.explode(F.array(part(1), part(2))).alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    return rows.join(longer, ["lang", "phrase"], "left").where(F.col("_longer").isNull() | (100 * F.col("_longer") < share * F.col("a"))).drop("_longer")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP, share: int = SHARE,
                 text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases by score, then count, then phrase."""
    rows = standing_alone(cut(scored(frequent_phrases(docs, min_count, longest, text_col, lang_col), longest)), share)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


OP11_SQL = """
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece
  from documents),
w as (select lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') as ws from pieces),
grams as (
  select lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) as phrase
  from w, (values (1), (2), (3), (4), (5)) t(k) where len(ws) >= k),
totals as (select lang, count(*) as n from grams where k = 1 group by lang),
f as (select lang, k, phrase, count(*) as f from grams group by lang, k, phrase having count(*) >= 100),
cuts as (
  select c.lang, c.phrase, c.k, c.f as a, t.k as cut, string_split(c.phrase, ' ') as ws
  from f c, (values (1), (2), (3), (4)) t(k) where t.k < c.k),
met as (
  select c.lang, c.phrase, c.k, c.a, c.cut, x.f as l, y.f as r, n,
         cast((cast(1000 as hugeint) * a * n) // (cast(x.f as hugeint) * y.f) as bigint) as score
  from cuts c join f x on x.lang = c.lang and x.phrase = array_to_string(ws[1 : cut], ' ')
  join f y on y.lang = c.lang and y.phrase = array_to_string(ws[cut + 1 :], ' ') join totals t on t.lang = c.lang),
best as (select * from met qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
alone as (
  select * from best b where not exists (
    select 1 from f x where x.lang = b.lang and x.k > b.k and 100 * x.f >= 100 * b.a
      and contains(' ' || x.phrase || ' ', ' ' || b.phrase || ' ')))
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from alone qualify rank <= 2000
"""
