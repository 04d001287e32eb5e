"""Bounded-space online best-fit packing of tokenised documents.

Each task reads its documents in order, tokenises them and packs their pieces online: a fixed number of bins is open, kept in a
bitset keyed by free space; a piece goes to the fullest open bin that it fits in; if it fits in none and all bins are open, the
fullest closes first. Bins that are open when a task ends are then packed among themselves, by the same rule with a fixed number
of open bins and from the largest, in groups of tasks, so that few of them stay half empty. No text is shuffled, and a lost task repeats the same bins.

Defined cases: null text counts as empty, whose document is the end id alone. A document longer than a sequence is cut into
whole sequences and a rest; no other is cut. Repeated rows are packed once each. Order of equal pieces is the order of reading.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.batches import ROWS, claim, slices, small_batches
from barloom.llm.common import cut, table

CAPACITY = 2048
OPEN_BINS = 256
#: tasks whose open bins are packed together; they are all that can be open then, TASKS * OPEN_BINS
TASKS = 16
WORDS = 400_000


class WordTokenizer:
    """Ids of whole texts by a `tokenizers` file that drops white space and lower-cases, with known words kept in a table.

    Texts of ASCII and Latin-1 letters are split here as the file's own pattern does, and each word is encoded by the library
    once; other texts, and texts with a special token's string, are split at white space only and the parts encoded whole.
    """

    SPACE = r"\t-\r "
    LATIN = "a-zß-öø-ÿ"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = re.compile("[\x00-\x7fÀ-ÖØ-öø-ÿ]*").fullmatch
        self.words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{self.LATIN}]+|[0-9]|[^{self.SPACE}{self.LATIN}0-9]+").findall
        self.parts = re.compile(r"[^\t\n\r ]+").findall
        self.known: dict[str, bytes] = {}
        ends = [i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_word[ends] = True

    def learn(self, words: list[str]) -> None:
        """Puts words into the table: many as one text, cut after the ids that end a word, where that gives one for each word."""
        for k in range(0, len(words), 1000):
            part = words[k : k + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(part) and all(self.plain(w) and "<|" not in w for w in part):
                own = [x.tobytes() for x in np.split(ids, ends[:-1])]
            else:
                own = [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            self.known.update(zip(part, own, strict=True))

    def split(self, text: str) -> list[str]:
        if self.plain(text) and "<|" not in text:
            return self.words(text.lower())
        return self.parts(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32."""
        out = []
        for a, b in slices(texts):
            cut_up = [self.split(t) for t in texts[a:b]]
            missing = list({w for words in cut_up for w in words if w not in self.known})
            if missing:
                if len(self.known) + len(missing) > WORDS:
                    self.known.clear()
                    missing = list({w for words in cut_up for w in words})
                self.learn(sorted(missing, key=str.isascii))
            out += [b"".join(map(self.known.__getitem__, words)) for words in cut_up]
        return out


_TOKENIZERS: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


class BestFit:
    """Open bins in a bitset keyed by free space. put() returns (bin, place in it)."""

    def __init__(self, capacity: int, open_bins: int, first: int = 0):
        self.capacity, self.most, self.next = capacity, open_bins, first
        self.bits, self.count = 0, 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            which = self._take(free)
        else:
            if self.count == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.count -= 1
            free, which = self.capacity, self.next
            self.next += 1
            self.count += 1
        left = free - length
        if left:
            self.bins[left].append(which)
            self.bits |= 1 << left
        else:
            self.count -= 1
        return which, self.capacity - free

    def _take(self, free: int) -> int:
        own = self.bins[free]
        which = own.pop()
        if not own:
            self.bits ^= 1 << free
        return which

    def open(self) -> list[tuple[int, int]]:
        """(bin, tokens in it) of the bins that are still open."""
        return [(b, self.capacity - free) for free, own in enumerate(self.bins) for b in own]


PIECES = "doc long, piece int, start long, length long, ids_crc32 long, bin long, at long, open_fill long"


def pack_partition(batches: Iterator[pa.RecordBatch], encode: Callable, task: int, capacity: int, open_bins: int, end_id: int) -> Iterator[pa.RecordBatch]:
    """Rows of PIECES of one task. Rows with a null piece tell the fill of a bin that the task left open."""
    end = np.array([end_id], "<u4").tobytes()
    fit = BestFit(capacity, open_bins, task << 32)
    names = [x.split()[0] for x in PIECES.split(", ")]
    kinds = [pa.int32() if n == "piece" else pa.int64() for n in names]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names=names)

    width = 4 * capacity
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            part = b.slice(at, ROWS)
            ids = part.column(0).to_pylist()
            rows = []
            for doc, raw in zip(ids, encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                raw += end
                for piece, k in enumerate(range(0, len(raw), width)):
                    own = raw[k : k + width]
                    which, place = fit.put(len(own) // 4)
                    rows.append((doc, piece, k // 4, len(own) // 4, zlib.crc32(own), which, place, None))
            yield batch(rows)
    yield batch([(None, None, None, None, None, which, None, fill) for which, fill in fit.open()])


def merge_open(pdf, capacity: int, most: int = TASKS * OPEN_BINS):
    """Where the open bins of some tasks go: from the largest, each to the fullest new bin that it fits in."""
    pdf = pdf.sort_values(["open_fill", "bin"], ascending=[False, True], kind="stable")
    fit = BestFit(capacity, most)
    put = [fit.put(int(n)) for n in pdf["open_fill"]]
    leader: dict[int, int] = {}
    for (which, _), old in zip(put, pdf["bin"], strict=True):
        leader.setdefault(which, int(old))
    return pdf[["bin"]].assign(into=[leader[w] for w, _ in put], shift=[p for _, p in put])


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, end_id: int = 0,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of docs' texts."""
    def run(batches):
        tokenizer = word_tokenizer(path)
        claim(tokenizer.known)
        yield from pack_partition(batches, tokenizer.encode, TaskContext.get().partitionId(), capacity, open_bins, end_id)

    small_batches(docs.sparkSession)
    rows = cut(docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, PIECES))
    left = rows.where(F.col("piece").isNull()).select("bin", "open_fill", F.shiftright("bin", 32 + TASKS.bit_length() - 1).alias("tasks"))
    moved = left.groupBy("tasks").applyInPandas(lambda pdf: merge_open(pdf, capacity, TASKS * open_bins), "bin long, into long, shift long")
    out = rows.where(F.col("piece").isNotNull()).join(moved, "bin", "left")
    return out.select(F.col("doc").alias(id_col), "piece", "start", "length", "ids_crc32", F.coalesce("into", "bin").alias("sequence_id"),
                      (F.col("at") + F.coalesce("shift", F.lit(0))).alias("offset"))


def op7_best_fit_packing(spark, sf_dir, path: str | None = None):
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return pack(table(spark, sf_dir, "documents"), path)
