"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is cut into words at places that no piece of the model spans. The words of a batch that aren't known yet lie one after
the other in flat numpy arrays of symbols. In each round every word finds the smallest rank among its pairs (segmented minimum),
merges all leftmost, non-overlapping pairs of that rank at once, and the arrays are compacted, until no word has a pair left.
The library merges one pair at a time; where a merge could make a pair that it would take before the others of the round, the
word merges its leftmost pair only. Ids of known words are kept in a bounded table for each Python worker.

Defined cases: null text counts as empty, and has the end id only. Characters outside the model become byte pieces. U+2581 in a
text is a space to the model, and decodes as one. Texts of any length are encoded whole. Repeated rows give repeated results.
"""

from __future__ import annotations

import codecs
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.batches import claim, map_texts, slices
from barloom.llm.common import table

SPACE = "▁"
NONE = np.int32(2**31 - 1)
#: words kept by a Python worker; then it starts anew
WORDS = 400_000
#: a run of spaces longer than this many of the longest piece of spaces is cut into such pieces and a rest
RUNS = 3

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class PieceModel:
    """The tables of a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.eos = sp.eos_id()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        normal = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        of_byte = {i: b for b, i in enumerate(self.byte_ids)}
        self.surface = [bytes([of_byte[i]]) if i in of_byte else p.replace(SPACE, " ").encode() if normal[i] else b"" for i, p in enumerate(pieces)]
        self.starts_word = [normal[i] and p.startswith(SPACE) for i, p in enumerate(pieces)]
        # symbols: pieces by id, then characters that only occur inside pieces
        self.symbol = {p: i for i, p in enumerate(pieces) if normal[i]}
        self.n_pieces, self.extra = n, []
        for p in list(self.symbol):
            for c in p:
                if c not in self.symbol:
                    self.symbol[c] = n + len(self.extra)
                    self.extra.append(c)
        scores = sorted({sp.get_score(i) for i in range(n) if normal[i]}, reverse=True)
        place = {s: k for k, s in enumerate(scores)}
        left, right, merged, rank = [], [], [], []
        for i, p in enumerate(pieces):
            if normal[i]:
                for k in range(1, len(p)):
                    if (a := self.symbol.get(p[:k])) is not None and (b := self.symbol.get(p[k:])) is not None:
                        left.append(a), right.append(b), merged.append(i), rank.append(place[sp.get_score(i)])
        self.width = n + len(self.extra) + 1
        key = np.array(left, np.int64) * self.width + np.array(right, np.int64)
        order = np.argsort(key)
        self.key, self.merged, self.rank = key[order], np.array(merged, np.int32)[order], np.array(rank, np.int32)[order]
        # words end before a space and, if no piece holds both, where ASCII without letters meets other characters
        plain = r"\x00-\x40\x5B-\x60\x7B-\x7F"
        bodies = [p.lstrip(SPACE) for p, ok in zip(pieces, normal, strict=True) if ok]
        mixed = any(re.search(f"[{plain}]", p) and re.search(f"[^{plain}]", p) for p in bodies)
        s = SPACE
        if any(SPACE in p for p in bodies):
            pattern = r"[\s\S]+"
        elif mixed:
            pattern = rf"{s}*[^{s}]+|{s}+"
        else:
            pattern = rf"{s}*[^{plain}{s}]+|{s}*[{plain}]+|{s}+"
        self.words = re.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.run = self._longest_run([p for p, ok in zip(pieces, normal, strict=True) if ok and not p.strip(s)])

    def _longest_run(self, runs: list[str]) -> int:
        """Length of the longest piece of spaces, where long runs begin with that piece and go on like shorter ones; else 0."""
        n = max(map(len, runs), default=0)
        if not n:
            return 0
        long = self.merge_words([SPACE * (RUNS * n + k) for k in range(n)])
        short = self.merge_words([SPACE * ((RUNS - 1) * n + k) for k in range(n)])
        whole = self.symbol[SPACE * n]
        return n if all(a.tolist() == [whole, *b.tolist()] for a, b in zip(long, short, strict=True)) else 0

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of symbol pairs; NONE where there is no such piece."""
        key = a.astype(np.int64) * self.width + b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        found = (self.key[at] == key) & (a >= 0) & (b >= 0)
        return np.where(found, self.rank[at], NONE), np.where(found, self.merged[at], -1)

    def merge_words(self, words: list[str]) -> list[np.ndarray]:
        """Final symbols of each word; characters without a symbol are -1 - code point."""
        symbol = self.symbol
        flat = np.array([symbol.get(c, -1 - ord(c)) for w in words for c in w], np.int32)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(words)

        def ranks(sym, word):
            r, m = np.full(len(sym), NONE, np.int32), np.full(len(sym), -1, np.int32)
            inside = np.flatnonzero(word[1:] == word[:-1])
            r[inside], m[inside] = self.pairs(sym[inside], sym[inside + 1])
            return r, m

        sym = flat
        rank, merged = ranks(sym, word)
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(sym)])
            done = least == NONE
            if done.any():
                for s, n in zip(starts[done].tolist(), sizes[done].tolist(), strict=True):
                    out[word[s]] = sym[s : s + n]
                stay = np.repeat(~done, sizes)
                sym, word, rank, merged = sym[stay], word[stay], rank[stay], merged[stay]
                least, sizes = least[~done], sizes[~done]
                if not len(sym):
                    break
            of = np.repeat(np.arange(len(least)), sizes)
            at = np.flatnonzero(rank == least[of])
            # leftmost and non-overlapping: every other place of a run of neighbouring places
            fresh = np.r_[True, np.diff(at) != 1]
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            at = self._sure(at, of, sym, word, merged, least)
            sym[at] = merged[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            touched = np.zeros(len(sym), bool)
            touched[at] = True
            sym, word, rank, merged, touched = sym[keep], word[keep], rank[keep], merged[keep], touched[keep]
            again = np.flatnonzero(touched | np.r_[touched[1:], False])
            inside = np.zeros(len(again), bool)
            more = again < len(sym) - 1
            inside[more] = word[again[more]] == word[again[more] + 1]
            rank[again[~inside]], merged[again[~inside]] = NONE, -1
            rank[again[inside]], merged[again[inside]] = self.pairs(sym[again[inside]], sym[again[inside] + 1])
        return out

    def _sure(self, at, of, sym, word, merged, least):
        """The places of a round; for words where one of several merges makes a pair of no larger rank, the first only."""
        own = of[at]
        several = np.r_[own[1:] == own[:-1], False] | np.r_[False, own[1:] == own[:-1]]
        if not several.any():
            return at
        new, n = merged[at], len(sym)
        after = np.minimum(at + 2, n - 1)
        right, _ = self.pairs(new, sym[after])
        right = np.where((at + 2 < n) & (word[after] == word[at]), right, NONE)
        before = np.maximum(at - 1, 0)
        joined = np.r_[False, at[1:] - at[:-1] == 2]
        left_symbol = np.where(joined, np.r_[new[:1], new[:-1]], sym[before])
        left, _ = self.pairs(left_symbol, new)
        left = np.where((at >= 1) & (word[before] == word[at]), left, NONE)
        risky = np.zeros(len(least), bool)
        risky[own[several & (np.minimum(left, right) <= least[own])]] = True
        is_first = np.r_[True, own[1:] != own[:-1]]
        return at[~risky[own] | is_first]

    def _ids(self, symbols: np.ndarray) -> list[int]:
        out = []
        for s in symbols.tolist():
            if 0 <= s < self.n_pieces:
                out.append(s)
            else:
                out += [self.byte_ids[b] for b in (chr(-1 - s) if s < 0 else self.extra[s - self.n_pieces]).encode("utf-8", "surrogatepass")]
        return out

    def learn(self, words: list[str]) -> None:
        """Puts words into the table."""
        if len(self.known) + len(words) > WORDS:
            self.known.clear()
        for a, b in slices(words, 500_000):
            part = words[a:b]
            for w, symbols in zip(part, self.merge_words(part), strict=True):
                self.known[w] = np.array(self._ids(symbols), "<i4").tobytes()

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        words = self.words.findall(SPACE + text.replace(" ", SPACE))
        if not self.run or SPACE * (RUNS * self.run) not in text.replace(" ", SPACE):
            return words
        out = []
        for w in words:
            run = len(w) - len(w.lstrip(SPACE))
            blocks = max(0, run - (RUNS - 1) * self.run - 1) // self.run
            out += [SPACE * self.run] * blocks + [w[self.run * blocks :]]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian int32, the end id last."""
        end = np.array([self.eos], "<i4").tobytes()
        out = []
        for a, b in slices(texts):
            cut = [self.split(t) for t in texts[a:b]]
            known = self.known
            if missing := list({w for words in cut for w in words if w not in known}):
                if len(known) + len(missing) > WORDS:
                    known.clear()
                    missing = list({w for words in cut for w in words})
                self.learn(missing)
            out += [b"".join(map(self.known.__getitem__, words)) + end for words in cut]
        return out

    def decode(self, ids: list[int]) -> str:
        surface = self.surface
        text = b"".join([surface[i] for i in ids]).decode("utf-8", "each_byte")
        first = next((i for i in ids if surface[i]), None)
        return text[1:] if first is not None and self.starts_word[first] else text


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode_decode(docs: DataFrame, path: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns keep, ids (array of int, end id last) and decoded (what the ids decode to)."""
    def make():
        m = model(path)
        claim(m.known)

        def work(texts):
            raw = m.encode([t or "" for t in texts])
            flat = np.frombuffer(b"".join(raw), "<i4")
            offsets = np.r_[0, np.cumsum([len(r) // 4 for r in raw])].astype(np.int32)
            decoded = [m.decode(np.frombuffer(r, "<i4").tolist()) for r in raw]
            return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), decoded]

        return work

    return map_texts(docs, keep, text_col, [("ids", "array<int>"), ("decoded", "string")], make)


def op6_sentencepiece(spark, sf_dir, path: str | None = None):
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    out = encode_decode(table(spark, sf_dir, "documents"), path, ["doc_id"])
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
