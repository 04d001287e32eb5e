"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

N-grams of one to three characters are hashed; term frequencies are relative to the text's n-grams, document frequencies are
counted over all learnable rows. The weights are trained with follow-the-regularised-leader (proximal, per coordinate) under
elastic-net penalties on a bounded sample of learnable rows, and a temperature is fitted on rows of the sample kept back.
Prediction is one pass: a text's logits are means of table rows over all its n-grams. Texts over _CHARS characters are read in
pieces that overlap by the length of an n-gram, so memory doesn't grow with them beyond a copy of the text.

Bounds: SAMPLE rows train the classifier; every learnable row counts for document frequencies; every row is predicted.
Defined cases: null text, or text without a letter, is "und" with score 0; so is every text if nothing can be learnt. Ties go
to the language that sorts first. Repeated rows get equal results. Whole texts are read, whatever their length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.batches import alone, claim, map_texts, slices
from barloom.llm.common import table
from barloom.llm.ngrams import SPACE, flatten, gram_hashes

BITS = 15
ORDERS = (1, 2, 3)
SAMPLE = 3000
ALPHA, BETA, L1, L2, EPOCHS, SCALE = 0.5, 1.0, 0.1, 1e-4, 4, 30.0
UNKNOWN = "und"
_CHARS = 1_000_000

_LETTER = np.array([c if chr(c).isalpha() else SPACE for c in range(0x3000)], np.uint32)


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    points, starts = flatten([t.lower() for t in texts], max(ORDERS) - 1)
    return np.where(points < len(_LETTER), _LETTER[np.minimum(points, len(_LETTER) - 1)], points), starts


def _grams(points, starts):
    """For each order the bucket at each place; places whose n-gram reaches over a text's end are cut off by `inside`."""
    ends = np.r_[starts[1:], len(points)]
    inside = np.ones(len(points), bool)
    for k in range(1, max(ORDERS)):
        inside[ends - k] = False
    for n in ORDERS:
        h = np.zeros(len(points), np.int32)
        h[: len(points) - n + 1] = gram_hashes(points, n, BITS)
        yield (h + ORDERS.index(n) * (1 << BITS), inside)


WIDTH = len(ORDERS) << BITS


def long_grams(text: str):
    """For each piece of a text the buckets at its places, an array for each order: those that _grams gives for the whole text."""
    low, more = text.lower(), max(ORDERS) - 1
    for a in range(0, len(low) + 1, _CHARS):
        b = min(a + _CHARS, len(low) + 1)
        piece = (" " if a == 0 else "") + low[max(a - 1, 0) : b + more - 1]
        points = np.frombuffer((piece + " " * (b - a + more - len(piece))).encode("utf-32-le", "surrogatepass"), "<u4")
        points = np.where(points < len(_LETTER), _LETTER[np.minimum(points, len(_LETTER) - 1)], points)
        yield [gram_hashes(points, n, BITS)[: b - a] + k * (1 << BITS) for k, n in enumerate(ORDERS)]


def counts_of(texts: list[str | None]) -> list:
    """Buckets and counts of each text."""
    ids, counts = [], []
    for t in texts:
        if len(t or "") > _CHARS:
            total = sum(np.bincount(np.concatenate(hs), minlength=WIDTH) for hs in long_grams(t))
            i = np.flatnonzero(total)
            c = total[i]
        else:
            points, starts = _points([t or ""])
            i, c = np.unique(np.concatenate([h[inside] for h, inside in _grams(points, starts)]), return_counts=True)
        ids.append(i.astype(np.int32))
        counts.append(c.astype(np.int32))
    return [ids, counts]


def document_frequencies(learn: DataFrame, text_col: str) -> np.ndarray:
    """How many learnable texts hold each bucket: counted in each task, then summed by bucket."""
    def run(batches):
        claim()
        df = np.zeros(WIDTH, np.int64)
        for b in batches:
            texts = [t or "" for t in b.column(0).to_pylist()]
            for a, z in slices(texts, _CHARS):
                if len(texts[a]) > _CHARS:
                    seen = np.zeros(WIDTH, bool)
                    for hs in long_grams(texts[a]):
                        seen[np.concatenate(hs)] = True
                    df += seen
                    a += 1
                for lo in range(a, z, 200):
                    points, starts = _points(texts[lo : min(z, lo + 200)])
                    row = np.repeat(np.arange(len(starts), dtype=np.int64), np.diff(np.r_[starts, len(points)])) * WIDTH
                    seen = np.zeros(len(starts) * WIDTH, bool)
                    for h, inside in _grams(points, starts):
                        seen[(row + h)[inside]] = True
                    df += seen.reshape(len(starts), WIDTH).sum(axis=0)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at], pa.int64())], names=["bucket", "n"])

    rows = learn.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    df = np.zeros(WIDTH, np.int64)
    df[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return df


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Per-coordinate FTRL-proximal weights of a sparse multinomial logistic regression."""

    def __init__(self, width: int, classes: int, alpha=ALPHA, beta=BETA, l1=L1, l2=L2):
        self.z, self.n = np.zeros((width, classes)), np.zeros((width, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, ids) -> np.ndarray:
        z, n = self.z[ids], self.n[ids]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def step(self, ids: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(ids)
        p = softmax(x @ w)
        p[label] -= 1
        g = np.outer(x, p)
        n = self.n[ids]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[ids] += g - sigma * w
        self.n[ids] = n + g * g


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log likelihood, on a fixed logarithmic grid."""
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


class Model:
    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.languages, self.weights, self.bias, self.temperature = languages, weights, bias, temperature

    def long_logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for hs in long_grams(text):
            total += sum(self.weights[h] for h in hs).sum(axis=0, dtype=np.float64)
            n += sum(map(len, hs))
        return total[None] / n + self.bias

    def logits(self, texts: list[str]) -> np.ndarray:
        if len(texts) == 1 and len(texts[0]) > _CHARS:
            return self.long_logits(texts[0])
        points, starts = _points(texts)
        total = np.zeros((len(points), len(self.languages)), np.float32)
        n = np.zeros(len(texts))
        for h, inside in _grams(points, starts):
            total += self.weights[h]
            n += np.add.reduceat(inside, starts, dtype=np.int64)
        total[~inside] = 0
        return np.add.reduceat(total, starts, axis=0, dtype=np.float64) / np.maximum(n, 1)[:, None] + self.bias

    def predict(self, texts: list[str | None]) -> list:
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        at = [i for i, t in enumerate(texts) if t and next(filter(str.isalpha, t), None)] if self.languages else []
        full = [texts[i] for i in at]
        for a, b in slices(full, _CHARS):
            p = softmax(self.logits(full[a:b]) / self.temperature)
            best = p.argmax(axis=1)
            for i, k, s in zip(at[a:b], best.tolist(), p.max(axis=1).tolist(), strict=True):
                lang[i], score[i] = self.languages[k], s
        return [lang, score]


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], df: np.ndarray, n_docs: int) -> Model:
    """rows: (language, buckets, counts) of the sample, in a fixed order."""
    languages = sorted({lang for lang, _, _ in rows})
    if not languages:
        return Model([], np.zeros((WIDTH, 0), np.float32), np.zeros(0), 1.0)
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    data = [(ids, SCALE * idf[ids] * c / max(c.sum(), 1), languages.index(lang)) for lang, ids, c in rows]
    back = data[::5] if len(data) >= 50 else data
    fit = [x for k, x in enumerate(data) if k % 5] if len(data) >= 50 else data
    ftrl = Ftrl(WIDTH, len(languages))
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for k in order.permutation(len(fit)):
            ftrl.step(*fit[k])
    w = ftrl.weights(slice(None))
    logits = np.array([x @ w[ids] for ids, x, _ in back])
    temperature = fit_temperature(logits, np.array([y for *_, y in back]))
    return Model(languages, (w * idf[:, None] * SCALE).astype(np.float32), np.zeros(len(languages)), temperature)


def fit(learn: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """learn: rows to learn from. A share of ids by hash is expected to give 0.9 x sample rows; more than sample never train."""
    learn = learn.where(F.col(lang_col).isNotNull())
    n = learn.count()
    keep = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)) < int(min(1.0, 0.9 * sample / max(n, 1)) * (1 << 30))
    picked = map_texts(learn.where(keep).limit(sample), [id_col, lang_col], text_col, [("ids", "array<int>"), ("counts", "array<int>")], alone(counts_of)).toArrow().to_pandas()
    picked = picked.sort_values(id_col, kind="stable")
    df = document_frequencies(learn, text_col)
    rows = [(lang, np.asarray(i), np.asarray(c)) for lang, i, c in zip(picked[lang_col], picked["ids"], picked["counts"], strict=True)]
    return train(rows, df, n)


def predict(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns keep, lang_pred and score of each row."""
    return map_texts(docs, keep, text_col, [("lang_pred", "string"), ("score", "double")], alone(model.predict))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are kept for judging; those without an id aren't."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return predict(docs, model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
