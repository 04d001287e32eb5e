"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

Words are bags of their hashed character n-grams with their ends marked, so misspellings never seen share most vectors with
the words they come from. A bag is a window of WINDOW words: the mean of its n-grams' vectors goes through a linear softmax. A
text's score is that of its most toxic window (every window of the whole text is scored), so long texts don't dilute. Scale and shift of
the final logit are fitted on a fifth of the sample that doesn't train. In
training toxic texts teach through windows drawn at random at first, then through their most toxic window so far; clean ones
through windows drawn at random and their most toxic window. Prediction needs one number for each n-gram: no matrix there.

Bounds: at most SAMPLE_TOXIC and SAMPLE_CLEAN labelled rows of at most LONGEST characters train the classifier (so at most 80 MB of
text reach the driver); every row is scored, whatever its length: texts over _CHARS characters in pieces of whole windows, so that
memory doesn't grow with them beyond a copy of the text. A toxic text missed counts MISS times a false alarm, less
where few toxic texts calibrate (half of the way at MISS_HALF).
Defined cases: null or empty text is scored like a window without n-grams (the bias alone). Rows with null labels don't train;
without rows of both labels every score is the share of label 1, or 0. Repeated rows get equal results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.batches import alone, map_texts, slices
from barloom.llm.common import table
from barloom.llm.ngrams import SPACE, flatten, gram_hashes

BITS, ORDERS, DIM, WINDOW = 17, (3, 4, 5), 16, 8
SAMPLE_TOXIC, SAMPLE_CLEAN, LONGEST = 1500, 2500, 20_000
MISS, MISS_HALF = 3, 20
FIRST, DRAWN = 5, 8  # epochs before the most toxic windows are known, and windows drawn at random for each text
MIN_TEXTS = 5
EPOCHS, BATCH, RATE, START, SCALE = 14, 128, 0.5, 1e-2, 10.0
_CHARS = 1_000_000

_WORD = np.array([c if chr(c).isalnum() or chr(c) in "*@$'-_" or c > 0x7F and not chr(c).isspace() else SPACE for c in range(0x3000)], np.uint32)


def windows(texts: list[str]):
    """Buckets of all valid n-grams (one array for each order, -1 where invalid), window starts, first window of each text."""
    points, starts = flatten([t.lower() for t in texts], max(ORDERS))
    points = np.where(points < len(_WORD), _WORD[np.minimum(points, len(_WORD) - 1)], points)
    blank = points == SPACE
    begins = np.flatnonzero(~blank & np.r_[True, blank[:-1]])  # word begins
    first = np.searchsorted(begins, starts)
    of = np.searchsorted(starts, begins, "right") - 1
    order = np.arange(len(begins)) - first[of]
    cut = begins[(order % WINDOW == 0) & (order > 0)] - 1  # the blank before the word belongs to it
    cuts = np.sort(np.r_[starts, cut])
    firsts = np.searchsorted(cuts, starts)
    inner = np.cumsum(np.r_[0, blank])
    grams = []
    for n in ORDERS:
        h = np.full(len(points), -1, np.int32)
        size = len(points) - n + 1
        ok = inner[n - 1 : n - 1 + size] - inner[1 : 1 + size] == 0  # no blank but at the ends
        h[:size][ok] = gram_hashes(points, n, BITS)[ok]
        grams.append(h)
    return grams, cuts, firsts


def pieces(text: str):
    """A long text in pieces of whole windows: each begins where a window does, so the windows are those of the whole text."""
    low, at = text.lower(), 0
    while at < len(low):
        size = _CHARS
        while True:
            points = np.frombuffer(low[at : at + size].encode("utf-32-le", "surrogatepass"), "<u4")
            blank = np.where(points < len(_WORD), _WORD[np.minimum(points, len(_WORD) - 1)], points) == SPACE
            begins = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
            whole = (len(begins) - 1) // WINDOW * WINDOW
            if at + size >= len(low) or whole > 0:
                break
            size *= 2  # words so long that a window isn't over
        end = len(low) if at + size >= len(low) else at + int(begins[whole])
        yield low[at:end]
        at = end


class Model:
    def __init__(self, table: np.ndarray, bias: float, scale: float = 1.0, shift: float = 0.0):
        self.table, self.bias, self.scale, self.shift = table, bias, scale, shift

    def window_logits(self, grams, cuts) -> np.ndarray:
        padded = np.r_[self.table, np.float32(0)]
        total, n = np.zeros(len(grams[0]), np.float32), np.zeros(len(grams[0]), np.int8)
        for h in grams:
            total += padded[h]
            n += h >= 0
        return np.add.reduceat(total, cuts, dtype=np.float64) / np.maximum(np.add.reduceat(n, cuts, dtype=np.int64), 1) + self.bias

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """The logit of each text's most toxic window."""
        out = np.zeros(len(texts))
        full = [t or "" for t in texts]
        for a, b in slices(full, _CHARS):
            if len(full[a]) > _CHARS:
                out[a] = max(self.window_logits(*windows([p])[:2]).max() for p in pieces(full[a]))
                continue
            grams, cuts, firsts = windows(full[a:b])
            out[a:b] = np.maximum.reduceat(self.window_logits(grams, cuts), firsts)
        return out

    def scores(self, texts: list[str | None]) -> list:
        """The score of each text, as a list of one column."""
        return [(1 / (1 + np.exp(-np.clip(self.scale * self.logits(texts) + self.shift, -50, 50)))).tolist()]


def train(texts: list[str], labels: list[int], seed: int = 5) -> Model:
    """Embeddings and softmax trained jointly by row-wise Adagrad, a text at a time, on its most toxic window."""
    y = np.array(labels)
    if len(set(labels)) < 2:
        return Model(np.zeros(1 << BITS, np.float32), 50.0 if len(y) and y[0] else -50.0)
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.05, (1 << BITS, DIM)).astype(np.float32)
    out = np.zeros((DIM, 2), np.float32)
    out[:, 1] = rng.normal(0, 0.5, DIM)
    out[:, 0] = -out[:, 1]
    bias = np.zeros(2, np.float32)
    g_emb, g_out, g_bias = np.full(1 << BITS, START, np.float32), np.ones((DIM, 2), np.float32), np.ones(2, np.float32)
    # all windows of all texts, one after the other
    flats, sizes, counts = [], [], []
    for a, b in slices(texts, _CHARS):
        grams, cuts, firsts = windows(texts[a:b])
        flat = np.stack(grams, axis=1)
        n = np.add.reduceat((flat >= 0).sum(axis=1), cuts)
        flat = flat.ravel()
        flats.append(flat[flat >= 0])
        sizes.append(n)
        counts.append(np.diff(np.r_[firsts, len(cuts)]))
    ids, size, n_windows = np.concatenate(flats), np.concatenate(sizes), np.concatenate(counts)
    begin = np.cumsum(size) - size
    first = np.cumsum(n_windows) - n_windows
    text_of = np.repeat(np.arange(len(texts)), n_windows)

    # n-grams of few texts say nothing about others: their vectors stay 0
    texts_with = np.zeros(1 << BITS, np.int32)
    ends = np.r_[begin[first[1:]], len(ids)] if len(first) > 1 else np.array([len(ids)])
    for a, b in zip(begin[first], ends, strict=True):
        texts_with[np.unique(ids[a:b])] += 1
    known = (texts_with >= MIN_TEXTS).astype(np.float32)
    emb *= known[:, None]

    def most_toxic() -> np.ndarray:
        scalar = np.cumsum(np.r_[0.0, (emb @ (out[:, 1] - out[:, 0]))[ids]])
        mean = np.where(size > 0, (scalar[begin + size] - scalar[begin]) / np.maximum(size, 1), -np.inf)
        top = np.maximum.reduceat(mean, first)
        return np.flatnonzero(mean == top[text_of])

    for epoch in range(EPOCHS):
        drawn = np.unique(first[None, :] + (rng.random((DRAWN, len(texts))) * n_windows).astype(np.int64))
        if epoch >= FIRST:
            drawn = np.union1d(drawn[y[text_of[drawn]] == 0], most_toxic())
        drawn = drawn[size[drawn] > 0]
        share_of_toxic = max(y[text_of[drawn]].mean(), 1e-9)
        weights = (0.5 / (1 - share_of_toxic + 1e-9), 0.5 / share_of_toxic)
        rng.shuffle(drawn)
        for k in range(0, len(drawn), BATCH):
            part = drawn[k : k + BATCH]
            n = size[part]
            at = np.cumsum(n) - n
            flat = ids[np.repeat(begin[part] - at, n) + np.arange(n.sum())]
            h = np.add.reduceat(emb[flat], at, axis=0) / n[:, None]
            logits = SCALE * (h @ out) + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            label = y[text_of[part]]
            p[np.arange(len(part)), label] -= 1
            d = (p * np.take(weights, label)[:, None]).astype(np.float32)
            d_h = (SCALE * (d @ out.T) / n[:, None]).astype(np.float32)
            by = np.argsort(flat, kind="stable")
            begins = np.flatnonzero(np.diff(flat[by], prepend=-1))
            own, grad = flat[by[begins]], np.add.reduceat(np.repeat(d_h, n, axis=0)[by], begins, axis=0)
            d_out, d_bias = SCALE * (h.T @ d) / len(part), d.mean(axis=0)
            g_emb[own] += (grad * grad).sum(axis=1)
            emb[own] -= (RATE * known[own] / np.sqrt(g_emb[own]))[:, None] * grad
            g_out += d_out * d_out
            out -= 0.1 * d_out / np.sqrt(g_out)
            g_bias += d_bias * d_bias
            bias -= 0.1 * d_bias / np.sqrt(g_bias)
    return Model((SCALE * (emb @ (out[:, 1] - out[:, 0]))).astype(np.float32), float(bias[1] - bias[0]))


def calibrate(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale and shift of least weighted log loss, held near (1, 0) where there are few texts; by Newton's method."""
    a = np.array([1.0, 0.0])
    x = np.stack([np.clip(logits, -20, 20), np.ones(len(logits))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        grad = x.T @ (weight * (p - y)) + (a - [1.0, 0.0])
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(2)
        step = np.linalg.solve(hess, grad)
        a -= np.clip(step, -1, 1)
        if abs(step).max() < 1e-6:
            break
    return max(float(a[0]), 0.05), float(a[1])


def train_calibrated(texts: list[str], labels: list[int], share_of_toxic: float) -> Model:
    """Trained on four fifths; scale and shift fitted on the rest, weighted to the share of label 1 among all labelled rows."""
    back = [k for k in range(len(texts)) if k % 5 == 4]
    rest = [k for k in range(len(texts)) if k % 5 != 4]
    model = train([texts[k] for k in rest], [labels[k] for k in rest])
    y = np.array([labels[k] for k in back])
    if len(set(y.tolist())) == 2 and len({labels[k] for k in rest}) == 2:
        miss = 1 + (MISS - 1) * y.sum() / (y.sum() + MISS_HALF)
        weight = np.where(y == 1, miss * share_of_toxic / y.mean(), (1 - share_of_toxic) / (1 - y.mean()))
        model.scale, model.shift = calibrate(model.logits([texts[k] for k in back]), y, weight)
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> Model:
    """labels: the rows to learn from. A share of each label by hash of the id is expected to give 0.9 x its bound."""
    rows = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_i"), F.col(label_col).cast("int").alias("_y"))
    n = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    parts = []
    for y, most in ((1, toxic), (0, clean)):
        share = int(min(1.0, 0.9 * most / max(n.get(y, 0), 1)) * (1 << 30))
        parts.append(rows.where((F.col("_y") == y) & (F.pmod(F.xxhash64("_i"), F.lit(1 << 30)) < share)).limit(most))
    few = F.broadcast(parts[0].unionByName(parts[1]))  # at most toxic + clean rows
    picked = docs.where(F.length(F.coalesce(F.col(text_col), F.lit(""))) <= LONGEST).select(F.col(id_col).alias("_d"), F.col(text_col).alias("_text")).join(few, F.col("_d") == F.col("_i"))
    picked = picked.select("_d", "_y", "_text").limit(2 * (toxic + clean)).toArrow().to_pandas().sort_values(["_d", "_y", "_text"], kind="stable")
    return train_calibrated([t or "" for t in picked["_text"]], picked["_y"].tolist(), n.get(1, 0) / max(sum(n.values()), 1))


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns keep and score (0 to 1) of each row."""
    return map_texts(docs, keep, text_col, [("score", "double")], alone(model.scores))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are kept for judging; those without an id aren't."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return score(docs, model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
