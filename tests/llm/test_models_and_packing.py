"""Language ID, toxicity (held-out accuracy), SentencePiece (exact round trip), packing (against the library)."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from barloom.llm import language_id, toxicity
from barloom.llm.packing import BestFit, merge_open, pack, word_tokenizer
from barloom.llm.pieces import PieceModel, encode_decode

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "\n", "a", "  two  spaces ", "É日本😀\x00", "▁literal▁", "<s></s><unk>", "=" * 300, " " * 77 + "x", "ab" * 4000, "İß Σς", "it's '' 's 'S", "<|endoftext|> x", "x" * 30_000, "one two " * 2000]


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", "clash", "clash") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, ids string, _n0 string")


def test_pieces_match_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = encode_decode(docs_of(spark, ODD), PIECES, ["doc_id"]).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        ids = sp.encode(ODD[r.doc_id] or "") + [sp.eos_id()]
        assert list(r.ids) == ids and r.decoded == sp.decode(ids)
    assert encode_decode(docs_of(spark, ODD).where("doc_id < 0"), PIECES, ["doc_id"]).count() == 0


def test_pieces_random():
    sp, m, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), PieceModel(PIECES), random.Random(3)
    alphabet = ["a", "b", "the", " ", "  ", "\n", "1", "é", "日", "😀", ".", "▁", "ing", "=", "_", "/"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    for t, raw in zip(texts, m.encode(texts), strict=True):
        ids = np.frombuffer(raw, "<i4").tolist()
        assert ids == sp.encode(t) + [2] and m.decode(ids) == sp.decode(ids)


def test_words_match_library():
    t, mine, rng = Tokenizer.from_file(WORDS), word_tokenizer(WORDS), random.Random(4)
    alphabet = ["a", "B", "é", "É", " ", "\n", "1", ".", "'s", "'S", "日", "İ", "Σ", "\x1c", "\xa0", "<|endoftext|>", "<|", "é", "-"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    for x, raw in zip(texts, mine.encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def test_packing(spark):
    rows = pack(docs_of(spark, ODD).unionByName(docs_of(spark, ["again", "again"])).repartition(5), WORDS).toPandas()
    t = Tokenizer.from_file(WORDS)
    for i in range(2, len(ODD)):
        own = rows[rows.doc_id == i].sort_values("piece")
        ids = np.array([*t.encode(ODD[i] or "", add_special_tokens=False).ids, 0], "<u4")
        assert own.length.sum() == len(ids) and own.ids_crc32.tolist() == [zlib.crc32(ids[k : k + 2048].tobytes()) for k in range(0, len(ids), 2048)]
        assert own.start.tolist() == list(range(0, len(ids), 2048))
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= 2048 and s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]]
    assert pack(docs_of(spark, ODD).where("doc_id < 0"), WORDS).count() == 0


def test_best_fit_bins():
    rng, fit = random.Random(5), BestFit(100, 8)
    fill: dict[int, int] = {}
    for _ in range(5000):
        n = rng.randint(1, 100)
        b, at = fit.put(n)
        assert fill.get(b, 0) == at
        fill[b] = at + n
        assert fill[b] <= 100 and len(fit.open()) <= 8
    import pandas as pd

    left = pd.DataFrame(fit.open(), columns=["bin", "open_fill"])
    moved = merge_open(left, 100).merge(left, on="bin").sort_values("shift")
    for _, g in moved.groupby("into"):
        assert g.open_fill.sum() <= 100 and g["shift"].tolist() == [0, *g.open_fill.cumsum().tolist()[:-1]]


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs.where(~language_id.held_out()))
    got = language_id.predict(docs, model, ["doc_id", "lang"]).where(language_id.held_out()).toPandas()
    assert len(got) > 300 and (got.lang == got.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()
    odd = {r.doc_id: r for r in language_id.predict(docs_of(spark, ODD), model, ["doc_id"]).collect()}
    assert [odd[i].lang_pred for i in (0, 1, 2, 3, 9)] == ["und"] * 5 and odd[4].lang_pred != "und" and len(odd) == len(ODD)
    none = language_id.fit(docs_of(spark, ODD).where("doc_id < 0"))
    assert {r.lang_pred for r in language_id.predict(docs_of(spark, ODD), none, ["doc_id"]).collect()} == {"und"}
    assert language_id.predict(docs_of(spark, ODD).where("doc_id < 0"), model, ["doc_id"]).count() == 0


def test_predictions_dont_depend_on_neighbours(spark):
    model = language_id.Model(["a", "b"], np.random.default_rng(0).normal(size=(language_id.WIDTH, 2)).astype(np.float32), np.zeros(2), 1.0)
    texts = ["hello there", "x", "another text here", "hello there"]
    alone = [model.predict([t])[1][0] for t in texts]
    assert np.allclose(model.predict(texts)[1], alone, atol=1e-6)
    tox = toxicity.Model(np.random.default_rng(0).normal(size=1 << toxicity.BITS).astype(np.float32), 0.1)
    assert np.allclose(tox.scores(texts)[0], [tox.scores([t])[0][0] for t in texts], atol=1e-6)


def test_temperature():
    rng = np.random.default_rng(1)
    logits = rng.normal(size=(4000, 3)) * 2
    p = language_id.softmax(logits / 3.0)
    labels = np.array([rng.choice(3, p=x) for x in p])
    assert language_id.fit_temperature(logits, labels) == pytest.approx(3.0, rel=0.15)


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    got = toxicity.score(docs.join(labels, "doc_id"), model, ["doc_id", "toxic"]).where(toxicity.held_out()).toPandas()
    hit = got.score >= 0.5
    assert hit[got.toxic == 1].mean() >= 0.85 and hit[got.toxic == 0].mean() < 0.05
    odd = toxicity.score(docs_of(spark, ODD), model, ["doc_id"]).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.score(docs_of(spark, ODD).where("doc_id < 0"), model, ["doc_id"]).count() == 0
    none = toxicity.fit(docs, labels.where("toxic is null"))
    assert all(r.score < 0.5 for r in toxicity.score(docs_of(spark, ODD), none, ["doc_id"]).collect())


def test_misspellings_share_vectors():
    clean = [f"{a} quiet day number {b} in town" for a in ("some", "this", "one", "that") for b in range(40)]
    toxic = [f"{a} stupid worthless day number {b}" for a in ("some", "this", "one", "that") for b in range(40)]
    model = toxicity.train(clean + toxic, [0] * len(clean) + [1] * len(toxic))
    a, b = model.scores(["you stupidd worthles thing", "a quiet town"])[0]
    assert a > 0.5 > b


def test_toxicity_bounds_and_repeats(spark):
    """Texts over the bound don't train but are scored; repeated rows and null labels change nothing else."""
    rows = [(i, f"{'stupid worthless' if i % 2 else 'quiet lovely'} day number {i} in town") for i in range(200)]
    docs = spark.createDataFrame([*rows, (900, "stupid worthless " * 5000), (901, None), (0, rows[0][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows] + [(900, 1), (901, None), (0, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model, ["doc_id"]).collect()
    assert len(got) == 203 and len({r.score for r in got if r.doc_id == 0}) == 1
    by = {r.doc_id: r.score for r in got}
    assert by[900] > 0.5 and np.mean([by[i] > 0.5 for i in range(1, 200, 2)]) > 0.9 and np.mean([by[i] < 0.5 for i in range(0, 200, 2)]) > 0.9
    short = toxicity.fit(docs.where("doc_id >= 900"), labels)
    assert all(r.score < 0.5 for r in toxicity.score(docs, short, ["doc_id"]).collect())


def test_ftrl_against_plain_steps():
    """The vectorised step equals the published per-coordinate rule, written out; enough penalty empties weights."""
    rng = np.random.default_rng(6)
    fast = language_id.Ftrl(12, 3, alpha=0.3, beta=1.0, l1=0.02, l2=0.01)
    z, n = np.zeros((12, 3)), np.zeros((12, 3))

    def weight(i, k):
        return 0.0 if abs(z[i, k]) <= 0.02 else -(z[i, k] - np.sign(z[i, k]) * 0.02) / ((1.0 + np.sqrt(n[i, k])) / 0.3 + 0.01)

    for _ in range(60):
        ids, x, y = rng.choice(12, 4, replace=False), rng.random(4), int(rng.integers(3))
        w = np.array([[weight(i, k) for k in range(3)] for i in ids])
        e = np.exp(x @ w)
        p = e / e.sum()
        for a, i in enumerate(ids):
            for k in range(3):
                g = x[a] * (p[k] - (k == y))
                sigma = (np.sqrt(n[i, k] + g * g) - np.sqrt(n[i, k])) / 0.3
                z[i, k] += g - sigma * w[a, k]
                n[i, k] += g * g
        fast.step(ids, x, y)
    assert np.allclose(fast.z, z) and np.allclose(fast.n, n)
    assert np.allclose(fast.weights(slice(None)), [[weight(i, k) for k in range(3)] for i in range(12)])


def test_language_weights_are_sparse(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs.where(~language_id.held_out()))
    seen = language_id.document_frequencies(docs.where("lang is not null").where(~language_id.held_out()), "text") > 0
    assert (model.weights[seen] == 0).mean() > 0.5


def test_best_fit_rule():
    """Against the rule written out: the fullest open bin that a piece fits in; if none and all are open, the fullest closes."""
    rng, fit = random.Random(6), BestFit(64, 5)
    bins: dict[int, int] = {}
    for _ in range(4000):
        n = rng.randint(1, 64)
        which, at = fit.put(n)
        fitting = [f for f in bins.values() if f + n <= 64]
        if fitting:
            assert at == max(fitting) and bins[which] == at
        else:
            assert at == 0 and which not in bins
            if len(bins) == 5:
                fullest = max(bins.values())
                gone = next(b for b, f in bins.items() if f == fullest and b not in dict(fit.open()))
                del bins[gone]
        bins[which] = at + n
        if bins[which] == 64:
            del bins[which]
        assert bins == dict(fit.open())


def test_few_sequences(spark):
    rows = pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(4), WORDS).toPandas()
    assert rows.sequence_id.nunique() <= 1.02 * -(-rows.length.sum() // 2048)


def plain_toxicity(texts, labels, seed=5):
    """Joint training of the embeddings and the softmax in loops: a window, an n-gram and a number at a time."""
    import numpy as np

    from barloom.llm import toxicity as TX

    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.05, (1 << TX.BITS, TX.DIM)).astype(np.float32)
    out = np.zeros((TX.DIM, 2), np.float32)
    out[:, 1] = rng.normal(0, 0.5, TX.DIM)
    out[:, 0] = -out[:, 1]
    bias, g_emb, g_out, g_bias = np.zeros(2, np.float32), {}, np.ones((TX.DIM, 2)), np.ones(2)
    bags, text_of, first = [], [], []  # the n-grams of each window
    for k, t in enumerate(texts):
        grams, cuts, _ = TX.windows([t])
        first.append(len(bags))
        for a, b in zip(cuts, [*cuts[1:], len(grams[0])], strict=True):
            bags.append([int(g[at]) for at in range(a, b) for g in grams if g[at] >= 0])
            text_of.append(k)
    in_texts = {}
    for k in range(len(texts)):
        for g in {g for b, t in zip(bags, text_of, strict=True) if t == k for g in b}:
            in_texts[g] = in_texts.get(g, 0) + 1
    known = {g for g, n in in_texts.items() if n >= TX.MIN_TEXTS}
    for g in range(len(emb)):
        if g not in known:
            emb[g] = 0
    windows_of = [[w for w, t in enumerate(text_of) if t == k] for k in range(len(texts))]
    for epoch in range(TX.EPOCHS):
        share = rng.random((TX.DRAWN, len(texts)))
        drawn = sorted({first[k] + int(share[i, k] * len(windows_of[k])) for i in range(TX.DRAWN) for k in range(len(texts))})
        if epoch >= TX.FIRST:
            worst = []
            for own in windows_of:  # every window of the text is looked at
                score = {w: float(np.mean([emb[g] @ (out[:, 1] - out[:, 0]) for g in bags[w]])) for w in own if bags[w]}
                worst += [w for w, s in score.items() if s >= max(score.values()) - 1e-6]
            drawn = sorted({w for w in drawn if labels[text_of[w]] == 0} | set(worst))
        drawn = np.array([w for w in drawn if bags[w]])
        toxic = max(np.mean([labels[text_of[w]] for w in drawn]), 1e-9)
        weight = (0.5 / (1 - toxic + 1e-9), 0.5 / toxic)
        rng.shuffle(drawn)
        for lo in range(0, len(drawn), TX.BATCH):
            part = drawn[lo : lo + TX.BATCH]
            grad, d_out, d_bias = {}, np.zeros((TX.DIM, 2)), np.zeros(2)
            for w in part:
                h = sum(emb[g].astype(float) for g in bags[w]) / len(bags[w])
                x = TX.SCALE * (h @ out) + bias
                p = np.exp(x - x.max())
                p /= p.sum()
                y = labels[text_of[w]]
                p[y] -= 1
                d = p * weight[y]
                for g in bags[w]:
                    grad[g] = grad.get(g, 0) + TX.SCALE * (out.astype(float) @ d) / len(bags[w])
                d_out += TX.SCALE * np.outer(h, d) / len(part)
                d_bias += d / len(part)
            for g, v in grad.items():
                g_emb[g] = g_emb.get(g, TX.START) + (v * v).sum()
                emb[g] -= (g in known) * TX.RATE / np.sqrt(g_emb[g]) * v
            g_out += d_out * d_out
            out -= 0.1 * d_out / np.sqrt(g_out)
            g_bias += d_bias * d_bias
            bias -= 0.1 * d_bias / np.sqrt(g_bias)
    return TX.SCALE * (emb @ (out[:, 1] - out[:, 0])), bias[1] - bias[0]


def test_toxicity_equals_plain_training(monkeypatch):
    import numpy as np

    from barloom.llm import toxicity as TX

    rng = np.random.default_rng(2)
    monkeypatch.setattr(TX, "EPOCHS", 7)
    monkeypatch.setattr(TX, "BATCH", 16)
    monkeypatch.setattr(TX, "MIN_TEXTS", 2)
    good, bad = ["river", "meadow", "stone", "quiet", "walked"], ["vile", "rotten", "scum"]
    texts = [" ".join(rng.choice(good, rng.integers(1, 30))) for _ in range(10)]
    texts += [" ".join([*rng.choice(good, 9), *rng.choice(bad, 3), *rng.choice(good, 6)]) for _ in range(6)] + ["", "1"]
    labels = [0] * 10 + [1] * 6 + [0, 0]
    model = TX.train(texts, labels)
    table, bias = plain_toxicity(texts, labels)
    assert np.allclose(model.table, table, atol=2e-3) and abs(model.bias - bias) < 2e-3
    assert np.abs(model.table).max() > 1 and (model.logits(texts[10:16]).min() > model.logits(texts[:10]).max())
