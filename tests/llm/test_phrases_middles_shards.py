"""Collocations, fill-in-the-middle and sharding against plain counterparts, and their defined cases."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import fill_middle as FM
from barloom.llm import phrases as P
from barloom.llm import queries as Q
from barloom.llm import sharding as SH


@pytest.mark.parametrize("name", ["op11_phrase_collocations", "op12_fill_in_middle"])
def test_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    df = Q.queries()[name](spark, sf)
    out = con.execute(Q.oracle_sql()[name])
    assert [d[0] for d in out.description] == df.columns
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(out.fetchall(), key=repr)


# --- collocations
def plain_phrases(rows, least, longest, top, share):
    """rows: (text, lang). Everything counted in one table, parts and longer phrases looked up one by one."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            ws = re.findall(r"[^ \t]+", piece)
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                f[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, own in f.items():
        frequent = {p: a for p, a in own.items() if a >= least}
        found = []
        for p, a in frequent.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
            if len(p) < 2 or any(len(q) > len(p) and 100 * b >= share * a and inside(q) for q, b in frequent.items()):
                continue
            score, _, l, r = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k + 1, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def mined(spark, rows, **how):
    df = spark.createDataFrame([(t, lang, i, "x") for i, (t, lang) in enumerate(rows)], "text string, lang string, f long, words string")
    return sorted(map(tuple, P.collocations(df, **how).collect()))


def some_texts(n, seed=5):
    rng = random.Random(seed)
    words = ["New", "york", "city", "of", "the", "é a", "x" * 30, "Ä", "ä", "\x00", "a\rb", "now;then", "日本", "."]
    return [("".join(rng.choice(words) + rng.choice([" ", "  ", "\t", "\n", ", "]) for _ in range(rng.randrange(60))), rng.choice(["en", "de", None, "und"])) for _ in range(n)]


def test_phrases_equal_a_plain_count(spark):
    rows = some_texts(300) + [(None, "en"), ("", None), ("...", "fr"), ("one", "fr")] + [("new york city hall is far", "en")] * 9
    for how in ({"min_count": 8, "longest": 5, "top": 50, "share": 100}, {"min_count": 5, "longest": 3, "top": 2000, "share": 40}):
        want = plain_phrases(rows, how["min_count"], how["longest"], how["top"], how["share"])
        assert mined(spark, rows, **how) == want and len(want) > 20


def test_phrases_of_long_texts_and_small_slices(spark, monkeypatch):
    """Texts that are read in parts lose and double nothing, wherever the parts end."""
    rows = [(" ".join(t or "" for t, _ in some_texts(40, k)), "en") for k in range(4)]
    want = plain_phrases(rows, 6, 5, 2000, 100)
    arrow = spark.createDataFrame(rows, "text string, lang string").selectExpr("cast(text as binary) t", "lang l").toArrow().to_batches()
    for size in (40, 333, 5000):
        monkeypatch.setattr(P, "SLICE", size)
        words, total, uni = P.Vocabulary(), 0, Counter()
        for s in P.slices(iter(arrow), words):
            total += len(s.ids) - s.carried
            known = list(words)
            uni.update(known[i] for i in s.ids[s.carried :])
        assert total == want[0][6]
        sketch = type("B", (), {"value": np.full((P.ROWS, (1 << 17) // 8), 255, np.uint8)})
        got = Counter()
        for b in P.count_task(sketch, 17, 5)(iter(arrow)):
            for r in b.to_pylist():
                got[r["phrase"]] += r["f"]
        assert all(got[p] == a for _, _, p, a, *_ in want) and got[""] == total


def test_sketch_never_counts_too_little(spark):
    rows = some_texts(200)
    df = spark.createDataFrame(rows, "text string, lang string").selectExpr("cast(text as binary) t", "lang l").repartition(3)
    bits = P.frequent_cells(df, 10, 8, 5)  # 1,024 cells a row: most are shared
    words = P.Vocabulary()
    seen = Counter()
    for s in P.slices(iter(df.toArrow().to_batches()), words):
        for n, h, whole in s.hashes(words, 5):
            seen.update(h[whole].tolist())
    often = np.array([h for h, k in seen.items() if k >= 8], np.uint64)
    assert len(often) > 50 and P.passes(bits, often, 10).all()
    assert P.cells_for(0, 100) == 25 and P.cells_for(10**15, 100) == 26


def test_phrases_of_nothing(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert P.collocations(empty).count() == 0
    assert mined(spark, [(None, None), ("", "en"), ("a b", "en")]) == []
    with pytest.raises(ValueError):
        P.frequent_phrases(empty, longest=99)


def test_scores_pass_64_bits(spark):
    big = 3_000_000_000_000
    rows = [("en", 0, "", 9 * big), ("en", 1, "a", big), ("en", 1, "b", big + 7), ("en", 2, "a b", big - 1)]
    got = P.scored(spark.createDataFrame(rows, "lang string, words int, phrase string, f long")).first()
    assert got.score == 1000 * (big - 1) * 9 * big // (big * (big + 7))


# --- fill in the middle
def plain_middle(doc, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(units[a:b]) for a, b in ((0, low), (low, high), (high, None)))
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < spm else f"<P>{p}<S>{s}<M>{m}"
    return len(units), "spm" if h4 % 100 < spm else "psm", len(p), len(m), out


def test_middles_equal_a_plain_cut(spark):
    rng = random.Random(3)
    bits = ["a line\n", "\n", "é😀", "<", "P>", "<S", "no end", "\r\n", "x" * 50]
    texts = [None, "", "\n", "a", "<P>", "tail <S", "<", ">\n<"] + ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(300)] + ["line\n" * 200_000]
    df = spark.createDataFrame([(i, t, i, "q") for i, t in enumerate(texts)], "doc_id long, text string, n long, source string").repartition(3)
    for rate, spm in ((100, 50), (60, 10)):
        rows = FM.fill_in_middle(df, rate=rate, spm=spm)
        assert rows.columns == ["doc_id", "text", "source", "n", "form", "prefix_chars", "middle_chars", "output"]
        got = rows.withColumn("back", FM.restored(F.col("output"), F.col("form"))).collect()
        assert len(got) == len(texts)
        for r in got:
            assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_middle(r.doc_id, r.text, rate, spm)
            assert r.back == (r.text or "") and r.source == "q"
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_middles_of_other_units_and_nothing(spark):
    df = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c")], "doc_id string, text string")
    rows = FM.fill_in_middle(df, unit=r"\S+\s*|\s+", marks=("[P]", "[S]", "[M]")).collect()
    assert [r.n for r in rows] == [3, 3, 3] and rows[1].output == rows[2].output and "[M]" in rows[0].output
    assert FM.fill_in_middle(df.limit(0)).count() == 0


# --- sharding
def plain_deal(texts, shards):
    """Longest first over groups of equal texts: loads of the shards, sorted."""
    size = Counter()
    for t in texts:
        size[t or ""] += len((t or "").encode()) + 1
    heap = [0] * shards
    for n in sorted(size.values(), reverse=True):
        heapq.heapreplace(heap, heap[0] + n)
    return sorted(heap)


def check_shards(rows, texts, shards):
    """rows are whole, slots gapless, equal texts together; returns the loads."""
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    home, slots, load = defaultdict(set), defaultdict(list), Counter(dict.fromkeys(range(shards), 0))
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None) and 0 <= r.shard < shards
        home[raw].add(r.shard)
        slots[r.shard].append(r.slot)
        load[r.shard] += r["size"]
    assert all(len(s) == 1 for s in home.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sorted(load.values())


def test_shards_equal_a_plain_heap(spark):
    rng = random.Random(9)
    texts = [None, "", "é" * 10] + ["w" * rng.randrange(1, 3000) + str(i) for i in range(400)] + ["copy of one text " * 20] * 150
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, size int").repartition(5)
    for shards in (16, 5, 1):
        assert check_shards(SH.shard(df, shards).collect(), texts, shards) == plain_deal(texts, shards)
    few = check_shards(SH.shard(df, 4, items=64).collect(), texts, 4)  # most groups are in bundles
    assert few[-1] - few[0] <= sum(few) / 64 and sum(few) == sum(plain_deal(texts, 4))


def test_shards_with_a_hot_group_repeats_and_nothing(spark):
    texts = ["same"] * 400 + [f"own {i}" for i in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    loads = check_shards(SH.shard(df).collect(), texts, 16)
    assert loads[-1] == 2000 and loads[-2] - loads[0] <= 8
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, None)], "doc_id long, text string")
    rows = SH.shard(twice, 2).collect()
    assert len(rows) == 4 and sorted((r.shard, r.slot) for r in rows) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert SH.shard(df.limit(0)).count() == 0
    assert SH.deal([(5, 0), (4, 1), (3, 2), (3, 3), (3, 4)], 2) == {0: 0, 1: 1, 2: 1, 3: 0, 4: 1}
