"""Near-duplicates and exact top-k: against brute force, with hot groups, odd rows and no rows."""

import random
import re

import duckdb
import numpy as np
import pytest

from barloom.llm import near_dedup
from barloom.llm.components import components
from barloom.llm.knn import OP10_SQL, top_k
from barloom.llm.near_dedup import near_duplicates


def shingle_set(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    return {b" ".join(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {b" ".join(w)} if w else set()


def brute(rows):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, set()).update(shingle_set(t))
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def corpus(seed=1, group=420):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(4000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    base, passage = text(150), text(60)
    rows = [" ".join(w if rng.random() > e else rng.choice(words) for w in base) for e in [rng.random() * 0.08 for _ in range(group)]]
    rows += [" ".join(text(80) + passage + text(80)) for _ in range(120)]
    chain = text(100)
    for _ in range(12):  # each is near the one before only
        chain = chain[4:] + text(4)
        rows.append(" ".join(chain))
    rows += [None, "", "  \n", "one two", "One  TWO", "one two three four five", "ONE two three four five", " ".join(text(20_000))]
    rows += [rows[0].upper()] * 5
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], "doc_id long, text string, id string, label string").repartition(7)
    got = {r.doc_id: r for r in near_duplicates(docs).collect()}
    want = brute(rows)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (r.component_id == i) and r.n_shingles == len(shingle_set(rows[i][1])) for i, r in got.items())


def test_null_and_repeated_ids(spark):
    t = "a b c d e f g h"
    docs = spark.createDataFrame([(5, t), (5, t), (None, t), (2, t), (7, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in near_duplicates(docs).collect())
    assert got == [("2", 2, True), ("5", 2, False), ("5", 2, False), ("7", 7, True), ("None", None, True)]
    assert near_duplicates(docs.where("doc_id < 0")).count() == 0
    assert near_duplicates(docs.where("doc_id = 7")).count() == 1


def test_match_threshold_is_safe():
    """Of 60,000 pairs at exactly the similarity (150 shared of 200) none agrees in fewer than MATCHES coordinates."""
    rng = np.random.default_rng(0)
    least = 128
    for _ in range(60):
        x = rng.integers(0, 2**63, (1000, 200), dtype=np.uint64)
        a, b = (near_dedup.signatures(list(part)) for part in (x[:, :175], np.concatenate([x[:, :150], x[:, 175:]], axis=1)))
        least = min(least, int((a == b).sum(axis=1).min()))
    assert near_dedup.MATCHES <= least < 85


def test_repeated_ids_with_other_texts(spark):
    """An id's texts are all linked: (5, A), (5, B), 7 like A, 9 like B are one component, and 3 like C of (11, C) too."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(5, a), (5, b), (7, a + " more"), (9, b + " more"), (11, b), (11, c), (3, c), (20, "alone in the whole wide world"), (5, None)]
    got = [(r.doc_id, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted([(3, 3, True), *[(i, 3, False) for i in (5, 5, 7, 9, 11, 11)], (20, 20, True), (5, 5, True)])


@pytest.mark.parametrize("bounds", [{"CHUNK": 64, "ACROSS": 100}, {"SHINGLES": 20_000}])
def test_many_similar_classes_without_links(spark, monkeypatch, bounds):
    """Hundreds of texts of similarity 0.6 to 0.75 among each other, in several parts, verified in blocks; few are linked. Parts and
    blocks are bounded by classes, or by shingles."""
    for name, value in ({"IN_VAIN": 20} | bounds).items():
        monkeypatch.setattr(near_dedup, name, value)
    across, compare = [], near_dedup._across
    monkeypatch.setattr(near_dedup, "_across", lambda *tables: across.append(1) or compare(*tables))
    rng = random.Random(3)
    base = [f"w{k}" for k in range(400)]
    rows = []
    for i in range(300):
        words = list(base)
        for at in rng.sample(range(0, 400, 10), 10):
            words[at] = f"x{i}y{at}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, rows[i][1] + " end") for i in range(0, 300, 60)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    assert got == want and len(set(want.values())) > 150 and across


def test_blocks_by_shingles(spark):
    """A cell of few classes with large sets is dealt to as many blocks as its shingles need."""
    from pyspark.sql import functions as F

    rows = [(leader, i, size) for leader, n, size in ((1, 10, 1_000_000), (2, 10, 100), (3, 600, 100), (4, 0, 0)) for i in range(n)]
    got = spark.createDataFrame(rows, "leader long, id long, size long").groupBy("leader").agg(near_dedup._blocks(F.count("*"), near_dedup.CHUNK, F.sum("size")).alias("n"))
    assert {r.leader: r.n for r in got.collect()} == {1: 5, 2: 1, 3: 3}


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, 101), (102, 101), (200, 200)] + [(300, k) for k in range(301, 700)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[k] == 1 for k in range(1, 61)) and got[102] == 100 and got[650] == 300 and 200 not in got
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 1.0) for i, v in rows], "vec_id long, embedding array<float>, id string, d double")


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=16).astype(float).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[50][1]) for i in range(400)]  # one common vector
    rows += [(2000, None), (2001, []), (2002, [float("nan")] * 16), (2050, [float("inf")] * 16), (2003, [None] * 16), (None, rows[0][1]), rows[3], (2100, [0.0] * 16), (2101, [1e4] * 16)]
    frame = vectors(spark, rows).repartition(5)
    got = sorted(tuple(r) for r in top_k(frame, frame.vec_id % 50 == 0).collect())
    con = duckdb.connect()
    con.register("embeddings", frame.select("vec_id", "embedding").toPandas())
    want = sorted(con.execute(OP10_SQL).fetchall())
    assert got == want and len(got) > 100


def test_top_k_few(spark):
    frame = vectors(spark, [(0, [1.0, 2.0]), (7, [0.5, 0.5]), (8, [3.0])])
    assert [tuple(r) for r in top_k(frame, frame.vec_id % 50 == 0).orderBy("rank").collect()] == [(0, 1, 8, 768 * 256), (0, 2, 7, 128 * 256 + 128 * 512)]
    assert top_k(frame.where("vec_id > 5"), frame.vec_id % 50 == 0).count() == 0
    assert top_k(frame.where("vec_id > 50"), frame.vec_id % 50 == 0).count() == 0


def test_pruning_on_clustered_vectors(spark):
    """Queries go to few groups, and few of all pairs are scored; the result stays exact."""
    from pyspark.sql import functions as F

    from barloom.llm import knn

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 32)) * 3
    rows = [(i, (centres[i % 40] + 0.1 * rng.normal(size=32)).tolist()) for i in range(4000)]
    old, knn.PART = knn.PART, 250
    try:
        frame = vectors(spark, rows).repartition(4)
        plain = frame.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 50 == 0).alias("is_query"), F.col("embedding").alias("v"))
        cells, placed = knn.voronoi_cells(plain, 4000, 32)
        routes = knn.route(placed, cells, 32, 5)
        groups = len(set(cells.group.tolist()))
        assert groups >= 8 and routes.count() < 0.3 * 80 * groups
        sent = knn.dealt(placed, routes, cells).toArrow()
        assert (~sent.column("is_query").to_numpy(zero_copy_only=False)).sum() <= 4000
        keys = sorted({(g, p, b) for g, p, b in zip(*(sent.column(c).to_pylist() for c in ("group", "part", "block")), strict=True)})
        import pyarrow.compute as pc

        pairs = sum(knn.solve_part(sent.filter(pc.and_(pc.and_(pc.equal(sent["group"], g), pc.equal(sent["part"], p)), pc.equal(sent["block"], b))), cells, 32, 5)[1] for g, p, b in keys)
        assert pairs < 0.1 * 80 * 4000
        old_queries, knn.QUERIES = knn.QUERIES, 3
        got = sorted(tuple(r) for r in top_k(frame, frame.vec_id % 50 == 0).collect())
        knn.QUERIES = old_queries
    finally:
        knn.PART = old
    con = duckdb.connect()
    con.register("embeddings", frame.select("vec_id", "embedding").toPandas())
    assert got == sorted(con.execute(OP10_SQL).fetchall())
