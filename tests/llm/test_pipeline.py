"""The pipeline on the small table: stages keep their columns, decisions take effect, run() equals the stages one by one."""

from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import common
from barloom.llm.near_dedup import near_duplicates


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            break
        assert docs.columns == columns
        if name in ("lines", "secrets"):
            assert docs.count() == before.count()
        if name == "near":
            assert docs.count() == near_duplicates(before).where("kept").count() < before.count()
        if name == "language":
            assert docs.count() >= 0.95 * n
    before = len(common.WRITTEN)
    whole = corpus_pipeline.run(spark, sf)
    assert len(common.WRITTEN) - before == 2  # what packing reads, and its pieces; tables of the stages before are gone
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert whole.select(key).exceptAll(docs.select(key)).count() == 0 and whole.count() == docs.count()


def test_language_stage_rejects(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(10_001, "12345 !!", None, "s", 8), (10_002, None, None, "s", 0)], docs.schema)
    out = corpus_pipeline.language(spark, docs.unionByName(odd), sf)
    assert out.where("doc_id > 10000").count() == 0


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near", "secrets", "packing"]


PROSE = [" ".join(f"{a}{k}{b}" for b in range(14)) for k in range(9) for a in ("river", "stone")]


def near_copies():
    """Documents 1 to 3 are near copies with a line of their own and lines that others share; 4 to 6 share two lines only."""
    shared = ["This notice stands in very many documents.", "And this one stands below it in each."]
    rows = [(i, "\n".join([shared[0], *PROSE[:8], PROSE[8] + f" own{i}", shared[1]])) for i in (1, 2, 3)]
    return rows + [(i, "\n".join([PROSE[9 + i] + f" text{i} " + " ".join(f"w{i}x{k}" for k in range(40)), *shared])) for i in (4, 5, 6)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, lang_pred int, n_lines string, n_dropped string, _kept string, kept string, component_id string, spans string, _d int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None, "a", 7, "b", "c", "d", "e", "f", "g", 1) for i, t in rows], SCHEMA)


def keys(texts):
    return [k for t in texts for k in {x.strip().lower() for x in (t or "").split("\n")} if len(k) >= 20]


def test_copies_go_and_no_line_is_lost(spark):
    rows = near_copies()
    docs = frame(spark, rows)
    lined = corpus_pipeline.lines(spark, docs, "")
    text = {r.doc_id: r.text for r in lined.collect()}
    kept = {r.doc_id: r.text for r in corpus_pipeline.near(spark, lined, "").collect()}
    assert set(kept) == {1, 4, 5, 6}
    all_keys = keys(t for _, t in rows)
    assert {k for k in all_keys if all_keys.count(k) >= 3} <= set(keys(kept.values()))
    assert len(text[6].split("\n")) == 1 and "notice" in text[1] and "notice" not in text[4] and text[2] == dict(rows)[2]


def test_no_line_is_lost_on_the_small_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.near(spark, corpus_pipeline.lines(spark, docs, sf), sf)
    before, after = keys(r.text for r in docs.collect()), set(keys(r.text for r in kept.collect()))
    assert {k for k in before if before.count(k) >= 3} <= after


def test_odd_rows_and_clashing_columns(spark):
    """Nulls, empty and long texts, repeated rows, an empty table and columns named like the operators' own, in every stage."""
    odd = [(10, None), (11, ""), (None, PROSE[0]), (None, None), (12, PROSE[1]), (12, PROSE[1]), (13, "plain word " * 30_000), (14, "password = hunter2hunter2")]
    docs = frame(spark, near_copies() + odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.schema.names == docs.schema.names and {f.name: f.dataType for f in out.schema} == {f.name: f.dataType for f in docs.schema}
        rows = out.collect()
        assert {(r.score, r.lang_pred, r.n_lines, r.n_dropped, r["_kept"], r.kept, r.component_id, r.spans, r["_d"]) for r in rows} == {("a", 7, "b", "c", "d", "e", "f", "g", 1)}
        ids = [r.doc_id for r in rows]
        assert ids.count(12) == (1 if name == "near" else 2) and all(r.n_chars == len(r.text) for r in rows if r.text is not None)
        if name == "language":
            assert 10 not in ids and 11 not in ids and ids.count(None) == 1 and 13 in ids
        if name in ("lines", "secrets"):
            assert len(ids) == docs.count() and any(r.text is None and r.n_chars is None for r in rows)
        if name == "near":
            assert ids.count(None) == 2 and 10 in ids and 11 in ids and 2 not in ids
        if name == "secrets":
            assert {r.doc_id: r.text for r in rows}[14] == "<secret>"
        assert stage(spark, docs.where("doc_id < 0"), "").count() == 0
    pieces = corpus_pipeline.packing(spark, docs, "").where("piece = 0")
    assert pieces.count() == docs.count() and corpus_pipeline.packing(spark, docs.where("doc_id < 0"), "").count() == 0


def test_equal_rows_are_kept_once(spark, tmp_path):
    text = "\n".join(PROSE[:6])
    rows = [(1, text), (1, text), (2, text), (3, "another text of some length that no other is like, with words of its own"), (3, "a second text under the same id, unlike any other one that stands here"), (4, None), (4, None)]
    kept = corpus_pipeline.near(spark, frame(spark, rows), "").select("doc_id", "text").collect()
    assert sorted(map(tuple, kept), key=repr) == sorted({r for r in rows if r[0] != 2}, key=repr)
    none = frame(spark, rows).withColumn("doc_id", F.lit(None).cast("long"))
    assert corpus_pipeline.near(spark, none, "").count() == len(rows)


def test_pieces_are_those_of_the_cleaned_documents(spark, sf, tmp_path):
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(tmp_path / "corpus")
    pieces = corpus_pipeline.run(spark, sf, corpus=path).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(path).collect()}
    assert {r.doc_id for r in pieces} == set(texts)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in pieces[::7]:
        ids = [*tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0]
        assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
