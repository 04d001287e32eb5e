"""Wrapped notices, long and headed secrets, corpora without labels."""

from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm.license_scan import scan_licenses
from barloom.llm.secret_scan import find, redact

BSD = "Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:"
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction"


def test_wrapped_notices(spark):
    filler = "some words of prose stand here\n" * 30
    texts = [filler + BSD + "\n" + filler, MIT, "all\nrights\nreserved", "all of the\nrights are\nreserved", " ".join(BSD.split()[:8]) + "\n" + filler + " ".join(BSD.split()[8:])]
    got = {r.doc_id: (r.labels, r.score) for r in scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert got == {0: ("bsd", 1.0), 1: ("mit", 1.0), 2: ("reserved", 1.0), 3: ("", 0.0), 4: ("", 0.0)}


def test_long_and_headed_secrets(spark):
    token = "x" * 65 + "Ab1" * 100
    key = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B\n\n" + "QUJD" * 16 + "\n"
    urls = [f"see https://x-access-token:{token}@host/a", f"ftp://{token}:{token}@host", "https://user:short@host"]
    assert [[v for k, _, _, v in find(u) if k == 6] for u in urls] == [[token], [token], []]
    assert [(k, s) for k, s, _, _ in find("a " + key) if k == 5] == [(5, 2)] and find(key)[0][2] == len(key)
    docs = spark.createDataFrame([(0, "s", urls[0])], "doc_id int, source string, text string")
    assert redact(docs).first().text == "see <secret>host/a"


def test_language_stage_without_labels(spark):
    rows = [(i, t, None, "s", 1) for i, t in enumerate(["plain words of a text", "ünïcode", "12 34 --", "", None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.language(spark, docs, "").select("doc_id").collect()
    assert {r.doc_id for r in kept} == {0, 1}
    assert corpus_pipeline.language(spark, docs.where(F.lit(False)), "").count() == 0


def test_small_arrow_batches(spark):
    """Batches of texts between the JVM and Python are small, unless the session asks for smaller ones still."""
    from barloom.llm import batches

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    for before, after in (("10000", "1000"), ("0", "1000"), ("200", "200")):
        spark.conf.set(key, before)
        batches.small_batches(spark)
        assert spark.conf.get(key) == after
    spark.conf.set(key, old)


def test_long_texts_in_pieces(spark, monkeypatch):
    """Pieces of a long text give what the whole text gives."""
    import numpy as np

    from barloom.llm import language_id as LI
    from barloom.llm import toxicity as TX

    rng = np.random.default_rng(4)
    words = ["der", "Hund", "the", "dog", "ΣΑΣ", "naïve", "x" * 70, "12", "あい", "İ", "\n", "  ", "-"]
    texts = [" ".join(rng.choice(words, k)) + tail for k in (1, 7, 40, 400) for tail in ("", " ", "\n  ")]
    model = LI.Model(["a", "b"], rng.normal(size=(LI.WIDTH, 2)).astype(np.float32), np.zeros(2), 1.0)
    toxic = TX.Model(rng.normal(size=1 << TX.BITS).astype(np.float32), 0.1)
    whole = [(model.logits([t])[0], LI.counts_of([t]), toxic.logits([t])[0]) for t in texts]
    learn = spark.createDataFrame([(t,) for t in texts], "text string")
    df = LI.document_frequencies(learn, "text")
    for chars in (5, 33, 260):
        monkeypatch.setattr(LI, "_CHARS", chars)
        monkeypatch.setattr(TX, "_CHARS", chars)
        for t, (logits, (ids, counts), score) in zip(texts, whole, strict=True):
            assert np.allclose(model.logits([t])[0], logits, atol=1e-5)
            i, c = LI.counts_of([t])
            assert np.array_equal(i[0], ids[0]) and np.array_equal(c[0], counts[0])
            assert toxic.logits([t])[0] == score
    monkeypatch.setattr(LI, "_CHARS", 33)
    seen = np.zeros(LI.WIDTH, np.int64)
    for t in texts:
        one = np.zeros(LI.WIDTH, bool)
        for hs in LI.long_grams(t):
            one[np.concatenate(hs)] = True
        seen += one
    assert np.array_equal(seen, df)


def test_a_very_long_text_in_bounded_memory():
    """A text of 60 million characters: three copies of it at most, where the whole-text way took 55 bytes a character."""
    import subprocess
    import sys

    code = """
import resource, numpy as np
from barloom.llm import language_id as LI, toxicity as TX
t = "some words of prose stand here, " * 1_875_000
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
m = LI.Model(["a", "b"], np.ones((LI.WIDTH, 2), np.float32), np.zeros(2), 1.0)
assert m.predict([t])[0] == ["a"]
TX.Model(np.ones(1 << TX.BITS, np.float32), 0.1).scores([t])
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=__file__.rsplit("/tests/", 1)[0])
    assert float(got.stdout) < 500, got.stderr


def test_rows_without_an_id(spark):
    from barloom.llm import language_id as LI
    from barloom.llm import toxicity as TX

    df = spark.createDataFrame([(None,), (1,)], "doc_id long")
    assert {r[0] for m in (LI, TX) for r in df.where("doc_id is null").select(m.held_out()).collect()} == {False}


def test_queries_in_threads_keep_their_tables(spark):
    """Components in several threads of one driver: no thread deletes what another one reads."""
    from concurrent.futures import ThreadPoolExecutor

    from barloom.llm.common import tables
    from barloom.llm.components import components

    def work(k):
        edges = spark.createDataFrame([(k * 100 + i, k * 100 + i + 1) for i in range(12)], "u long, v long")
        with tables() as own:
            got = {(r.node, r.label) for r in components(edges).collect()}
        return k, got, own

    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(work, range(4)))
    assert all(got == {(k * 100 + i, k * 100) for i in range(13)} for k, got, _ in done)
    assert len({p for *_, own in done for p in own}) == sum(len(own) for *_, own in done)
