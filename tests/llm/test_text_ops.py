"""License scans, line dedup, quality rules, secret scans: against plain Python on small and odd inputs, and against SQL."""

import hashlib
import re

import duckdb
import pytest

from barloom.llm.license_scan import OP1_SQL, scan_licenses
from barloom.llm.line_dedup import OP2_SQL, dedup_lines
from barloom.llm.quality_rules import CURRENT, OP4_SQL, POLICIES, ablations, apply_policy, ledger, policy_mask
from barloom.llm import quality_rules
from barloom.llm.secret_scan import EXAMPLE_OWNERS, OP5_SQL, find, op5_secret_scan, redact, scan_secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, kept string"
LONG = "word and other word " * 3000
LINE = "This line is in many documents."
ODD = [None, "", " ", "\n\n", "\t a\r\n", "É ß ſ K İ", "MIT License, mit license; the MIT\nLicense.", LONG, f"{LINE}\nown a", f"  {LINE.upper()}\t\nown b", f"{LINE}\n{LINE}\nown c", f"{LINE}\nown d",
       "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "All rights reserved.",
       "a a a a a a", "x y z x y z w", "### $$$", "ÀÉÎ\nÀÉÎ\nàéî", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
       "\x0b\x0cword\x1c\x85 word"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), "clash", "clash") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def sql_rows(sql, docs):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    out = con.execute(sql)
    return [d[0] for d in out.description], out.fetchall()


def same(df, other):
    names, rows = other
    assert sorted(df.columns) == sorted(names)
    norm = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    order = sorted(names)
    mine = sorted(tuple(norm(r[c]) for c in order) for r in df.collect())
    assert mine == sorted(tuple(norm(r[names.index(c)]) for c in order) for r in rows)


@pytest.mark.parametrize(("run", "sql"), [
    (lambda d: scan_licenses(d), OP1_SQL),
    (lambda d: dedup_lines(d).selectExpr("doc_id", "n_lines", "n_dropped", "sha2(coalesce(text, ''), 256) as kept_sha256"), OP2_SQL),
    (lambda d: apply_policy(ledger(d)).selectExpr("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "(fail_bits & 3) <> 0 as base_failed", "kept", "fail_bits"), OP4_SQL),
])
def test_against_sql(docs, run, sql):
    same(run(docs), sql_rows(sql, docs))
    empty = docs.where("doc_id < 0")
    assert run(empty).count() == 0


def test_license_labels(docs):
    got = {r.doc_id: r for r in scan_licenses(docs).collect()}
    assert (got[6].n_base, got[6].first_word, got[6].last_word, got[6].base_labels) == (3, 0, 5, "mit")
    assert [got[i].labels for i in (12, 13, 14, 15)] == ["mit", "apache", "gpl", "reserved"]
    assert got[0].first_word is None and got[0].labels == "" and got[0].score == 0
    assert got[20].labels == "" or got[20].score >= 0.8


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, LINE + " x"), (1, LINE + " x"), (2, LINE + " x"), (None, LINE + " x"), (3, "short"), (3, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = dedup_lines(docs)
    assert got.where("n_dropped > 0").count() == 0  # two documents only: repeats of an id are one, nulls aren't counted
    more = docs.unionByName(spark.createDataFrame([(9, LINE + " x")], docs.schema))
    kept = {(r.doc_id, r.text) for r in dedup_lines(more).collect()}
    assert (9, LINE + " x") in kept and (1, "") in kept and (None, LINE + " x") in kept and (3, "short") in kept
    assert dedup_lines(more).count() == 7
    assert scan_licenses(more).count() == 7 and ledger(more).count() == 7


def test_dedup_keeps_columns(docs):
    out = dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert {r._id for r in out.collect()} == {"clash"}
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[11] == f"{LINE}\nown d" and texts[8] == "own a" and texts[9] == "own b" and texts[10] == "own c"
    assert texts[0] is None and texts[1] == ""


def repeats(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    return len({p for i, x in enumerate(g) if g.count(x) > 1 for p in (i, i + 1, i + 2)}) if len(w) < 2000 else len(w)


def test_repeat_words(docs):
    got = {r.doc_id: r.n_repeat_words for r in ledger(docs).collect()}
    for i, t in enumerate(ODD):
        assert got[i] == repeats(t), i


def test_policies_and_ablations(docs):
    book = ledger(docs)
    rows = book.collect()
    for version in POLICIES:
        mask = policy_mask(version)
        assert apply_policy(book, version).where("kept").count() == sum((r.fail_bits & mask) == 0 for r in rows)
    for r in ablations(book, CURRENT).collect():
        from barloom.llm.quality_rules import BIT

        bit, mask = BIT[r.rule], policy_mask(CURRENT)
        assert r.n_failed == sum(bool(x.fail_bits & bit) for x in rows)
        assert r.n_only == sum((x.fail_bits & mask) == bit for x in rows)


def plain_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


KEY, HEXA = "AKIA" + "A1B2" * 5, "0123456789abcdef" * 2
SECRETS = [None, "", 'token = "abcdef1"', "PassWord:'longenough' api_key=short1 apikey: x", f"é{KEY} {KEY[:19]}", f"😀 {HEXA}g{HEXA[:23]}Z{HEXA[:24]}", "ſecret=abcdefgh", "secret: token : abcdefgh", "x" * 7 + HEXA + "é" * 50 + HEXA,
           "Authorization: Bearer abcdefghij0123456789XYZ", "a" * 100_000 + " token=abcdefgh", "token=token=abcdef"]


def test_secret_spans(spark):
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(SECRETS)] + [(2, SECRETS[2], "s"), (None, SECRETS[2], None)], "doc_id long, text string, source string")
    rows = scan_secrets(docs).collect()
    assert len(rows) == len(SECRETS) + 2
    for r in rows:
        t = SECRETS[r.doc_id if r.doc_id is not None else 2] or ""
        assert [(s.start, s.kind, s.end) for s in r.spans if s.kind < 3] == plain_spans(t)
    assert any(s.kind == 4 for r in rows if r.doc_id == 9 for s in r.spans)
    assert scan_secrets(docs.where("doc_id < 0")).count() == 0


def test_ownership_and_redaction(spark):
    shared = [(i, f"token = {'e' * 5}xample9", f"owner{i}") for i in range(EXAMPLE_OWNERS + 1)]
    docs = spark.createDataFrame([*shared, (50, "my token=liveOnly123 end", "one"), (51, None, "one")], "doc_id long, text string, source string")
    got = {r.doc_id: r.spans for r in scan_secrets(docs).collect()}
    assert not any(s.live for i in range(EXAMPLE_OWNERS + 1) for s in got[i]) and all(s.live for s in got[50])
    out = {r.doc_id: r.text for r in redact(docs).collect()}
    assert out[50] == "my <secret> end" and out[0] == shared[0][1] and out[51] is None


def test_find_orders_by_start():
    spans = find(f"token={HEXA}")
    assert [s[:3] for s in spans] == [(0, 0, 38), (2, 6, 38)]
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_secrets_against_sql(spark, tmp_path):
    """Spans of all kinds and the ownership counts, odd texts included."""
    key = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n\n" + "QUJD" * 16 + "\n"
    more = ["ghp_" + "a1" * 20, "xoxb-" + "1" * 30 + " sk_live_" + "a" * 24, "bearer " + "t" * 30, "Bearer short", key, "see https://u:longpass@h and ftp://é:🔑🔑🔑🔑🔑🔑@h", "https://u:short@h", "token='" + "e" * 9 + "'"]
    rows = [(i, t, f"owner{i % 4}") for i, t in enumerate([*SECRETS, *ODD, *more])]
    rows += [(500 + i, "password=copiedEverywhere", f"o{i}") for i in range(4)] + [(600 + i, "x glpat-" + "z" * 22, ["a", "b", None][i % 3]) for i in range(30)] + [(2, SECRETS[2], "s"), (None, SECRETS[2], None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    out = con.execute(OP5_SQL)
    same(op5_secret_scan(spark, str(tmp_path)), ([d[0] for d in out.description], out.fetchall()))


def test_repeats_without_packing(spark, monkeypatch):
    """Texts with more words than a packed place can hold: the same figures, in time that grows with n log n."""
    import random
    import time

    rng = random.Random(1)
    texts = [*ODD, "x y z " * 50, " ".join(rng.choice("abcd") for _ in range(500)), " ".join(f"w{rng.randint(0, 60)}" for _ in range(900))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {r.doc_id: r.n_repeat_words for r in ledger(docs).collect()}
    monkeypatch.setattr(quality_rules, "_LOW", 2)
    assert {r.doc_id: r.n_repeat_words for r in ledger(docs).collect()} == want
    took = {}
    for n in (40_000, 160_000):
        long = spark.createDataFrame([(0, " ".join(f"w{rng.randint(0, 300)}" for _ in range(n)))], "doc_id long, text string")
        began = time.time()
        assert ledger(long).first().n_repeat_words > 0
        took[n] = time.time() - began
    assert took[160_000] < 9 * took[40_000] + 3


def test_short_templates_stand_together(spark):
    texts = ["All rights reserved.", "the rights were reserved for all who came", "rights reserved, all rights\nreserved", "all, rights; reserved"]
    got = [r.labels for r in scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()]
    assert got == ["reserved", "", "reserved", "reserved"]


def test_wrapped_templates_against_sql(spark):
    """Templates wrapped at any width, cut, mixed or with words between them: windows over lines are the same in SQL."""
    from barloom.llm.license_scan import TEMPLATES

    texts = []
    for width in (1, 3, 9):
        for _, t in TEMPLATES:
            w = t.split()
            texts += ["\n * ".join(" ".join(w[k : k + width]) for k in range(0, len(w), width)), "some prose " * 40 + "\n".join(w) + " more prose" * 40]
            texts += [" and\n".join(w), "\n".join(w[len(w) // 3 :]), "\n".join(x for x in w for _ in (0, 1)), " ".join(w[: len(w) // 2]) + " filler" * 60 + " ".join(w[len(w) // 2 :])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    same(scan_licenses(docs), sql_rows(OP1_SQL, docs))
    assert scan_licenses(docs).where("labels <> ''").count() > 60
