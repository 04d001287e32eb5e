"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

A block is a line of a text, or as many consecutive words as a template has and a quarter more, whatever lines they stand on; it is
taken as its set of words. The words of the templates are ordered by their frequency in the
corpus, rarest first. A block can reach the containment threshold of a template only if it holds one of the first
|T| - need + 1 words of the template (prefix), has at least ``need`` template words at all (length), and has enough words left
after the place of the first shared one (position). Blocks that pass are verified on the full sets, so none is missed.
A set of very few words says little, so templates of fewer than PHRASE words count only where they stand consecutively.
Templates are few and fixed, so the join runs inside each row: no shuffle, whatever the corpus holds.

Defined cases: null or empty text has no words, no labels and score 0. Repeated rows are scanned like any other. Words are
runs of characters outside ASCII or among digits and letters, A-Z lower-cased. Ties between templates give both labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import ascii_lower, held, table, whole

#: what stands between words of lower-cased text
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases with their labels, and license texts with theirs.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("reserved", "all rights reserved"),
]
THRESHOLD = 0.8
PHRASE = 5
LONG_TEMPLATES = [(label, t) for label, t in TEMPLATES if len(t.split()) >= PHRASE]
SHORT_TEMPLATES = [(label, t) for label, t in TEMPLATES if len(t.split()) < PHRASE]


def _window(text: str) -> int:
    """Words of a window for a template."""
    return len(text.split()) + len(text.split()) // 4


def _need(words: list[str], threshold: float) -> int:
    return -int(-len(words) * threshold // 1)


def word_frequencies(docs: DataFrame, vocabulary: list[str], text_col: str) -> dict[str, int]:
    """How often each word of a fixed vocabulary stands in all texts. One row for each of its words reaches the driver."""
    words = F.split(ascii_lower(F.col(text_col)), BETWEEN)
    known = docs.select(F.explode(F.filter(words, lambda w: w.isin(vocabulary))).alias("_w"))
    return {r["_w"]: r["n"] for r in known.groupBy("_w").agg(F.count("*").alias("n")).collect()}


def ordered_templates(frequency: dict[str, int], threshold: float):
    """(label, words rarest first, words needed, prefix), and all words rarest first."""
    order = sorted({w for _, t in LONG_TEMPLATES for w in t.split()}, key=lambda w: (frequency.get(w, 0), w))
    place = {w: i for i, w in enumerate(order)}
    out = []
    for label, text in LONG_TEMPLATES:
        words = sorted(set(text.split()), key=place.get)
        need = _need(words, threshold)
        out.append((label, words, need, words[: len(words) - need + 1]))
    return out, order


def _literal(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _best(blocks: Column, label: str, words: list[str], need: int, prefix: list[str]) -> Column:
    """Largest containment of a template in the blocks (arrays of its vocabulary's words, rarest first); 0 below the need."""
    def contained(b: Column) -> Column:
        first = F.array_min(F.transform(_literal(prefix), lambda p: F.nullif(F.array_position(b, p), F.lit(0))))
        could = (F.size(b) >= need) & first.isNotNull() & (F.size(b) - first + 1 >= need)
        return F.when(could, F.size(F.array_intersect(b, _literal(words)))).otherwise(0)

    most = F.array_max(F.transform(blocks, contained))
    return F.when(most >= need, most / F.lit(float(len(words)))).otherwise(F.lit(0.0))


def _wrapped(words: list[str], need: int, prefix: list[str], length: int) -> Column:
    """Largest containment of a template in `length` consecutive words of _w; 0 below the need. Only surroundings of its prefix
    words that hold enough of its words are cut into windows, which start at one of its words."""
    near = F.filter(F.transform("_w", lambda w, i: F.when(w.isin(prefix), i)), lambda i: i.isNotNull())
    around = F.transform(near, lambda i: F.slice("_w", F.greatest(i + 2 - length, F.lit(1)), F.least(i, F.lit(length - 1)) + length))
    around = F.filter(around, lambda a: F.size(F.array_intersect(_literal(words), a)) >= need)
    most = F.transform(around, lambda a: F.array_max(F.transform(a, lambda w, j: F.when(w.isin(words), F.size(F.array_intersect(_literal(words), F.slice(a, j + 1, length)))).otherwise(0))))
    best = F.array_max(most)
    return F.when(best >= need, best / F.lit(float(len(words)))).otherwise(F.lit(0.0))


def _places(parts: list[str]) -> Column:
    """Starts of consecutive words in the column _w."""
    def hit(w: Column, i: Column) -> Column:
        here = w == parts[0]
        for k, p in enumerate(parts[1:], 1):
            here = here & (F.get(F.col("_w"), i + k) == p)
        return F.when(here, i)

    return F.array_compact(F.transform("_w", hit))


def scan_licenses(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row of docs."""
    text = whole(text_col)
    templates, order = ordered_templates(word_frequencies(docs, sorted({w for _, t in LONG_TEMPLATES for w in t.split()}), text_col), threshold)
    prefixes = _literal(sorted({w for *_, p in templates for w in p}))
    rows = docs.select(F.col(id_col), ascii_lower(text).alias("_low"))
    rows = rows.withColumn("_w", held(F.array_remove(F.split("_low", BETWEEN), "")))

    starts = {label: F.col(f"_at_{label}") for label in PHRASES.values()}
    places = {f"_at_{label}": F.when(F.array_contains("_w", phrase.split()[-1]), _places(phrase.split())) for phrase, label in PHRASES.items()}
    rows = rows.withColumns({name: F.coalesce(at, F.array().cast("array<int>")) for name, at in places.items()})
    base = F.array_compact(F.array(*[F.when(F.size(c) > 0, F.lit(k)) for k, c in sorted(starts.items())]))
    every = F.concat(*starts.values())

    # blocks: lines of texts with a prefix word, as the template words they hold, rarest first
    tokens = lambda x: F.array_intersect(_literal(order), F.split(x, BETWEEN))
    least = min(need for _, _, need, _ in templates)
    blocks = F.when(F.arrays_overlap("_w", prefixes), F.filter(F.transform(F.split("_low", "\n"), tokens), lambda b: F.size(b) >= least))
    rows = rows.withColumn("_blocks", held(blocks))
    best = [(t[0], f"_best{k}", F.when(F.size("_blocks") > 0, _best(F.col("_blocks"), *t)).otherwise(F.lit(0.0))) for k, t in enumerate(templates)]
    rows = rows.withColumns({name: F.coalesce(value, F.lit(0.0)) for _, name, value in best})
    # windows over lines: only for texts that hold enough of a template's words and no line with all of them
    held_words = F.when(F.arrays_overlap("_w", prefixes), F.array_intersect(_literal(order), "_w"))
    rows = rows.withColumn("_known", held(held_words))
    for (_, name, _), t, (_, text_of) in zip(best, templates, LONG_TEMPLATES, strict=True):
        could = (F.col(name) < 1) & (F.size("_known") >= t[2]) & (F.size(F.array_intersect(F.col("_known"), _literal(t[1]))) >= t[2])
        rows = rows.withColumn(name, F.when(could, F.greatest(F.col(name), F.coalesce(_wrapped(*t[1:], _window(text_of)), F.lit(0.0)))).otherwise(F.col(name)))
    for k, (label, phrase) in enumerate(SHORT_TEMPLATES):
        there = F.array_contains("_w", phrase.split()[-1]) & (F.size(_places(phrase.split())) > 0)
        rows = rows.withColumn(f"_short{k}", F.when(there, F.lit(1.0)).otherwise(F.lit(0.0)))
        best.append((label, f"_short{k}", None))
    found = F.array_compact(F.array(*[F.when(F.col(name) > 0, F.lit(label)) for label, name, _ in best]))
    score = F.when(F.size(every) > 0, F.lit(1.0)).otherwise(F.greatest(*[F.col(name) for _, name, _ in best]))
    return rows.select(
        id_col, F.size("_w").cast("long").alias("n_words"), F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"), F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, found))), ",").alias("labels"), score.alias("score"))


def op1_license_scan(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql() -> str:
    fold = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    cls = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    hits = " union all ".join(
        f"select doc_id, '{label}' as label, i - 1 as st from toks where i + {len(p.split()) - 1} <= len(w) and "
        + " and ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split())) for p, label in PHRASES.items())
    temps = ", ".join(f"({k}, '{label}', {sorted(set(t.split()))}, {_need(sorted(set(t.split())), THRESHOLD)}, {_window(t)})" for k, (label, t) in enumerate(LONG_TEMPLATES))
    short = " union all ".join(
        f"select doc_id, '{label}' as label, 1.0::double as c from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from words where list_contains(w, '{t.split()[-1]}')) where "
        + " and ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(t.split())) for label, t in SHORT_TEMPLATES)
    return f"""
with d as (select doc_id, {fold} as t from documents),
words as (select doc_id, regexp_extract_all(t, '{cls}') as w, t from d),
toks as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from words where contains(t, 'license')),
hits as ({hits}),
base as (select doc_id, count(*) as n, min(st) as lo, max(st) as hi, list(distinct label) as ls from hits group by doc_id),
temps(k, label, tw, need, size) as (values {temps}),
lines as (select doc_id, list_distinct(regexp_extract_all(line, '{cls}')) as lw from (select doc_id, unnest(string_split(t, chr(10))) as line from d)),
candidates as (select doc_id, w, label, tw, need, size from (select doc_id, w, list_distinct(w) as dw from words), temps where len(list_intersect(dw, tw)) >= need),
starts as (select doc_id, label, tw, need, w[i:i + size - 1] as win from (select *, unnest(range(1, len(w) + 1)) as i from candidates) where list_contains(tw, w[i])),
wins as (select doc_id, label, need, len(tw) as n, len(list_intersect(list_distinct(win), tw)) as hit from starts),
found as (select doc_id, label, len(list_intersect(lw, tw)) / len(tw)::double as c from lines, temps where len(list_intersect(lw, tw)) >= need
  union all select doc_id, label, hit / n::double as c from wins where hit >= need union all {short}),
best as (select doc_id, list(distinct label) as ls, max(c) as c from found group by doc_id)
select w.doc_id, len(w.w)::bigint as n_words, coalesce(b.n, 0)::bigint as n_base, b.lo::bigint as first_word, b.hi::bigint as last_word,
  coalesce(array_to_string(list_sort(b.ls), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.ls, []), coalesce(f.ls, [])))), ','), '') as labels,
  case when b.n > 0 then 1.0 else coalesce(f.c, 0) end::double as score
from words w left join base b using (doc_id) left join best f using (doc_id)
"""


OP1_SQL = _sql()
