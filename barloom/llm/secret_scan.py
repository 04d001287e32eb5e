"""Secret scans with corpus-wide ownership frequency.

One pass finds candidate spans. Their values' hashes are aggregated over the whole corpus by distinct repositories (document
ids) and owners (sources): a value that many owners or repositories show is a copied example, one that stays with its owner
looks live. Candidates of the added kinds count only where they look live; spans of the base kinds always do.

Defined cases: null or empty text has no spans. A null owner is one owner of its own. Equal rows get equal results. Spans are
code points, end exclusive, ordered by start, then kind as listed. Texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.batches import alone, map_texts, mark_among, slices
from barloom.llm.common import cut, table, whole

# Kinds in their order, the first three the base kinds.
KINDS = ["assign", "access", "hex", "provider", "bearer", "private_key", "url_password"]
BASE = 3
#: a value of more owners, or of at least this many repositories of more than one owner, is a copied example
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 2, 20

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ADDED = [
    (3, ("ghp_", "gho_", "xox", "glpat-", "sk_live_"), re.compile(r"(?:gh[po]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{20,}|glpat-[A-Za-z0-9_-]{20,}|sk_live_[A-Za-z0-9]{20,})")),
    (4, ("earer ",), re.compile(r"[Bb]earer ([A-Za-z0-9._~+/-]{20,}=*)")),
    (5, ("PRIVATE KEY-----",), re.compile(r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:[\x09-\x0D\x20]*[A-Za-z][A-Za-z0-9-]{0,40}:[^\r\n]*[\r\n])*[A-Za-z0-9+/=\x09-\x0D\x20]{40,}")),
    (6, ("://",), re.compile(r"[a-z][a-z0-9+.-]{1,12}://[^\x09-\x0D\x20:/@]+:([^\x09-\x0D\x20:/@]{6,})@")),
]
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_IS_HEX = np.zeros(256, np.uint8)
_IS_HEX[list(b"0123456789abcdef")] = 1
_EIGHT = np.uint64(0x0101010101010101)


def with_long_hex(texts: list[str]) -> set[int]:
    """Texts that may hold 24 hex digits in a row: such a run covers a whole aligned block of eight bytes."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    starts = np.cumsum([0] + [len(r) + 1 for r in raw[:-1]])
    data = np.frombuffer(b"\n".join(raw) + b"\n" * 8, np.uint8)
    blocks = _IS_HEX[data[: len(data) // 8 * 8]].view(np.uint64) == _EIGHT
    return set((np.searchsorted(starts, np.flatnonzero(blocks) * 8, "right") - 1).tolist())


def find(text: str, long_hex: bool = True) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) of all candidates in a text."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(0, *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(1, *m.span(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if long_hex:
        out += [(2, *m.span(), m[0]) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    for kind, marks, pattern in ADDED:
        if any(x in text for x in marks):
            out += [(kind, *m.span(), m[m.re.groups]) for m in pattern.finditer(text)]
    return sorted(out, key=lambda x: (x[1], x[0], x[2]))


def _scan(texts: list[str | None]):
    found = []
    full = [t or "" for t in texts]
    for a, b in slices(full):
        part = full[a:b]
        hexes = with_long_hex(part)
        for i, t in enumerate(part):
            found.append([{"kind": k, "start": s, "end": e, "value": hashlib.blake2b(v.encode("utf-8", "surrogatepass"), digest_size=16).digest()} for k, s, e, v in find(t, i in hexes)])
    return [found]


def candidates(docs: DataFrame, id_col: str = "doc_id", owner_col: str = "source", text_col: str = "text") -> DataFrame:
    """_id, _owner, _t (hash of the text) and all candidate spans of each row."""
    rows = docs.select(F.col(id_col).alias("_id"), whole(F.col(owner_col).cast("string")).alias("_owner"), F.xxhash64(text_col).alias("_t"), F.col(text_col).alias("_text"))
    return map_texts(rows, ["_id", "_owner", "_t"], "_text", [("spans", "array<struct<kind:int,start:int,end:int,value:binary>>")], alone(_scan))


def ownership(found: DataFrame) -> DataFrame:
    """value, n_repositories, n_owners, live: over all documents. Equal (value, owner, repository) merge before the shuffle."""
    spans = found.select("_id", "_owner", F.explode("spans").alias("s")).select("_id", "_owner", F.col("s.value").alias("value"))
    counted = spans.groupBy("value").agg(F.count_distinct("_id").alias("n_repositories"), F.count_distinct("_owner").alias("n_owners"))
    example = (F.col("n_owners") > EXAMPLE_OWNERS) | ((F.col("n_owners") > 1) & (F.col("n_repositories") >= EXAMPLE_REPOSITORIES))
    return counted.withColumn("live", ~example)


def judged_spans(found: DataFrame) -> DataFrame:
    """_id, _t and spans (start, kind, end, live), those of the added kinds only if live."""
    values = cut(ownership(found).select("value", "live"))
    spans = found.select("_id", "_t", F.explode("spans").alias("s")).select("_id", "_t", "s.*").join(values, "value")
    spans = spans.where((F.col("kind") < BASE) | F.col("live"))
    return spans.groupBy("_id", "_t").agg(F.sort_array(F.collect_set(F.struct("start", "kind", "end", "live"))).alias("spans"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", owner_col: str = "source", text_col: str = "text") -> DataFrame:
    """id and spans (start, kind, end, live) of each row of docs; spans is an empty array where there are none."""
    found = cut(candidates(docs, id_col, owner_col, text_col))
    judged = judged_spans(found).select(F.col("_id").alias("_i"), F.col("_t").alias("_h"), F.col("spans").alias("_s"))
    out = found.select("_id", "_t").join(judged, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_t") == F.col("_h")), "left")
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean>>")
    return out.select(F.col("_id").alias(id_col), F.coalesce("_s", empty).alias("spans"))


def redact(docs: DataFrame, mark: str = "<secret>", id_col: str = "doc_id", owner_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs with every live span of text_col replaced by a mark; copied examples stay. Overlapping spans give one mark."""
    judged = judged_spans(cut(candidates(docs, id_col, owner_col, text_col)))
    live = cut(judged.select("_id", "_t", F.filter("spans", lambda s: s.live).alias("_s")).where(F.size("_s") > 0))
    # texts without a live span aren't shuffled
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_d"))
    rows = mark_among(rows, live.select(F.col("_id").alias("id")), F.col(f"_d.`{id_col}`"))
    same = rows.where("not _may").select("_d.*")
    rows = rows.where("_may").join(live, F.col(f"_d.`{id_col}`").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col(f"_d.`{text_col}`")) == F.col("_t")), "left")
    old = F.col(f"_d.`{text_col}`")
    state = F.aggregate(
        "_s", F.struct(F.lit("").alias("text"), F.lit(0).alias("at")),
        lambda a, s: F.when(s.start >= a["at"], F.struct(F.concat(a["text"], F.substring(old, a["at"] + 1, s.start - a["at"]), F.lit(mark)).alias("text"), s.end.alias("at")))
        .otherwise(F.struct(a["text"].alias("text"), F.greatest(a["at"], s.end).alias("at"))),
        lambda a: F.concat(a["text"], F.substring(old, a["at"] + 1, F.length(old))))
    return same.unionByName(rows.select(*[F.when(F.col("_s").isNull(), old).otherwise(state).alias(c) if c == text_col else F.col(f"_d.`{c}`").alias(c) for c in docs.columns]))


def digest(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")


def op5_secret_scan(spark, sf_dir):
    found = scan_secrets(table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", of(0), of(1), of(2), F.sha2(digest(F.filter("spans", lambda s: s.kind < BASE)), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"),
                        F.size(F.filter("spans", lambda s: s.live)).cast("long").alias("n_live"))


def _sql() -> str:
    """The same in SQL: a match starts where the texts between matches and the matches before it end."""
    letters = "".join(f"[{x.upper()}{x}]" if x.isalpha() else x for x in "password|passwd|secret|token|api_?key")
    assign = ASSIGN.pattern.replace("(?ai:password|passwd|secret|token|api_?key)", letters)
    patterns = [(0, assign, 2, 6), (1, "AKIA[A-Z0-9]{16,}", 0, 20), (2, "[0-9a-f]{24,}", 0, 24)] + [(k, p.pattern, p.groups, 0) for k, _, p in ADDED]
    parts = " union all ".join(
        f"select rid, doc_id, owner, {k} as kind, {least} as least, regexp_extract_all(t, '{p}') as m, string_split_regex(t, '{p}') as g, regexp_extract_all(t, '{p}', {group}) as v from d where regexp_matches(t, '{p}')"
        for k, p, group, least in ((k, p.replace("'", "''"), group, least) for k, p, group, least in patterns))
    names = ", ".join(f"'{k}'" for k in KINDS)
    text = "string_agg({} || ':' || st || ':' || en, ',' order by st, kind, en)".format(f"[{names}][kind + 1]")
    return f"""
with d as (select row_number() over () as rid, doc_id, coalesce(source::varchar, '') as owner, coalesce(text, '') as t from documents),
hits as ({parts}),
places as (select rid, doc_id, owner, kind, least, v[i] as val, m[i] as hit,
    list_sum(list_transform(g[1:i], lambda x: length(x)))::bigint + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::bigint as st
  from (select *, unnest(range(1, len(m) + 1)) as i from hits)),
spans as (select distinct rid, doc_id, owner, kind, val, st, st + length(hit) as en from places where length(val) >= least),
ownership as (select val, not (count(distinct owner) > {EXAMPLE_OWNERS} or (count(distinct owner) > 1 and count(distinct doc_id) >= {EXAMPLE_REPOSITORIES})) as live from spans group by val),
judged as (select rid, kind, st, en, live from spans join ownership using (val) where kind < {BASE} or live),
found as (select rid, count_if(kind = 0) as n_assign, count_if(kind = 1) as n_access, count_if(kind = 2) as n_hex, {text} filter (where kind < {BASE}) as base, {text} as spans, count_if(live) as n_live from judged group by rid)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256,
  coalesce(spans, '') as spans, coalesce(n_live, 0)::bigint as n_live from d left join found using (rid)
"""


OP5_SQL = _sql()
