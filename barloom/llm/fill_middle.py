"""Fill-in-the-middle: texts cut at two of their units and written with the middle last.

Each text is read by a streaming matcher twice: the first pass counts its units, the second advances a lazy match iterator to the
smaller rank and on to the larger one. No list of units is ever stored, so a text of any length needs no more than itself and its
output. Ranks and forms are functions of the id alone, worked out by Spark; there is no shuffle, and a lost task repeats the same cuts.

Defined cases: a null text is an empty one. An empty text, one that contains a mark, and one that the rate leaves out are ``plain``:
the output is the text, and the lengths are null. A cut may fall before the first unit or behind the last: a part may be empty.
A null id hashes like an empty one. Rows that repeat an id are cut alike where their texts are equal. Other columns pass through;
own ones named like those added are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.batches import ROWS, claim
from barloom.llm.common import table, whole

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
LINES = r"[^\n]*\n|[^\n]+"
SEED, RATE, SPM = "7:", 100, 50
PLAIN = "plain"
FORMS = {"psm", "spm"}


def draws(id_col: Column, seed: str) -> list[Column]:
    """Four numbers below 2^32 that the id decides."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def place(units: re.Pattern, text: str, rank: int, at: int = 0) -> int:
    """Where the next `rank` units from `at` on end."""
    if rank:
        for m in islice(units.finditer(text, at), rank - 1, rank):
            at = m.end()
    return at


def cut_text(text: str, units: re.Pattern, h1: int, h2: int, form: str, marks: tuple[str, str, str]) -> tuple:
    """(units, form, lengths of prefix and middle, output)."""
    n = sum(1 for _ in units.finditer(text))
    if form == PLAIN or not text or any(m in text for m in marks):
        return n, PLAIN, None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    start = place(units, text, low)
    end = place(units, text, high - low, start)
    p, s, m = marks
    prefix, middle, suffix = text[:start], text[start:end], text[end:]
    out = (p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle)
    return n, form, start, end - start, "".join(out)


def fill_in_middle(docs: DataFrame, unit: str = LINES, rate: int = RATE, spm: int = SPM, seed: str = SEED,
                   marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all, if None) with n (units, long), form, prefix_chars, middle_chars (long) and output. unit: a
    pattern whose matches tile the text."""
    added = ("n", "form", "prefix_chars", "middle_chars", "output")
    h1, h2, h3, h4 = draws(F.col(f"`{id_col}`"), seed)
    form = F.when(h3 % 100 >= rate, F.lit(PLAIN)).when(h4 % 100 < spm, F.lit("spm")).otherwise(F.lit("psm"))
    kept = [c for c in (docs.columns if keep is None else keep) if c not in added]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_d"), F.col(f"`{text_col}`").alias("_t"), h1.alias("_h1"), h2.alias("_h2"), form.alias("_form"))
    schema = T.StructType([rows.schema["_d"], *T.StructType.fromDDL("n long, form string, prefix_chars long, middle_chars long, output string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        units = re.compile(unit)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                cut = [cut_text(t.as_py() or "", units, *h, marks) for t, *h in zip(part.column(1), *[part.column(k).to_pylist() for k in (2, 3, 4)], strict=True)]
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                columns = [pa.array([c[k] for c in cut], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["_d", *added])

    return rows.mapInArrow(run, schema).select("_d.*", *added)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that an output was made of: exact, since a text with a mark in it is plain, and no mark begins as it ends."""
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in marks), -1)
    at = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(at(1), at(3), at(2))).when(form == "spm", F.concat(at(2), at(3), at(1))).otherwise(whole(output))


def op12_fill_in_middle(spark, sf_dir):
    rows = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP12_SQL = """
with h as (
  select doc_id, coalesce(text, '') as text, sha256('7:' || doc_id) as h,
         regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') as units from documents),
ranks as (
  select *, len(units) as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2,
         ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from h),
cut as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as low, greatest(h1 % (n + 1), h2 % (n + 1)) as high,
         case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 100 then 'plain'
              when h4 % 100 < 50 then 'spm' else 'psm' end as form from ranks),
parts as (
  select *, array_to_string(units[1 : low], '') as p, array_to_string(units[low + 1 : high], '') as m,
         array_to_string(units[high + 1 :], '') as s from cut)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars,
       case when form <> 'plain' then length(m) end as middle_chars,
       sha256(case form when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
                        when 'spm' then '<S>' || s || '<P>' || p || '<M>' || m else text end) as output_sha256,
       sha256(text) as restored_sha256
from parts
"""
