"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each text; the ledger holds the measurements and one bit for each failed rule. Policies are
versioned masks over these bits, so a policy, or its ablation, is a bitwise operation on the ledger and never reads text again.

Defined cases: null text has no words and measures 0 everywhere, like empty text; both fail min_words. Repeated rows get a
ledger row each. Ratios over no words count as 0. Other columns of the input aren't carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import WORD, held, table, whole

SYMBOLS = "#*$%&|<>"
_LOW = 21  # bits of a packed window that hold its place

RULES = ["min_words", "repeated_words", "max_words", "word_length", "symbols", "duplicate_lines", "shouting"]
BIT = {name: 1 << k for k, name in enumerate(RULES)}
#: version -> rules that a text must pass
POLICIES = {
    1: ["min_words", "repeated_words"],
    2: ["min_words", "repeated_words", "word_length", "symbols", "duplicate_lines", "shouting"],
}
CURRENT = 2


def policy_mask(version: int) -> int:
    return sum(BIT[r] for r in POLICIES[version])


def _covered(places: Column, words: int) -> Column:
    """Words covered by windows of `words` words that start at sorted places."""
    return F.aggregate(
        F.transform(places, lambda p, i: F.least(F.lit(words), F.coalesce(F.get(places, i + 1) - p, F.lit(words)).cast("int"))), F.lit(0), lambda a, x: a + x)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the measurements.

    Windows are hashed to 64 bits. For sorting, as many high bits as fit are packed with the place into one long, so arrays of
    plain longs are sorted; a neighbour counts as equal only if all 64 bits are. Where neighbours share the packed bits but not
    all, or places need more bits, the text goes the plain way over hashes sorted with their places: n log n too, a few times slower.
    """
    text = whole(text_col)
    rows = docs.select(F.col(id_col), text.alias("_t")).withColumn("_w", held(F.regexp_extract_all("_t", F.lit(WORD), F.lit(0))))
    lines = F.filter(F.split("_t", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    rows = rows.select(
        id_col, "_w", F.size("_w").alias("_n"), lines.alias("_lines"),
        F.length(F.regexp_replace("_t", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(F.regexp_replace("_t", r"[^A-Z]+", ""))).cast("long").alias("_upper"),
        (F.length(F.regexp_replace("_t", r"[^a-z]+", ""))).cast("long").alias("_lower"))
    windows = F.transform(F.slice("_w", 1, F.greatest(F.col("_n") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(F.col("_w"), i + 1), F.get(F.col("_w"), i + 2)))
    rows = rows.select(
        id_col, "word_chars", "n_symbols", "_upper", "_lower", F.col("_n").cast("long").alias("n_words"), F.size("_lines").cast("long").alias("n_text_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), held(windows).alias("_h"), F.size("_w").alias("_k"))
    mask = (1 << _LOW) - 1
    packed = F.transform("_h", lambda h, i: F.shiftleft(F.shiftrightunsigned(h, _LOW), _LOW).bitwiseOR(i.cast("long")))
    # without a window that occurs twice there is nothing to sort
    some = F.size(F.array_distinct("_h")) < F.size("_h")
    rows = rows.select("*", some.alias("_some")).select("*", held(F.when(F.col("_some"), F.sort_array(packed))).alias("_s"))
    same = lambda a, b: F.shiftrightunsigned(a.bitwiseXOR(b), _LOW) == 0
    full = lambda x: F.get(F.col("_h"), x.bitwiseAND(F.lit(mask)).cast("int"))
    state = F.transform("_s", lambda x, i: F.when(same(x, F.get(F.col("_s"), i + 1)), F.when(full(x) == full(F.get(F.col("_s"), i + 1)), 1).otherwise(2)).otherwise(0))
    rows = rows.select("*", held(state).alias("_next"))
    plain = (F.size("_h") > mask) | F.array_contains("_next", 2)
    hit = F.filter(F.transform("_s", lambda x, i: F.when((F.get(F.col("_next"), i) == 1) | (F.get(F.col("_next"), i - 1) == 1), x.bitwiseAND(F.lit(mask)))), lambda x: x.isNotNull())
    # plain way: hashes sorted with their places
    pairs = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
    rows = rows.select("*", held(F.when(F.col("_some") & plain, pairs)).alias("_all"), F.when(F.col("_some") & ~plain, F.sort_array(hit)).alias("_quick"))
    near = lambda x, k: x["h"] == F.get(F.col("_all"), k)["h"]
    slow = F.filter(F.transform("_all", lambda x, k: F.when(near(x, k + 1) | near(x, k - 1), x["i"])), lambda i: i.isNotNull())
    rows = rows.select("*", held(F.coalesce("_quick", F.sort_array(slow))).alias("_places"))
    repeated = F.coalesce(_covered(F.col("_places"), 3), F.lit(0)).cast("long")
    return rows.select(id_col, "n_words", "word_chars", "n_symbols", "n_text_lines", "n_dup_lines", repeated.alias("n_repeat_words"),
                       F.col("_upper").alias("n_upper"), F.col("_lower").alias("n_lower"))


def failures() -> dict[str, Column]:
    """Rule -> whether a row of measurements fails it."""
    n = F.col("n_words")
    return {
        "min_words": n < 50,
        "repeated_words": 100 * F.col("n_repeat_words") > 50 * n,
        "max_words": n > 100_000,
        "word_length": (n > 0) & ((F.col("word_chars") < 2 * n) | (F.col("word_chars") > 25 * n)),
        "symbols": 100 * F.col("n_symbols") > 50 * n,
        "duplicate_lines": 100 * F.col("n_dup_lines") > 50 * F.col("n_text_lines"),
        "shouting": F.col("n_upper") > F.col("n_lower"),
    }


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, measurements and fail_bits (long) of each row of docs."""
    fails = failures()
    bits = sum((F.when(fails[r], F.lit(BIT[r])).otherwise(F.lit(0)) for r in RULES), F.lit(0))
    return measure(docs, id_col, text_col).withColumn("fail_bits", bits.cast("long"))


def apply_policy(book: DataFrame, version: int = CURRENT) -> DataFrame:
    """The ledger with kept: no rule of the policy failed."""
    return book.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(policy_mask(version))) == 0)


def ablations(book: DataFrame, version: int = CURRENT) -> DataFrame:
    """For each rule of a policy: rows it fails, rows only it fails, rows kept without it. One pass over the bits; at most one
    row for each bit pattern is shuffled by a task."""
    mask = policy_mask(version)
    patterns = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).alias("bit")) for r in POLICIES[version]])).alias("r")
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    alone = F.col("bits").bitwiseXOR(F.col("r.bit")) == 0
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).cast("long")
    return patterns.select("bits", "n", rules).groupBy(F.col("r.rule").alias("rule")).agg(
        total(hit).alias("n_failed"), total(alone).alias("n_only"), total((F.col("bits") == 0) | alone).alias("n_kept_without"))


def op4_quality_rules(spark, sf_dir):
    book = apply_policy(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))
    base = F.col("fail_bits").bitwiseAND(F.lit(policy_mask(1))) != 0
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
                       (~base & F.col("kept")).alias("kept"), "fail_bits")


OP4_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i, w[i] || chr(32) || w[i + 1] || chr(32) || w[i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d where len(w) >= 3)),
rep as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as n from win) where n > 1),
cov as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from rep) group by doc_id),
ln as (select doc_id, count(*) as n, count(distinct line) as u from (select doc_id, unnest(string_split(t, chr(10))) as line from d)
       where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
m as (select d.doc_id, len(w)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
        (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint as n_symbols, coalesce(ln.n - ln.u, 0)::bigint as n_dup_lines,
        coalesce(cov.n, 0)::bigint as n_repeat_words, coalesce(ln.n, 0) as n_lines,
        length(regexp_replace(t, '[^A-Z]', '', 'g')) as up, length(regexp_replace(t, '[^a-z]', '', 'g')) as lo
      from d left join cov using (doc_id) left join ln using (doc_id)),
r as (select *, (n_words < 50)::bigint + 2 * (100 * n_repeat_words > 50 * n_words)::bigint + 4 * (n_words > 100000)::bigint
        + 8 * (n_words > 0 and (word_chars < 2 * n_words or word_chars > 25 * n_words))::bigint
        + 16 * (100 * n_symbols > 50 * n_words)::bigint + 32 * (100 * n_dup_lines > 50 * n_lines)::bigint + 64 * (up > lo)::bigint as fail_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 as base_failed,
  (fail_bits & 123) = 0 as kept, fail_bits from r
"""
