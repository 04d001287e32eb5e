"""MinHash near-duplicates by a signature-coordinate inverted join.

1. A document's set (hashes of five-word shingles) gives a signature of COORDINATES minima. Equal sets are one class.
2. Every class is posted under (coordinate, value) pairs. Of the COORDINATES pairs of a class only the COORDINATES - MATCHES + 1
   least frequent ones in the corpus are posted (prefix): two classes that agree in MATCHES coordinates share one of those. The
   frequent pairs, such as those of a passage in very many documents, are skipped and only counted when candidates are compared.
   Frequencies come from a sketch of fixed size; any common order keeps the guarantee.
3. The classes posted under a pair meet in the cell of its leader, the class whose pairs are most frequent: the centre of a group
   of copies. Cells larger than CHUNK are split, the leader standing in each part. In a part, collisions of signatures are
   counted, pairs with MATCHES or more are verified on the full sets unless already connected, and only links that connect
   anything come out. So a group of copies costs about as many comparisons as it has members, and no group is ever one task.
4. For cells of several parts, the classes that aren't connected with the leader are compared with all other parts, in blocks.
5. Links give components; copies follow their class.

Chance: a pair of similarity exactly 0.75 agrees in fewer than 70 of 128 coordinates with probability 1.6e-7 (binomial); links
above it are safer still. Everything that comes out is verified on the full sets. Cost: pairs that agree so often and yet are no
links must all be verified, whatever the order; m classes of similarity 0.6 to 0.75 among each other are m^2 / 2 such pairs. They
are dealt in blocks to many tasks, and verified there by one matrix product for a block.

Defined cases: null or empty text, or text of white space, has an empty set and is linked with nothing. Fewer words than five are
one shingle. Rows with a null id are linked with nothing and kept. Rows that repeat an id are one document: it has the links of
all its texts, which so belong to one component (n_shingles is that of each row). Ids are long, or cast to it; one that can't be cast
ends the run with Spark's error.

Bounds: parts and blocks are bounded by classes (CHUNK, ACROSS) and by the shingles of their sets (SHINGLES): ids are dealt to as many
parts as both need, so a part has about that many, and the largest set that is in it. From IN_VAIN verifications in vain on, a
block's pairs are verified by matrix products instead of one by one, with the same results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.batches import ROWS, claim, filter_bits, id_filter, lets_through, map_texts, slices
from barloom.llm.common import cut, table
from barloom.llm.components import components

WORDS, PERCENT = 5, 75
COORDINATES, MATCHES = 128, 70
POSTED = COORDINATES - MATCHES + 1
CHUNK = 256
#: classes of a block where parts of a large cell are compared with each other
ACROSS = 1024
#: shingles of all sets of a part or block (8 bytes each)
SHINGLES = 1 << 21
#: counters of the frequency sketch that is sent to every executor
SKETCH_BITS = 20
_KNOWN = 150_000

_rng = np.random.default_rng(20)
_PLACE = _rng.integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHORT = _rng.integers(0, 2**63, dtype=np.uint64)
_MUL = _rng.integers(0, 2**31, COORDINATES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 2**32, COORDINATES, dtype=np.uint32)
_COORD = np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray, odd: int = 0xFF51AFD7ED558CCD) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(odd)
    return x ^ (x >> np.uint64(29))


class _Words(dict):
    """Hashes of words; those met first are remembered."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < _KNOWN:
            self[word] = h
        return h


_words = _Words()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles. bytes.lower() and bytes.split() know ASCII only, as wanted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    if n < WORDS:
        return _mix((h * _PLACE[:n]).sum(keepdims=True) + np.full(1, n, np.uint64) * _SHORT) if n else h
    total = h[: n - WORDS + 1] * _PLACE[0]
    for k in range(1, WORDS):
        total += h[k : n - WORDS + 1 + k] * _PLACE[k]
    return np.unique(_mix(total))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of COORDINATES minima for each set that isn't empty."""
    if not sets:
        return np.empty((0, COORDINATES), np.uint32)
    x = (_mix(np.concatenate(sets), 0xC4CEB9FE1A85EC53) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), COORDINATES), np.uint32)
    for k in range(COORDINATES):
        out[:, k] = np.minimum.reduceat(x * _MUL[k] + _ADD[k], starts)
    return out


def _describe(texts: list[str | None]) -> list:
    n, k1, k2, sig = [], [], [], []
    full = [t or "" for t in texts]
    for a, b in slices(full, 1_000_000):
        sets = [shingles(t) for t in full[a:b]]
        rows = iter(signatures([s for s in sets if len(s)]))
        for s in sets:
            n.append(len(s))
            k1.append(int(_mix(s).sum().view(np.int64)) if len(s) else 0)
            k2.append(int(_mix(s, 0x9FB21C651E98DF25).sum().view(np.int64)) if len(s) else 0)
            sig.append(next(rows).tobytes() if len(s) else None)
    return [n, k1, k2, sig]


def _describer():
    claim(_words)
    return _describe


def describe(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n, k1, k2 (128 bits of the set), sig of each row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    return map_texts(rows, ["id"], "_text", [("n", "long"), ("k1", "long"), ("k2", "long"), ("sig", "binary")], _describer)


def _tokens(sig: np.ndarray) -> np.ndarray:
    return _mix(sig.astype(np.uint64) + _COORD, 0xD6E8FEB86659FD93)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _parts(batches):
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def sketch(classes: DataFrame) -> np.ndarray:
    """How often (coordinate, value) pairs occur, in 2^SKETCH_BITS counters."""
    def run(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for part in _parts(batches):
            total += np.bincount((_tokens(_matrix(part.column(0))) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64).ravel(), minlength=1 << SKETCH_BITS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["at", "n"])

    rows = classes.select("sig").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    out[rows["at"].to_numpy()] = rows["n"].to_numpy()
    return out


def postings(classes: DataFrame, frequency) -> DataFrame:
    """(token, id, central, size) under the POSTED least frequent tokens of each class. frequency: a broadcast sketch."""
    def run(batches):
        counts = frequency.value
        for part in _parts(batches):
            token = _tokens(_matrix(part.column(1)))
            n = counts[(token >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
            order = (np.minimum(n, (1 << 30) - 1).astype(np.uint64) << np.uint64(34)) | (token & np.uint64((1 << 34) - 1))
            pick = np.argpartition(order, POSTED - 1, axis=1)[:, :POSTED]
            chosen = np.take_along_axis(token, pick, 1)
            central = (np.log2(n + 1.0).sum(axis=1) * 1000).astype(np.int64)
            rows = len(token)
            yield pa.RecordBatch.from_arrays([
                pa.array(chosen.ravel().view(np.int64)), pa.array(np.repeat(part.column(0).to_numpy(zero_copy_only=False), POSTED)),
                pa.array(np.repeat(central, POSTED)), pa.array(np.repeat(part.column(2).to_numpy(zero_copy_only=False), POSTED))] if rows else [pa.array([], pa.int64())] * 4,
                names=["token", "id", "central", "size"])

    return classes.select("id", "sig", "n").mapInArrow(run, "token long, id long, central long, size long")


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < PERCENT * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int(np.count_nonzero(b[at] == a))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _collisions(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many coordinates each row of a agrees with each of b."""
    total = np.zeros((len(a), len(b)), np.uint8)
    for k in range(COORDINATES):
        total += a[:, k][:, None] == b[:, k][None, :]
    return total


def _intersections(a: list[np.ndarray], b: list[np.ndarray], columns: int = 1 << 12) -> np.ndarray:
    """Sizes of the intersections of each set of a with each of b, by products of 0-1 matrices of some columns at a time."""
    known, at = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    row = np.repeat(np.arange(len(a) + len(b)), [len(s) for s in (*a, *b)])
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    total = np.zeros((len(a), len(b)), np.int64)
    for lo in range(0, len(known), columns):
        some = slice(*np.searchsorted(at, [lo, lo + columns]))
        m = np.zeros((len(a) + len(b), columns), np.float32)
        m[row[some], at[some] - lo] = 1
        total += (m[: len(a)] @ m[len(a) :].T).astype(np.int64)  # below 2^24 in each product
    return total


#: verifications in vain after which the rest of a block is verified by a matrix product
IN_VAIN = 2000


class _Verifier:
    """Whether two sets of a block are similar: one by one at first, all at once where that turns out to be much work."""

    def __init__(self, a: list[np.ndarray], b: list[np.ndarray]):
        self.a, self.b, self.vain, self.all = a, b, 0, None

    def __call__(self, i: int, j: int) -> bool:
        if self.all is not None:
            return bool(self.all[i, j])
        ok = _similar(self.a[i], self.b[j])
        self.vain += not ok
        if self.vain == IN_VAIN:
            both = _intersections(self.a, self.b)
            size = np.array([len(s) for s in self.a])[:, None] + np.array([len(s) for s in self.b])[None, :]
            self.all = 100 * both >= PERCENT * (size - both)
        return ok


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


_HOPEFUL = "leader long, chunk int, chunks int, id long, size long"
_LINKS = "u long, v long"


def _table(schema: str, *columns) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table({n: pa.array(np.asarray(c), kinds[t]) for (n, t), c in zip(fields, columns, strict=True)})


def _hopeful(part: pa.Table) -> pa.Table:
    """The rows of a part that collide often enough with another; all of them where the cell has several parts."""
    if part.column("chunks")[0].as_py() == 1:
        sig = _matrix(part.column("sig"))
        hits = _collisions(sig, sig) >= MATCHES
        np.fill_diagonal(hits, False)
        part = part.filter(pa.array(hits.any(axis=1)))
    ids, at = np.unique(part.column("id").to_numpy(), return_index=True)  # an id with several texts stands there several times
    part = part.take(at)
    return _table(_HOPEFUL, part.column("leader").to_numpy(), part.column("chunk").to_numpy(), part.column("chunks").to_numpy(), ids, part.column("size").to_numpy())


def _load(part: pa.Table):
    return part.column("id").to_numpy(), _matrix(part.column("sig")), [np.frombuffer(s, np.uint64) for s in part.column("shingles").to_pylist()]


def _link_part(part: pa.Table) -> pa.Table:
    """Verified links that connect the classes of a part, the leader's first."""
    part = part.take(np.argsort(part.column("id").to_numpy() != part.column("leader").to_numpy(), kind="stable"))
    ids, sig, sets = _load(part)
    forest, similar, links = _Forest(len(ids)), _Verifier(sets, sets), []
    left, right = np.nonzero(np.triu(_collisions(sig, sig) >= MATCHES, 1))
    for i, j in zip(left.tolist(), right.tolist(), strict=True):
        if forest.root(i) != forest.root(j) and similar(i, j) and forest.join(i, j):
            links.append((ids[i], ids[j]))
    return _table(_LINKS, [a for a, _ in links], [b for _, b in links])


def _link_blocks(part: pa.Table) -> pa.Table:
    """Verified links between the minor classes of a block and the classes of a part, of components not yet connected."""
    ids, sig, sets = _load(part)
    minor, label = part.column("minor").to_numpy(zero_copy_only=False).astype(bool), part.column("label").to_numpy()
    rows, others = np.flatnonzero(minor), np.flatnonzero(~minor)
    _, own = np.unique(label, return_inverse=True)
    forest, similar, links = _Forest(own.max() + 1), _Verifier([sets[i] for i in rows], [sets[j] for j in others]), []
    hits = (_collisions(sig[rows], sig[others]) >= MATCHES) & (label[rows][:, None] != label[others][None, :])
    for x, y in zip(*(x.tolist() for x in np.nonzero(hits)), strict=True):
        i, j = rows[x], others[y]
        if forest.root(own[i]) != forest.root(own[j]) and similar(x, y) and forest.join(own[i], own[j]):
            links.append((ids[i], ids[j]))
    return _table(_LINKS, [a for a, _ in links], [b for _, b in links])


def _sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, sig, shingles, k1) of the wanted ids, and of a few others that the filter lets through; a row for each text of an id."""
    words = docs.sparkSession.sparkContext.broadcast(id_filter(wanted))
    bit = [b.alias(f"b{k}") for k, b in enumerate(filter_bits(F.col("id")))]

    def run(batches):
        claim(_words)
        held = words.value
        for part in _parts(batches):
            ok = lets_through(held, *[part.column(k).to_numpy().astype(np.uint64) for k in (1, 2)])
            part = part.filter(pa.array(ok))
            ids, texts = part.column(0), [t or "" for t in part.column(3).to_pylist()]
            for a, b in slices(texts):
                sets = [shingles(t) for t in texts[a:b]]
                own, sets = ids.slice(a, b - a).filter(pa.array([len(s) > 0 for s in sets])), [s for s in sets if len(s)]
                sig = [r.tobytes() for r in signatures(sets)]
                yield pa.RecordBatch.from_arrays([own, pa.array(sig, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary()),
                                                  pa.array([int(_mix(s).sum().view(np.int64)) for s in sets], pa.int64())], names=["id", "sig", "shingles", "k1"])

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.select("id", *bit, "text").mapInArrow(run, "id long, sig binary, shingles binary, k1 long")


def _block(n: int | Column) -> Column:
    return F.pmod(F.xxhash64("id"), n).cast("int")


def _blocks(classes: Column, most: int, shingles: Column) -> Column:
    """Into how many blocks so many classes with so many shingles go: at most `most` classes and SHINGLES shingles each, on average."""
    return F.ceil(F.greatest(classes / most, F.coalesce(shingles, F.lit(0)) / SHINGLES)).cast("int")


def find_links(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, more: DataFrame) -> DataFrame:
    """Components (node, label) of classes (id, sig) by their links and those of more (u, v); classes linked with nothing are left out."""
    spark = docs.sparkSession
    posts = postings(classes, spark.sparkContext.broadcast(sketch(classes)))
    leaders = posts.groupBy("token").agg(F.count("*").alias("n"), F.max(F.struct("central", "id")).alias("best"))
    leaders = cut(leaders.where("n > 1").select("token", F.col("best.id").alias("leader")))
    cells = cut(posts.join(leaders, "token").groupBy("leader", "id").agg(F.max("size").alias("size")))
    large = cut(cells.groupBy("leader").agg(_blocks(F.count("*"), CHUNK, F.sum("size")).alias("_chunks")).where("_chunks > 1"))
    parts = cells.join(large, "leader", "left").withColumn("chunks", F.coalesce("_chunks", F.lit(1)))
    at = F.when(F.col("id") == F.col("leader"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(_block(F.col("chunks"))))
    parts = parts.select("leader", "chunks", "id", "size", F.explode(at).alias("chunk"))
    hopeful = cut(parts.join(classes.select("id", "sig"), "id").groupBy("leader", "chunk").applyInArrow(_hopeful, _HOPEFUL))
    sets = cut(_sets_of(docs, hopeful.select("id").distinct(), id_col, text_col).dropDuplicates(["id", "k1"]).drop("k1"))
    links = cut(hopeful.join(sets, "id").groupBy("leader", "chunk").applyInArrow(_link_part, _LINKS))
    labels = components(links.unionByName(more))
    if large.isEmpty():
        return labels
    return _across(hopeful, sets, labels)


def _across(hopeful: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Components once the parts of each large cell are compared with each other.

    Rows of every pair that is left include a class outside the leader's component (minor). Minor classes go in blocks of ACROSS
    or SHINGLES to each part of their cell, as large; the classes of a part go to each block.
    """
    members = hopeful.where("chunks > 1").select("leader", "id", "size").distinct()
    members = members.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    members = cut(members)
    own = members.where(F.col("id") == F.col("leader")).select("leader", F.col("label").alias("_own"))
    members = cut(members.join(cut(own), "leader").withColumn("minor", F.col("label") != F.col("_own")).drop("_own"))
    blocks = members.groupBy("leader").agg(_blocks(F.count_if("minor"), ACROSS, F.sum(F.when(F.col("minor"), F.col("size")))).alias("blocks"), _blocks(F.count("*"), ACROSS, F.sum("size")).alias("chunks"))
    blocks = cut(blocks.where("blocks > 0"))
    rows = members.join(blocks, "leader")
    minors = rows.where("minor").select("leader", "id", "label", F.lit(True).alias("minor"), _block(F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    others = rows.select("leader", "id", "label", F.lit(False).alias("minor"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), _block(F.col("chunks")).alias("chunk"))
    more = minors.unionByName(others).join(sets, "id").groupBy("leader", "block", "chunk").applyInArrow(_link_blocks, _LINKS)
    more = cut(more)
    if more.isEmpty():
        return labels
    return components(more.unionByName(labels.select(F.col("node").alias("u"), F.col("label").alias("v"))))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id (smallest id reachable by links) and kept (the row has that id) of each row of docs."""
    docs = docs.withColumn(id_col, F.col(id_col).cast("long"))
    all_rows = cut(describe(docs, id_col, text_col))
    full = all_rows.where("n > 0 and id is not null")
    classes = cut(full.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.first("sig").alias("sig"), F.first("n").alias("n")))
    # ids with several texts: linked with the class of each
    several = full.groupBy("id").agg(F.min(F.struct("k1", "k2")).alias("a"), F.max(F.struct("k1", "k2")).alias("b")).where("a <> b").select("id")
    own = full.join(cut(several), "id").select(F.col("id").alias("u"), "k1", "k2").distinct()
    labels = find_links(docs, classes, id_col, text_col, cut(own.join(classes, ["k1", "k2"]).select("u", F.col("id").alias("v"))))
    named = cut(classes.select("k1", "k2", F.col("id").alias("_rep")).join(labels, F.col("_rep") == F.col("node"), "left").select("k1", "k2", F.coalesce("label", "_rep").alias("_c")))
    out = all_rows.select("id", "n", F.when(F.col("n") > 0, F.col("k1")).alias("k1"), F.when(F.col("n") > 0, F.col("k2")).alias("k2")).join(named, ["k1", "k2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("_c", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def op9_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
