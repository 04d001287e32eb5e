"""Exact top-k search by a Voronoi kNN join.

Vectors are integers (floor of SCALE times each component), scored by inner product.

1. A sample of rows is drawn by hash of their id; pivots are picked from it one by one, each the farthest from those before, so
   that every cluster gets one and cells stay narrow. Every row belongs to the cell of its nearest pivot; a cell's summary is its
   radius (largest distance to the pivot) and its largest norm.
2. Cells go to groups by the nearest of a few pivots (the first ones picked), so that a group holds about PART rows; larger groups
   are split into parts by the hash of ids, whatever vector or cell their rows share.
3. A query's k-th best score is at least its k-th best among the sample, which are rows themselves. A cell with pivot p, radius r
   and largest norm m holds no score above min(q.p + |q| r, |q| m) (Cauchy-Schwarz), so a query is sent only to groups with a cell
   that can reach its bound. Candidates stay: each is shuffled once, to its own part, and only if a query needs its cell; queries
   are what is replicated.
4. A part is solved locally, cell by cell from the most promising, skipping those that can't reach the k-th best found so far.
   The k best of each part are merged.

Scores are exact integers; bounds only decide what is sent and scored, with a margin for rounding. Bounds on sizes: at most
MOST_PIVOTS pivots and SEEDS times as many sample rows (their vectors, and one summary row for each pivot, reach the driver and
every task); there are about sqrt(rows) pivots below that. Vectors without clusters can't be pruned by any such bound: each query then goes to each part, and all pairs are scored.

Defined cases: vectors that are null or empty, or hold null or non-finite components, take no part; nor do rows without an id.
Repeated equal rows count once. Shorter vectors are taken as followed by zeros. Ties go to the smaller id. A query has fewer than
k rows where there are fewer candidates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import cut, table

SCALE, K = 256, 5
#: sample rows for each pivot, rows of a part, queries of one task, queries scored at once
MOST_PIVOTS, SEEDS, PART, QUERIES, BLOCK = 2048, 4, 8192, 50_000, 512
MARGIN = 1e-6


def usable(v: Column) -> Column:
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))


def integers(column: pa.Array, width: int) -> np.ndarray:
    """A row of whole numbers (as doubles) for each vector."""
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles while they are exact there, else in 64-bit integers."""
    if len(q) and len(x) and np.abs(q).max() * np.abs(x).max() * q.shape[1] >= 2**53:
        return q.astype(np.int64) @ x.astype(np.int64).T
    return (q @ x.T).astype(np.int64)


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def farthest_first(x: np.ndarray, count: int) -> np.ndarray:
    """Places of at most `count` rows, each the farthest from those picked before; equal rows are picked once."""
    picked, distance = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(picked) < count and distance.max() > 0:
        picked.append(int(distance.argmax()))
        distance = np.minimum(distance, ((x - x[picked[-1]]) ** 2).sum(axis=1))
    return np.array(picked)


class Cells:
    """Pivots, the summaries of their cells, and the sample."""

    def __init__(self, ids: np.ndarray, seeds: np.ndarray, count: int, groups: int):
        self.ids, self.seeds = ids, seeds
        self.pivots = seeds[farthest_first(seeds, count)]
        self.square = (self.pivots * self.pivots).sum(axis=1)
        self.group = self._nearest(self.pivots, min(groups, len(self.pivots)))[0]
        pivots = self.pivots
        self.radius, self.norm, self.filled = np.zeros(len(pivots)), np.zeros(len(pivots)), np.zeros(len(pivots), bool)

    def _nearest(self, x: np.ndarray, among: int) -> tuple[np.ndarray, np.ndarray]:
        at, distance = np.zeros(len(x), np.int32), np.zeros(len(x))
        for a in range(0, len(x), 1024):
            part = x[a : a + 1024]
            d = self.square[None, :among] - 2 * part @ self.pivots[:among].T
            own = d.argmin(axis=1)
            at[a : a + 1024] = own
            distance[a : a + 1024] = np.sqrt(((part - self.pivots[own]) ** 2).sum(axis=1))
        return at, distance

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._nearest(x, len(self.pivots))

    def summarise(self, cell: np.ndarray, radius: np.ndarray, norm: np.ndarray) -> None:
        self.radius[cell], self.norm[cell], self.filled[cell] = radius, norm, True

    def most(self, q: np.ndarray) -> np.ndarray:
        """For each query and cell a score that no row of the cell exceeds."""
        size = _norms(q)[:, None]
        bound = np.minimum(q @ self.pivots.T + size * self.radius[None, :], size * self.norm[None, :])
        return np.where(self.filled[None, :], bound + np.abs(bound) * MARGIN + MARGIN, -np.inf)

    def least(self, ids: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
        """A score that each query's k-th best row reaches: its k-th best in the sample."""
        s = np.where(self.ids[None, :] == ids[:, None], -np.inf, _scores(q, self.seeds).astype(float))
        return np.partition(s, -k, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(q), -np.inf)

    def reached(self, ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) pairs: the cells that may hold one of a query's k best."""
        pairs = [np.nonzero(self.most(q[a : a + 256]) >= self.least(ids[a : a + 256], q[a : a + 256], k)[:, None]) for a in range(0, len(q), 256)]
        return np.concatenate([i + 256 * n for n, (i, _) in enumerate(pairs)]), np.concatenate([c for _, c in pairs])


def _distinct(ids: np.ndarray, cell: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of the rows by cell, then id; equal rows once."""
    order = np.lexsort((ids, cell))
    near = np.flatnonzero((ids[order][1:] == ids[order][:-1]) & (cell[order][1:] == cell[order][:-1]))
    keep, seen = np.ones(len(order), bool), set()
    for i in np.union1d(near, near + 1).tolist():
        row = (int(ids[order[i]]), x[order[i]].tobytes())
        keep[i] = row not in seen
        seen.add(row)
    return order[keep]


def solve_part(part: pa.Table, cells: Cells, width: int, k: int) -> tuple[list[np.ndarray], int]:
    """(query_id, vec_id, score) columns of the k best candidates of a part for each of its queries, and the pairs scored."""
    is_query = part.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
    ids, cell, x = part.column("id").to_numpy(), part.column("cell").to_numpy(), integers(part.column("v").combine_chunks(), width)
    order = np.flatnonzero(~is_query)
    order = order[_distinct(ids[order], cell[order], x[order])]
    c_ids, c = ids[order], x[order]
    own, starts = np.unique(cell[order], return_index=True)
    ends = np.r_[starts[1:], len(order)]
    pairs, out = 0, []
    for lo in range(0, int(is_query.sum()) if len(order) else 0, BLOCK):
        at = np.flatnonzero(is_query)[lo : lo + BLOCK]
        q_ids, q = ids[at], x[at]
        least, most = cells.least(q_ids, q, k), cells.most(q)[:, own]
        best, found = np.full((len(q), k), -np.inf), []
        for j in np.argsort(-most.max(axis=0), kind="stable"):
            a, b = starts[j], ends[j]
            rows = np.flatnonzero(most[:, j] >= np.maximum(least, best[:, 0]))
            if not len(rows):
                continue
            s = _scores(q[rows], c[a:b])
            pairs += s.size
            mine = np.where(c_ids[None, a:b] == q_ids[rows][:, None], -np.inf, s.astype(float))
            best[rows] = np.sort(np.partition(np.concatenate([best[rows], mine], axis=1), -k, axis=1)[:, -k:], axis=1)
            i, e = np.nonzero((mine >= best[rows][:, :1]) & (mine > -np.inf))
            found.append((rows[i], c_ids[a:b][e], s[i, e]))
        if found:
            row, vec, score = (np.concatenate(f) for f in zip(*found, strict=True))
            by = np.lexsort((vec, -score, row))
            row, vec, score = row[by], vec[by], score[by]
            first = np.searchsorted(row, np.arange(len(q)))
            top = np.arange(len(row)) - first[row] < k
            out.append((q_ids[row[top]], vec[top], score[top]))
    return [np.concatenate(f) for f in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3, pairs


def voronoi_cells(rows: DataFrame, n: int, width: int) -> tuple[Cells, DataFrame]:
    """Pivots with the summaries of their cells, and the rows with their cell, cut to the shared folder."""
    count = int(min(MOST_PIVOTS, max(2, np.ceil(np.sqrt(n)))))
    picked = rows.orderBy(F.xxhash64("id"), "id").select("id", "v").limit(SEEDS * count).toArrow()
    ids, seeds = picked.column("id").to_numpy(), integers(picked.column("v").combine_chunks(), width)
    at = _distinct(ids, np.zeros(len(ids), np.int32), seeds)
    cells = Cells(ids[at], seeds[at], count, int(max(1, -(-n // PART))))

    def assign(batches):
        for b in batches:
            x = integers(b.column("v"), width)
            cell, d = cells.assign(x)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(d), pa.array(_norms(x))], names=[*b.schema.names, "cell", "d", "norm"])

    kind = rows.schema["v"].dataType.simpleString()
    rows = cut(rows.mapInArrow(assign, f"id long, is_query boolean, v {kind}, cell int, d double, norm double"))
    summary = rows.groupBy("cell").agg(F.max("d").alias("d"), F.max("norm").alias("norm"), F.count("*").alias("n")).toPandas()  # a row for each pivot
    cells.summarise(summary["cell"].to_numpy(), summary["d"].to_numpy(), summary["norm"].to_numpy())
    size = np.bincount(cells.group[summary["cell"].to_numpy()], summary["n"].to_numpy(), minlength=len(cells.group))
    cells.parts = np.maximum(1, -(-size // PART)).astype(int)
    return cells, rows


def route(rows: DataFrame, cells: Cells, width: int, k: int) -> DataFrame:
    """(id, v, group, cells) for each query and each group that it must see, with the cells it may need there."""
    def run(batches):
        for b in batches:
            row, cell = cells.reached(b.column("id").to_numpy(), integers(b.column("v"), width), k) if b.num_rows else (np.empty(0, int), np.empty(0, int))
            group = cells.group[cell]
            order = np.lexsort((cell, group, row))
            row, cell, group = row[order], cell[order], group[order]
            start = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (group[1:] != group[:-1])]) if len(row) else row
            lists = pa.ListArray.from_arrays(pa.array(np.r_[start, len(row)].astype(np.int32)), pa.array(cell.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row[start])), b.column("v").take(pa.array(row[start])), pa.array(group[start].astype(np.int32)), lists], names=["id", "v", "group", "cells"])

    return rows.where("is_query").select("id", "v").distinct().mapInArrow(run, f"id long, v {rows.schema['v'].dataType.simpleString()}, group int, cells array<int>")


def dealt(rows: DataFrame, routes: DataFrame, cells: Cells) -> DataFrame:
    """Candidates and queries with the (group, part, block) they meet in. A cell that no query needs isn't sent at all. Only where
    more than QUERIES queries see a group does it get several blocks of them, to each of which its candidates are copied."""
    spark = rows.sparkSession
    asked = {r["group"]: -(-r["n"] // QUERIES) for r in routes.groupBy("group").agg(F.count("*").alias("n")).collect()}  # at most a row for each pivot
    needed = sorted(r[0] for r in routes.select(F.explode("cells")).distinct().collect())  # the same
    of_cell = F.broadcast(spark.createDataFrame([(c, int(cells.group[c]), int(cells.parts[cells.group[c]]), asked[int(cells.group[c])]) for c in needed], "cell int, group int, parts int, blocks int"))
    of_group = F.broadcast(spark.createDataFrame([(g, int(cells.parts[g]), n) for g, n in sorted(asked.items())], "group int, parts int, blocks int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    candidates = rows.join(of_cell, "cell").select("group", one("parts").alias("part"), every("blocks").alias("block"), F.lit(False).alias("is_query"), "id", "cell", "v")
    queries = routes.join(of_group, "group").select("group", every("parts").alias("part"), one("blocks").alias("block"), F.lit(True).alias("is_query"), "id", F.lit(-1).alias("cell"), "v")
    return candidates.unionByName(queries)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best rows for each row that is_query (a condition on id_col) holds for."""
    v = F.col(vec_col)
    if vectors.select(v).schema[0].dataType.simpleString() != "array<float>":
        v = v.cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("is_query"), v.alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    n, n_queries, width = rows.agg(F.count("*"), F.count_if("is_query"), F.max(F.size("v"))).first()
    if not n_queries:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    cells, rows = voronoi_cells(rows, n, width)
    routes = cut(route(rows, cells, width, k))
    if routes.isEmpty():  # a single row
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def solve(part: pa.Table) -> pa.Table:
        out, _ = solve_part(part, cells, width, k)
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), out, strict=True)})

    solved = dealt(rows, routes, cells).groupBy("group", "part", "block").applyInArrow(solve, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return solved.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_exact_top_k(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


OP10_SQL = """
with v as (select distinct vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
           where vec_id is not null and embedding is not null and len(embedding) > 0
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
      from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
