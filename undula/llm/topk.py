"""Exact top-k inner products over an impact-ordered, score-at-a-time index.

Vectors are dealt into parts, and each part into blocks. A block's index holds its
non-zero components as postings: segments of one dimension and one quantised impact
(LEVELS steps of absolute value), highest impact first. Segments are walked in that
order; each adds its postings to the accumulators of its vectors, for all queries of a
group at once. What is still to come for a vector is at most |query| x |unprocessed
components|, which bounds its score from both sides: a vector whose upper bound is
below a score that k others are known to reach is proven out. Walking stops when the
vectors not proven out cost less to score exactly than the postings that are left, and
they are scored exactly then. Only proofs exclude a vector, so the result is exact
whatever the data; on hostile data all postings are walked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 24
BLOCK = 4096
#: Components of a part's vectors, queries a group: the bounds of what one task holds.
PART_VALUES = 1 << 19
GROUP = 2048
#: Queries whose accumulators are held at once.
TILE = 128
#: Vectors scored exactly before the walk, for a first score that k others reach.
SEED = 512
#: Bounds are looked at after so large a share of the postings, and after each further one.
FIRST, STRIDE = 0.4, 0.1
#: Cost of scoring a component of a possible member, in postings walked.
RESCORE = 3

_PART = "query_id long, query_key long, copies long, vec_id long, score long"


class Block:
    """The index of some vectors of one dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, kind: type):
        self.ids, self.vectors = ids, vectors
        size = np.abs(vectors)
        step = max(1, -(-int(size.max(initial=0) + 1) // LEVELS))
        vec, dim = np.nonzero(vectors)
        level = size[vec, dim] // step
        order = np.lexsort((vec, dim, -level))  # segments by descending impact
        self.vec, self.dim, level = vec[order], dim[order], level[order]
        self.value = vectors[self.vec, self.dim].astype(kind)[:, None]
        new = np.flatnonzero(np.diff(level, prepend=-1) | np.diff(self.dim, prepend=-1))
        self.segments = list(zip(new.tolist(), np.append(new[1:], len(vec)).tolist(), self.dim[new].tolist(), strict=True))
        # length of what is unprocessed of each vector, after the last segment of each level
        left, walked = (vectors.astype(float) ** 2).sum(1), 0
        self.left: dict[int, np.ndarray] = {}
        for place in np.flatnonzero(np.diff(level[new], append=-1)).tolist():
            hi = self.segments[place][1]
            left = left - np.bincount(self.vec[walked:hi], self.value[walked:hi, 0].astype(float) ** 2, len(ids))
            self.left[place], walked = np.sqrt(np.maximum(left, 0) * (1 + 1e-9) + 1e-6), hi

    def search(self, queries: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vector, score) of all that can be among a query's best; ``least[q]``: a score that enough others are known to reach."""
        found = [self._walk(queries[at : at + TILE], least[at : at + TILE]) for at in range(0, len(queries), TILE)]
        q = np.concatenate([q + i * TILE for i, (q, _) in enumerate(found)])
        v = np.concatenate([v for _, v in found])
        score, step = np.empty(len(q), np.int64), max(1, (1 << 22) // max(1, queries.shape[1]))
        for at in range(0, len(q), step):
            part = slice(at, at + step)
            score[part] = (queries[q[part]] * self.vectors[v[part]]).sum(1)
        return q, v, score

    def _walk(self, queries: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, vector) pairs that aren't proven out."""
        n, kind, total = len(self.ids), self.value.dtype.type, len(self.vec)
        columns = np.ascontiguousarray(queries.T.astype(kind))
        acc = np.zeros((n, len(queries)), kind)  # whole numbers, exact in `kind`
        wide = np.float64 if kind is np.int64 else kind
        norm = (np.sqrt((queries.astype(float) ** 2).sum(1)) * (1 + 1e-5)).astype(wide)
        floor = np.nextafter(least.astype(wide), wide(-np.inf)) - wide(1e-3)
        maybe, look = np.ones((n, len(queries)), bool), FIRST * total
        for place, (lo, hi, dim) in enumerate(self.segments):
            acc[self.vec[lo:hi]] += self.value[lo:hi] * columns[dim]
            if place in self.left and (hi >= look or hi == total):
                look = hi + STRIDE * total
                maybe = acc + self.left[place].astype(wide)[:, None] * norm >= floor
                if maybe.sum() * self.vectors.shape[1] * RESCORE <= (total - hi) * len(queries):
                    break
        v, q = np.nonzero(maybe)
        return q, v


def _best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best: by score, then smaller id."""
    order = np.lexsort((ids, -score, q))
    sorted_q = q[order]
    first = np.searchsorted(sorted_q, sorted_q)
    return order[np.arange(len(order)) - first < k]


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).reshape(len(column), dims)


def _own_rows(wanted: np.ndarray, own: np.ndarray, ids: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Place of one row with each query's id and vector among rows sorted by id (-1: in another part)."""
    lo, hi = np.searchsorted(ids, own), np.searchsorted(ids, own, "right")
    out = np.full(len(own), -1)
    for q in np.flatnonzero(hi > lo):
        same = np.flatnonzero((data[lo[q] : hi[q]] == wanted[q]).all(1))
        if len(same):
            out[q] = lo[q] + same[0]
    return out


def _kind(queries: np.ndarray, vectors: np.ndarray) -> type:
    """The narrowest type in which every partial sum is a whole number."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, vectors.shape[1])
    return np.float32 if most < 2**24 else np.float64 if most < 2**52 else np.int64


def _search(k: int):
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        empty = pa.table({x: pa.array([], pa.int64()) for x in ("query_id", "query_key", "copies", "vec_id", "score")})
        if not queries.num_rows or not vectors.num_rows:
            return empty
        dims = vectors["dims"][0].as_py()
        wanted, own = _matrix(queries["v"], dims), queries["vec_id"].to_numpy()
        ids = vectors["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, data = ids[order], _matrix(vectors["v"], dims)[order]
        mine, kind = _own_rows(wanted, own, ids, data), _kind(wanted, data)
        held = [np.zeros(0, np.int64)] * 3
        least = np.full(len(own), -np.inf)
        if min(SEED, len(ids)) > k:  # one may be the query's own row
            for at in range(0, len(own), TILE):
                seed = wanted[at : at + TILE].astype(np.float64 if kind is np.float32 else kind) @ data[:SEED].T
                least[at : at + TILE] = np.partition(seed, -k - 1, axis=1)[:, -k - 1]
        for lo in range(0, len(ids), BLOCK):
            block = Block(ids[lo : lo + BLOCK], data[lo : lo + BLOCK], kind)
            q, v, score = block.search(wanted, least)
            keep = mine[q] != v + lo
            held = [np.concatenate(x) for x in zip(held, (q[keep], block.ids[v[keep]], score[keep]), strict=True)]
            top = _best(*held, k)
            held = [x[top] for x in held]
            q, first, n = np.unique(held[0], return_index=True, return_counts=True)
            full = n == k
            least[q[full]] = np.maximum(least[q[full]], held[2][first[full] + k - 1])
        return pa.table({"query_id": own[held[0]], "query_key": queries["key"].to_numpy()[held[0]], "copies": queries["copies"].to_numpy()[held[0]], "vec_id": held[1], "score": held[2]})

    return run


def quantised(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component; null where a component is null or not finite, or the vector is null."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(vector.isNotNull() & fine, F.transform(x, lambda v: F.floor(v * factor).cast("long")))


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "v") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest inner products.

    Both tables hold whole-number vectors (array<bigint>) with an id. Ties go to the
    smaller id. A query finds every row but its own: one row with its id and vector is
    left out. Other rows with its id are found like any others, and a query row that
    occurs n times is answered n times. Fewer than k rows give fewer results. Rows
    with a null id or vector take no part; vectors of another dimension than the
    query's aren't its candidates. Columns besides the two are ignored; an empty table
    gives no rows.
    """

    def rows(df: DataFrame) -> DataFrame:
        df = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v"))
        return df.where("vec_id is not null and v is not null").withColumn("dims", F.size("v"))

    queries, vectors = rows(queries).groupBy("vec_id", "v", "dims").agg(F.count(F.lit(1)).alias("copies")), rows(vectors)
    held = vectors.agg(F.count(F.lit(1)).alias("n"), F.max("dims").alias("dims")).first()
    parts = max(1, -(-held.n * max(1, held.dims or 0) // PART_VALUES))
    groups = max(1, -(-queries.count() // GROUP))
    # repeated ids are spread by their vectors
    part, group = F.pmod(F.xxhash64("vec_id", "v"), F.lit(parts)), F.pmod(F.xxhash64("vec_id", "v"), F.lit(groups))
    # every part meets every group: a task holds one of each, whatever the sizes
    left = queries.withColumn("key", F.xxhash64("vec_id", "v")).withColumn("g", group).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = vectors.withColumn("p", part).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    cell = [F.col("p").cast("long"), F.col("g").cast("long"), F.col("dims")]
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(_search(k), _PART)
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("query_id", "rank", "vec_id", "score")
