"""Nearest neighbours by Euclidean distance between feature arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Numbers in a block of queries and in one of references: the bounds of what a task holds.
QUERY_VALUES, REFERENCE_VALUES = 1 << 16, 1 << 18


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, float).reshape(len(column), -1)


def _search(k: int):
    """The k nearest references of a block to each query of another: one product, then exact distances of what can be among them."""

    def run(queries: pa.Table, references: pa.Table) -> pa.Table:
        at, to = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        far = [np.zeros(0)]
        if queries.num_rows and references.num_rows:
            q, r = _matrix(queries["features"]), _matrix(references["features"])
            ids = np.unique(np.asarray(references["id"].to_pylist()), return_inverse=True)[1]  # places in the order of ids
            size, most = (q**2).sum(1), (r**2).sum(1)
            for lo in range(0, len(q), 256):
                part = slice(lo, lo + 256)
                near = size[part, None] + most[None] - 2 * (q[part] @ r.T)
                slack = 1e-9 * (size[part, None] + most.max()) + 1e-300
                if len(r) > k:
                    near = near - slack <= np.partition(near, k - 1, axis=1)[:, k - 1 : k] + slack
                i, j = np.nonzero(near if len(r) > k else np.ones(near.shape, bool))
                d = np.sqrt(((q[part][i] - r[j]) ** 2).sum(1))
                order = np.lexsort((ids[j], d, i))
                order = order[np.arange(len(order)) - np.searchsorted(i[order], i[order]) < k]
                at.append(i[order] + lo)
                to.append(j[order])
                far.append(d[order])
        at, to = np.concatenate(at), np.concatenate(to)
        return pa.table({"case_id": queries["id"].take(pa.array(at)), "neighbour_id": references["id"].take(pa.array(to)), "distance": np.concatenate(far)})

    return run


def nearest_neighbours(queries: DataFrame, references: DataFrame, k: int = 5, features: str = "features", case: str = "case_id") -> DataFrame:
    """(case_id, rank, neighbour_id, distance): ties go to the smaller id.

    Both sides are dealt into blocks of a bounded number of values, and every two blocks
    of one dimension meet in a task, which passes on k rows a query. Rows with a null id or
    null features take no part; a query has no neighbours of another dimension.
    """

    def rows(df: DataFrame) -> DataFrame:
        df = df.select(F.col(case).alias("id"), F.col(features).cast("array<double>").alias("features")).where("id is not null and features is not null")
        return df.withColumn("dims", F.size("features"))

    def blocks(df: DataFrame, values: int) -> int:
        held = df.agg(F.count(F.lit(1)).alias("n"), F.max("dims").alias("dims")).first()
        return max(1, -(-held.n * max(1, held.dims or 0) // values))

    q, r = rows(queries), rows(references)
    kinds = q.schema["id"].dataType, r.schema["id"].dataType
    groups, parts = blocks(q, QUERY_VALUES), blocks(r, REFERENCE_VALUES)
    q = q.withColumn("g", F.pmod(F.xxhash64("id", F.lit("query")), F.lit(groups))).withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    r = r.withColumn("p", F.pmod(F.xxhash64("id"), F.lit(parts))).withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    out = StructType([StructField("case_id", kinds[0]), StructField("neighbour_id", kinds[1]), StructField("distance", DoubleType())])
    found = q.groupBy("dims", "p", "g").cogroup(r.groupBy("dims", "p", "g")).applyInArrow(_search(k), out)
    order = Window.partitionBy("case_id").orderBy("distance", "neighbour_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("case_id", "rank", "neighbour_id", "distance")
