"""A stated set of query vectors against all vectors, in pairs of bounded blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one query block and of one candidate block.
QUERIES, CANDIDATES = 1024, 8192
FOUND = "query_id long, vec_id long, score {}"


def usable(vectors: DataFrame, id_col: str, vector_col: str, nonzero: bool) -> DataFrame:
    """(vec_id, dim, v): vectors without null or non-finite components; repeated rows once."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).dropna()
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.filter((F.size("v") > 0) & ~F.exists("v", bad))
    if nonzero:
        rows = rows.filter(F.exists("v", lambda x: x != 0))
    return rows.withColumn("dim", F.size("v")).dropDuplicates(["vec_id", "v"])


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim)


def search(
    rows: DataFrame, is_query: Column, k: int, best: Callable, kind: str, nearest: Callable[[str], Column]
) -> DataFrame:
    """Top k of every query over all candidate blocks.

    ``best(qid, q, cid, c, k)`` gives at most k rows (query, candidate, score) for each query
    of one block pair. Blocks are dealt by a hash of the id, so that equal vectors spread.
    """
    n, m = rows.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    cs, qs = max(1, -(-n // CANDIDATES)), max(1, -(-m // QUERIES))
    block = lambda count, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(count))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    c = rows.select("dim", block(cs, 1).alias("cb"), every(qs).alias("qb"), "vec_id", "v")
    q = rows.filter(is_query).select("dim", block(qs, 2).alias("qb"), every(cs).alias("cb"), "vec_id", "v")

    def fn(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.int64() if kind == "long" else pa.float64())], names=names)
        dim = left.column("dim")[0].as_py()
        parts = best(
            left.column("vec_id").to_numpy(), matrix(left.column("v"), dim),
            right.column("vec_id").to_numpy(), matrix(right.column("v"), dim), k,
        )
        return pa.table([pa.array(x) for x in parts], names=names)

    keys = ["dim", "qb", "cb"]
    found = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(fn, FOUND.format(kind))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(nearest("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
