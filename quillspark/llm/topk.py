"""Exact top-k by inner product, bounded by multi-resolution segment statistics.

A vector is cut into segments of length l with mean m and deviation s. Within a segment the
product of two vectors is at most l * (m m' + s s'), so distances are bounded from below.
The bound is a product of two short vectors, taken with few long segments first and more
short ones after; what cannot reach the k-th best product known so far goes, and exact
products are computed for the rest. On integers all sums are exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.blocks import search, usable

LEVELS = (8, 16, 32)
SCALE = 64
SLAB = 256
#: Above this share of survivors a whole matrix product is cheaper than gathering pairs.
DENSE = 0.15


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(l) * mean and sqrt(l) * deviation of every segment, side by side."""
    cuts = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    size = np.diff(cuts)
    mean = np.add.reduceat(x, cuts[:-1], axis=1) / size
    spread = np.sqrt(np.maximum(np.add.reduceat(x * x, cuts[:-1], axis=1) / size - mean * mean, 0))
    return np.hstack([mean * np.sqrt(size), spread * np.sqrt(size)])


def best_products(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int):
    order = np.argsort(cid, kind="stable")
    cid, c = cid[order], c[order]
    stats = [(statistics(q, s), statistics(c, s)) for s in LEVELS if s < q.shape[1]]
    out_q, out_c, out_s = [], [], []
    for at in range(0, len(qid), SLAB):
        ids, x = qid[at : at + SLAB], q[at : at + SLAB]
        own = ids[:, None] == cid[None, :]
        alive, least = ~own, np.full(len(ids), -np.inf)
        for sq, sc in stats:
            share = alive.mean()
            if share > DENSE:
                bound = sq[at : at + SLAB] @ sc.T
                bound += 1e-6 * (1 + np.abs(bound))
                bound[~alive] = -np.inf
            else:
                i, j = np.nonzero(alive)
                bound = np.full(alive.shape, -np.inf)
                b = np.einsum("ij,ij->i", sq[at + i], sc[j])
                bound[i, j] = b + 1e-6 * (1 + np.abs(b))
            if bound.shape[1] > k:  # exact products of the most promising raise the bar
                top = np.argpartition(-bound, k - 1, axis=1)[:, :k]
                exact = np.einsum("id,ikd->ik", x, c[top])
                exact[~np.take_along_axis(alive, top, axis=1)] = -np.inf
                least = np.maximum(least, exact.min(axis=1))
            alive &= bound >= least[:, None]
        if alive.mean() > DENSE:
            exact = x @ c.T
            exact[~alive] = -np.inf
        else:
            i, j = np.nonzero(alive)
            exact = np.full(alive.shape, -np.inf)
            exact[i, j] = np.einsum("ij,ij->i", x[i], c[j])
        keep = min(k, exact.shape[1])
        kth = -np.partition(-exact, keep - 1, axis=1)[:, keep - 1]
        i, j = np.nonzero((exact >= kth[:, None]) & alive)
        order = np.lexsort((cid[j], -exact[i, j], i))
        i, j = i[order], j[order]
        first = np.searchsorted(i, i)  # candidates of equal products beyond k go by id
        ok = np.arange(len(i)) - first < k
        i, j = i[ok], j[ok]
        out_q.append(ids[i])
        out_c.append(cid[j])
        out_s.append(np.rint(exact[i, j]).astype(np.int64))
    return np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_s)


def top_products(
    vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE
) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of every query.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows of the
    same dimension but those of the query's own id. Components count as floor(scale * x).
    Vectors that are null or empty or hold null or non-finite components, and rows without
    id, take no part; of repeated rows one does. Ties go to the smaller id. Nothing is
    returned for an empty table. Other columns are not looked at.
    """
    rows = usable(vectors, id_col, vector_col, nonzero=False)
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))
    return search(rows, F.col("vec_id") % every == 0, k, best_products, "long", F.desc)
