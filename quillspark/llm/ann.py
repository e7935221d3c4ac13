"""Approximate nearest neighbours: stable projections, kd-trees and a chi-square stop.

Projected to M dimensions by a Gaussian (2-stable) matrix, the squared distance of two
vectors at distance d is d*d times a chi-square variable of M degrees. Every block of
candidates holds its rows in a kd-tree over the projections. A query meets the leaves by
their distance from its projection and verifies their rows on the original vectors, until
no unseen row can be nearer than the k-th found with probability above 1 - SURE: an unseen
row lies at projected distance r or more, which a row at the k-th distance d would do with
probability 1 - F(r*r / (d*d)) only.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.blocks import search, usable

M = 8
SURE = 0.95
LEAF = 32
STEP = 4


@lru_cache(maxsize=8)
def projection(dim: int) -> np.ndarray:
    return np.random.default_rng(20).standard_normal((dim, M))


def chi_square(x: np.ndarray) -> np.ndarray:
    """Distribution function for an even number of degrees, M."""
    half = np.minimum(x / 2, 700)
    return 1 - np.exp(-half) * sum(half**i / math.factorial(i) for i in range(M // 2))


def kd_leaves(p: np.ndarray) -> list[np.ndarray]:
    """Row numbers by leaf: halved at the median of the widest dimension."""
    todo, leaves = [np.arange(len(p))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            leaves.append(rows)
            continue
        x = p[rows]
        wide = int((x.max(axis=0) - x.min(axis=0)).argmax())
        half = np.argpartition(x[:, wide], len(rows) // 2)
        todo += [rows[half[: len(rows) // 2]], rows[half[len(rows) // 2 :]]]
    return leaves


def near_rows(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int):
    to = projection(q.shape[1])
    p = c @ to
    leaves = kd_leaves(p)
    low = np.array([p[rows].min(axis=0) for rows in leaves])
    high = np.array([p[rows].max(axis=0) for rows in leaves])
    out_q, out_c, out_s = [], [], []
    for own, x, y in zip(qid, q, q @ to, strict=True):
        gap = np.maximum(np.maximum(low - y, y - high), 0)
        gap = np.einsum("ij,ij->i", gap, gap)
        order = np.argsort(gap, kind="stable")
        ids, dist = np.zeros(0, np.int64), np.zeros(0)
        for at in range(0, len(order), STEP):
            if len(dist) >= k:
                kth = dist[k - 1] ** 2
                if kth == 0 and gap[order[at]] > 0 or kth and chi_square(gap[order[at]] / kth) >= SURE:
                    break
            rows = np.concatenate([leaves[i] for i in order[at : at + STEP]])
            rows = rows[cid[rows] != own]
            diff = c[rows] - x
            ids = np.append(ids, cid[rows])
            dist = np.append(dist, np.sqrt((diff * diff).sum(axis=1)))
            best = np.lexsort((ids, dist))[:k]
            ids, dist = ids[best], dist[best]
        out_q.append(np.full(len(ids), own))
        out_c.append(ids)
        out_s.append(dist)
    return np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_s)


def neighbours(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for every query.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows of the
    same dimension but those of the query's own id, and every one is indexed. ``score`` is
    the Euclidean distance of the original vectors. A true neighbour is missed with
    probability below 1 - SURE. Vectors that are null, empty or zero or hold null or
    non-finite components, and rows without id, take no part; of repeated rows one does.
    Ties go to the smaller id. Nothing is returned for an empty table.
    """
    rows = usable(vectors, id_col, vector_col, nonzero=True)
    return search(rows, F.col("vec_id") % every == 0, k, near_rows, "double", F.asc)
