"""Exact nearest rows by cosine, without a cross join.

Vectors are put into cells (nearest of a bounded number of pivots), cells into blocks of
bounded size. A first pass ranks each row inside its own block, which gives an upper
bound for its k-th distance. Blocks in the order of their cells make tiles of bounded size; a
second pass brings a tile of queries together with every tile in which a cell can, by the
triangle inequality on angles, still hold something nearer for one of them. Inside such a pair
of tiles the same bound is asked per query and cell. Products are made in single precision and
only those that can be among the k best are made again in double precision. Rows are compared
as numpy matrices inside tasks; only the k best of a row leave a task, never the pairs, and a
row is sent once to every tile at most, not to every block.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.binding import once
from quillspark.functions.hashing import draw, draw32
from quillspark.functions.vectors import dot, normalised
from quillspark.session import materialise

BLOCK_ROWS = 2048
MAX_PIVOTS = 256
#: Rows of a tile, about: what one task holds of either side.
TILE_ROWS = 32_768
#: Products made at a time.
PRODUCTS = 1 << 20
SLACK = 1e-4  # radians; above the angle error of similarities rounded to 10 places
DIGITS = 10


def _block_keys(rows: pd.DataFrame) -> np.ndarray:
    return rows["cell"].to_numpy("int64") * (1 << 32) + rows["block"].to_numpy("int64")


class _Best:
    """The k nearest found so far of some queries; candidates are offered in parts."""

    def __init__(self, queries: pd.DataFrame, k: int, kth: np.ndarray | None, labels: np.ndarray | None):
        self.k, self.labels = k, labels
        self.id, self.v = queries["id"].to_numpy("int64"), np.stack(queries["v"].to_numpy())
        self.single = self.v.astype(np.float32)
        self.block = _block_keys(queries) if kth is not None else None
        self.kth = np.full(len(queries), -np.inf) if kth is None else kth.copy()
        self.sim, self.peer = np.full((len(queries), k), -np.inf), np.zeros((len(queries), k), np.int64)
        # single precision errs by this much at most on unit vectors
        self.error = (self.v.shape[1] + 8) * 1.2e-7

    def offer(self, at: np.ndarray, p: dict) -> None:
        """Points ``p`` (id, v, single, labels, block) to the queries ``at``."""
        step = max(1, PRODUCTS // len(p["id"]))
        for i in range(0, len(at), step):
            self._offer(at[i : i + step], p)

    def _offer(self, at: np.ndarray, p: dict) -> None:
        s = self.single[at] @ p["single"].T
        least, size = self.kth[at] - self.error, len(p["id"])
        other = None if self.labels is None else self.labels[at][:, None] != p["labels"][None, :]
        new = np.isneginf(least)
        if new.any() and size > self.k:  # no bound yet: the k-th of what may count here
            mine = at[new]
            part = np.where(self.id[mine][:, None] == p["id"][None, :], -np.inf, s[new])
            if self.block is not None:
                part[self.block[mine][:, None] == p["block"][None, :]] = -np.inf
            if other is not None:
                part[~other[new]] = -np.inf
            least[new] = np.partition(part, size - self.k, axis=1)[:, size - self.k] - 2 * self.error
        hit = s >= least.astype(np.float32)[:, None]
        if other is not None:
            hit &= other
        i, j = np.nonzero(hit)
        i = at[i]
        free = self.id[i] != p["id"][j]
        if self.block is not None:
            free &= self.block[i] != p["block"][j]  # a row has met its own block
        i, j = i[free], j[free]
        sims = np.round(np.einsum("ij,ij->i", self.v[i], p["v"][j]), DIGITS)
        near = np.isfinite(sims) & (sims >= self.kth[i])
        if near.any():
            self._merge(i[near], p["id"][j[near]], sims[near])

    def _merge(self, i: np.ndarray, peer: np.ndarray, sim: np.ndarray) -> None:
        k, mine = self.k, np.unique(i)
        i = np.concatenate([np.repeat(mine, k), i])
        peer = np.concatenate([self.peer[mine].ravel(), peer])
        sim = np.concatenate([self.sim[mine].ravel(), sim])
        order = np.lexsort((peer, -sim, i))
        i, peer, sim = i[order], peer[order], sim[order]
        # every query brings k places, so a run of a query is k long at least
        first = np.searchsorted(i, mine)[:, None] + np.arange(k)
        self.peer[mine], self.sim[mine] = peer[first], sim[first]
        self.kth[mine] = np.maximum(self.kth[mine], self.sim[mine, -1])

    def frame(self) -> pd.DataFrame:
        found = np.isfinite(self.sim)
        return pd.DataFrame({"id": self.id[np.nonzero(found)[0]], "peer": self.peer[found], "sim": self.sim[found]})


def _points(rows: pd.DataFrame, labels: np.ndarray | None, blocks: bool) -> dict:
    v = np.stack(rows["v"].to_numpy())
    return {
        "id": rows["id"].to_numpy("int64"), "v": v, "single": v.astype(np.float32), "labels": labels,
        "block": _block_keys(rows) if blocks else None,
    }


FOUND = "id bigint, peer bigint, sim double"
BLOCK = ["scope", "cell", "block"]


def _own_block_pass(points: DataFrame, k: int, other_label: bool) -> DataFrame:
    """Rank every row inside its own block."""

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        labels = pd.factorize(rows["label"])[0] if other_label else None
        best = _Best(rows, k, None, labels)
        best.offer(np.arange(len(rows)), _points(rows, labels, False))
        return best.frame()

    return points.groupBy(*BLOCK).applyInPandas(compare, FOUND)


def _outside(angles: np.ndarray, lo, hi) -> np.ndarray:
    """How far, at least, a row at these angles from a pivot is from the ring [lo, hi] around it."""
    return np.maximum(np.maximum(angles - hi, lo - angles), 0.0)


def _angles(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(v @ pivots.T, -1.0, 1.0))


def _limit(kth: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(kth, -1.0, 1.0)) + SLACK


def _tile_pass(queries: DataFrame, points: DataFrame, k: int, other_label: bool, pivots: np.ndarray) -> DataFrame:
    """Compare the queries and points of equal (scope, mine, tile), cell by cell of the points."""

    def compare(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if q.empty or p.empty:
            return pd.DataFrame({"id": [], "peer": [], "sim": []})
        q, p = q.reset_index(drop=True), p.sort_values("cell", kind="stable").reset_index(drop=True)
        ql = pl = None
        if other_label:
            codes = pd.factorize(pd.concat([q["label"], p["label"]]))[0]
            ql, pl = codes[: len(q)], codes[len(q) :]
        best = _Best(q, k, q["kth"].fillna(-np.inf).to_numpy(), ql)
        every = _points(p, pl, True)
        cells, starts = np.unique(p["cell"].to_numpy(), return_index=True)
        rings = p["to_cell"].to_numpy()
        for cell, a, b in zip(cells, starts, [*starts[1:], len(p)]):
            to_pivot = _angles(best.v, pivots[cell : cell + 1])[:, 0]
            for i in range(a, b, BLOCK_ROWS):
                part = slice(i, min(b, i + BLOCK_ROWS))
                far = _outside(to_pivot, rings[part].min(), rings[part].max())
                at = np.flatnonzero(far <= _limit(best.kth))
                if len(at):
                    best.offer(at, {n: None if x is None else x[part] for n, x in every.items()})
        return best.frame()

    by = ["scope", "mine", "tile"]
    return queries.groupBy(*by).cogroup(points.groupBy(*by)).applyInPandas(compare, FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("id").orderBy(F.desc("sim"), "peer")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest_rows(
    df: DataFrame,
    row_id: str,
    vector: str,
    label: str | None = None,
    scope: str = "any",
    k: int = 2,
    block_rows: int = BLOCK_ROWS,
    max_pivots: int = MAX_PIVOTS,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """(id, rank, peer, sim) of the k most similar rows, the row itself excluded.

    scope "same" / "other" restricts peers to equal / different ``label``; "any" does not.
    Equal similarities (10 places) rank by id.
    """
    if scope not in ("same", "other", "any"):
        raise ValueError(scope)
    lab = F.col(label).cast("string") if label else F.lit("")
    other = scope == "other"
    base = df.select(
        F.col(row_id).cast("bigint").alias("id"),
        F.coalesce(lab, F.lit("\u0000")).alias("label"),
        normalised(F.col(vector)).alias("v"),
    ).withColumn("scope", F.col("label") if scope == "same" else F.lit(""))

    # A bounded random sample of vectors serves as pivots (at most max_pivots rows).
    n = base.count()
    quarter = max(1, block_rows // 4)
    wanted = min(max_pivots, max(1, math.isqrt(n // quarter)))
    sample = base.orderBy(draw("pivot", F.col("id")), "id").limit(wanted).select("v").toPandas()
    pivots = np.stack(sample["v"].to_numpy()) if len(sample) else np.zeros((1, 1))

    # one scope has at most max_pivots cells, so its cell tables may be broadcast; with a
    # scope per label their number follows the labels, and joins stay adaptive
    sized = F.broadcast if scope != "same" else (lambda d: d)
    if scope == "same":
        sizes = base.groupBy("scope").agg(F.count(F.lit(1)).alias("n_scope"))
        counted = base.join(sizes, "scope")
    else:
        counted = base.withColumn("n_scope", F.lit(n))

    def locate(batches):
        for b in batches:
            if b.empty:
                continue
            cos = np.clip(np.stack(b["v"].to_numpy()) @ pivots.T, -1.0, 1.0)
            in_scope = b["n_scope"].to_numpy()
            # a scope uses as many pivots as a table of its size would
            cos[np.arange(len(pivots))[None, :] >= np.maximum(1, np.sqrt(in_scope // quarter))[:, None]] = -1.0 - SLACK
            cell = cos.argmax(axis=1)
            small = in_scope <= block_rows
            b = b.drop(columns="n_scope")
            b["cell"] = np.where(small, -1, cell).astype("int32")
            b["to_cell"] = np.where(small, 0.0, np.arccos(np.clip(cos[np.arange(len(b)), cell], -1.0, 1.0)))
            yield b

    placed = counted.select("id", "label", "v", "scope", "n_scope").mapInPandas(
        locate, "id bigint, label string, v array<double>, scope string, cell int, to_cell double"
    )
    placed = materialise(placed, "cells")

    # Per cell: rows, blocks, the ring of angles its members lie in, and its place in the scope.
    cells = placed.groupBy("scope", "cell").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("to_cell").alias("lo"),
        F.max("to_cell").alias("hi"),
    ).withColumn("blocks", F.ceil(F.col("n") / F.lit(block_rows)).cast("int"))
    before = Window.partitionBy("scope").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0)))
    tile = lambda block: F.floor((F.col("at") + block * block_rows) / F.lit(tile_rows)).cast("int")
    blocked = placed.join(sized(cells.select("scope", "cell", "blocks", "at")), ["scope", "cell"]).withColumn(
        "block", (draw32("block", F.col("id")) % F.col("blocks")).cast("int")
    ).withColumn("tile", tile(F.col("block"))).drop("blocks", "at")

    first = _top(_own_block_pass(blocked.select("scope", "cell", "block", "id", "label", "v"), k, other), k)
    if n <= block_rows:
        return first  # one block per scope: the first pass has seen every pair
    first = materialise(first, "first")

    # Cells of a scope as short lists: at most max_pivots cells with the tiles they lie in.
    ends = cells.filter("cell >= 0").select("scope", "cell", "lo", "hi", tile(F.lit(0)).alias("a"), tile(F.col("blocks") - 1).alias("b"))
    held = F.sort_array(F.collect_list(F.struct("cell", "lo", "hi", "a", "b")))
    parts = ["cell", "lo", "hi", "a", "b"]
    maps = ends.groupBy("scope").agg(held.alias("cells")).select("scope", *[F.col(f"cells.{c}").alias(f"all_{c}") for c in parts])
    bound = first.groupBy("id").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("sim")).alias("kth")
    )
    asking = blocked.join(bound, "id", "left").join(sized(maps), "scope")

    def probe(batches):
        for b in batches:
            if b.empty:
                continue
            v, limit = np.stack(b["v"].to_numpy()), _limit(b["kth"].fillna(-1.0).to_numpy())
            tiles = [None] * len(b)
            for rows in b.groupby("scope", sort=False).indices.values():
                ring = {c: b[f"all_{c}"].iat[rows[0]] for c in parts}
                near = _outside(_angles(v[rows], pivots[ring["cell"]]), ring["lo"], ring["hi"]) <= limit[rows][:, None]
                wanted = np.zeros((len(rows), ring["b"].max() + 1), bool)
                for c, (a, z) in enumerate(zip(ring["a"], ring["b"])):
                    wanted[:, a : z + 1] |= near[:, c, None]
                for row, w in zip(rows, wanted):
                    tiles[row] = np.flatnonzero(w)
            b = b.drop(columns=[f"all_{c}" for c in parts])
            b["tiles"] = tiles
            yield b

    columns = ["scope", "cell", "block", "id", "label", "v"]
    asked = asking.select(*columns, F.col("tile").alias("mine"), "kth", *[f"all_{c}" for c in parts]).mapInPandas(
        probe,
        "scope string, cell int, block int, id bigint, label string, v array<double>, mine int, kth double, tiles array<int>",
    )
    asked = materialise(asked, "asked").withColumn("tile", F.explode("tiles")).drop("tiles")
    # a pair of tiles gets the points once, however many of its queries ask for them
    pairs = asked.select("scope", "mine", "tile").distinct()
    offered = blocked.filter("cell >= 0").select(*columns, "to_cell", "tile").join(pairs, ["scope", "tile"])
    fresh = offered.select(*[F.col(c).alias(c) for c in ("mine", "tile", "to_cell", *columns)])
    second = _tile_pass(asked, fresh, k, other, pivots)
    return _top(first.select("id", "peer", "sim").unionByName(second), k)


def with_fallback(df: DataFrame, row_id: str, near: DataFrame) -> DataFrame:
    """Two peers per row: a lone peer counts twice, a row without peers stands in itself."""
    wide = near.groupBy("id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("peer"))).alias("p1"),
        F.max(F.when(F.col("rank") == 2, F.col("peer"))).alias("p2"),
    )
    me = F.col(row_id)
    return df.select(me.alias("id")).join(wide, "id", "left").select(
        "id",
        F.coalesce("p1", "id").alias("peer_1"),
        F.coalesce("p2", "p1", "id").alias("peer_2"),
    )


def peers_wide(near: DataFrame) -> DataFrame:
    return near.groupBy("id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("peer"))).alias("peer_1"),
        F.max(F.when(F.col("rank") == 2, F.col("peer"))).alias("peer_2"),
    )


def fetch_prompts(peers: DataFrame, prompts: DataFrame, row_id: str, prompt: str | Sequence[str]) -> DataFrame:
    """(id, mix_const_1, mix_const_2): the prompts of both peers.

    With a list of columns that prompts are made of, the structs of them, as sets: an id that is repeated has
    several, of which the greatest prompt counts.
    """
    long = peers.select(
        "id", F.posexplode(F.array("peer_1", "peer_2")).alias("pos", "peer")
    )
    lent = F.col(prompt) if isinstance(prompt, str) else F.struct(*prompt)
    got = long.join(prompts.select(F.col(row_id).alias("peer"), lent.alias("_p")), "peer")
    pick = F.max if isinstance(prompt, str) else F.collect_set
    return got.groupBy("id").agg(
        pick(F.when(F.col("pos") == 0, F.col("_p"))).alias("mix_const_1"),
        pick(F.when(F.col("pos") == 1, F.col("_p"))).alias("mix_const_2"),
    )


def rank_keywords(
    rows: DataFrame,
    row_id: str,
    keywords: str,
    label: str,
    word_vectors: DataFrame,
    label_vectors: DataFrame,
) -> DataFrame:
    """Keep each row's keywords nearest to its label: max(min(3, n), int(0.3 n)) of n.

    ``word_vectors(word, wv)``, ``label_vectors(label, lv)``. Cosines are computed once
    per distinct (word, label); only scores travel back to the rows.
    """
    exploded = rows.select(
        F.col(row_id).alias("id"), F.col(label).alias("label"), F.explode(once(keywords)).alias("word")
    )
    pairs = exploded.select("word", "label").distinct()
    # unit vectors once per word and label, one product per pair
    of_word = word_vectors.select("word", normalised(F.col("wv")).alias("wv"))
    of_label = label_vectors.select("label", normalised(F.col("lv")).alias("lv"))
    scored = (
        pairs.join(of_word, "word").join(of_label, "label")
        .select("word", "label", F.round(dot(F.col("wv"), F.col("lv")), 8).alias("score"))
    )
    # rows that are alike take less room side by side; the filter keeps the sort
    dealt = exploded.sortWithinPartitions("word", "label", "id").filter(F.spark_partition_id() >= 0)
    # a score of 8 places as a whole number: the same order in half the bytes
    order = F.when(F.isnan("score"), F.lit(2**31 - 1)).otherwise(-F.rint(F.col("score") * 10**8)).cast("int")
    ranked = dealt.join(scored, ["word", "label"]).groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct(order.alias("s"), F.col("word")))).alias("_k")
    )
    n = F.size("_k")
    keep = F.greatest(F.least(F.lit(3), n), F.floor(F.lit(0.3) * n).cast("int"))
    return ranked.select("id", F.transform(F.slice("_k", F.lit(1), keep), lambda s: s["word"]).alias("top_kws"))
