"""Greedy merge of features in MI order.

Each feature joins the group of its key that gains most, else opens a new one, so step t of a
key needs step t - 1. The features of a key are taken in rounds of at most about ``POSTINGS``
(document, feature) pairs; a feature with more has a round of its own. For a round, documents
enter as counts of (class, groups it is in, features of the round it has), and one task per
key takes the steps of the round one after the other. The counts of a group and of a feature
give those of their union less what they share, so a step reads only documents of its feature and the
groups these are in; nothing is held for a group and a document that is not in it.
Between rounds the groups are in the shared folder. The driver learns the class totals and
the number of rounds, no more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.mining import class_totals
from quillspark.session import materialise

POSTINGS = 1 << 20
GROUPS = "key string, grp int, counts array<long>, mi double, turns array<int>"


def merge_greedily(feats: DataFrame, docs: DataFrame, chosen: DataFrame, k: int = 1000) -> DataFrame:
    """(key, grp, feature, mi): groups of the k best features of ``chosen`` (feature, key, mi).

    ``feats`` is (doc, y, feature), ``docs`` (doc, y). An offer that lowers the information of
    its group counts against it; where all do, the feature opens a group. ``mi`` is the
    information of the whole group.
    """
    spark = feats.sparkSession
    totals = [(r["y"], r["n_y"]) for r in class_totals(docs).orderBy("y").collect()]
    kind = class_totals(docs).schema["y"].dataType.simpleString()
    classes = spark.createDataFrame([(y, i) for i, (y, _) in enumerate(totals)], f"y {kind}, cls int")
    best = chosen.orderBy(F.desc("mi"), "feature").limit(k).select("feature", "key", "mi")
    turn = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("mi"), "feature"))
    queue = materialise(best.select("feature", "key", turn.alias("turn")), "queue")
    # at most k features and a row per class
    held = feats.select("doc", "y", "feature").distinct().join(F.broadcast(queue), "feature").join(F.broadcast(classes), "y")
    held = materialise(held.select("key", "turn", "doc", "cls"), "held")
    rounds = materialise(_rounds(queue, held), "rounds")
    n = rounds.agg(F.coalesce(F.max("round"), F.lit(0))).first()[0]
    merge = _merged([n_y for _, n_y in totals])
    state = materialise(
        queue.select("key").distinct().select(
            "key", F.lit(0).alias("grp"), F.array_repeat(F.lit(0).cast("long"), len(totals)).alias("counts"), F.lit(0.0).alias("mi"),
            F.array().cast("array<int>").alias("turns"),
        ),
        "groups",
    )
    for step in range(1, n + 1):
        now = rounds.filter(F.col("round") == step).select("key", "turn")
        rows = _documents(held, now, state)
        state = materialise(
            state.groupBy("key").cogroup(rows.groupBy("key")).applyInArrow(merge, GROUPS), "groups"
        )
    placed = state.select("key", "grp", F.explode("turns").alias("turn"), "mi")
    return placed.join(queue, ["key", "turn"]).select("key", "grp", "feature", "mi")


def _rounds(queue: DataFrame, held: DataFrame) -> DataFrame:
    """(key, turn, round): turns of a key cut where their pairs pass the bound."""
    sizes = held.groupBy("key", "turn").agg(F.count(F.lit(1)).alias("n"))
    sized = queue.select("key", "turn").join(sizes, ["key", "turn"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    alone = F.when(F.col("n") > POSTINGS, 1).otherwise(0)
    upto = Window.partitionBy("key").orderBy("turn")
    cut = sized.withColumn("alone", alone).withColumn("stretch", 2 * F.sum("alone").over(upto) - F.col("alone"))
    inside = F.sum("n").over(Window.partitionBy("key", "stretch").orderBy("turn")) - F.col("n")
    part = F.when(F.col("alone") == 1, 0).otherwise(F.floor(inside / POSTINGS))
    order = Window.partitionBy("key").orderBy("stretch", "part")
    return cut.withColumn("part", part).select("key", "turn", F.dense_rank().over(order).alias("round"))


def _documents(held: DataFrame, now: DataFrame, state: DataFrame) -> DataFrame:
    """(key, cls, groups, turns, n): documents with features of this round, counted by what they have."""
    has = held.join(F.broadcast(now), ["key", "turn"]).groupBy("key", "doc", "cls").agg(F.array_sort(F.collect_set("turn")).alias("turns"))
    before = state.select("key", "grp", F.explode("turns").alias("turn"))
    member = held.join(F.broadcast(before), ["key", "turn"]).groupBy("key", "doc", "cls").agg(F.array_sort(F.collect_set("grp")).alias("groups"))
    both = has.join(member, ["key", "doc", "cls"], "left").withColumn("groups", F.coalesce("groups", F.array().cast("array<int>")))
    return both.groupBy("key", "cls", "groups", "turns").agg(F.count(F.lit(1)).alias("n"))


def information(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Information of every row of present counts by class; add-one, as ``mining.mutual_information``."""
    whole = totals.sum() + 2.0 * len(totals)
    plogp = lambda cells: cells / whole * np.log(cells / whole)
    present, absent = counts + 1.0, totals - counts + 1.0
    joint = plogp(present).sum(-1) + plogp(absent).sum(-1)
    return joint - plogp(present.sum(-1)) - plogp(absent.sum(-1)) - plogp(totals + 2.0).sum()


def spans_of(row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end of every row's stretch in a sorted list of row numbers."""
    return np.searchsorted(row, np.arange(n)), np.searchsorted(row, np.arange(n), side="right")


def shared_counts(own: np.ndarray, groups_of: list[list[int]], weight: np.ndarray, n: int) -> np.ndarray:
    """By group and class, the documents of ``own`` that the group has already."""
    which = [groups_of[r] for r in own.tolist()]
    out = np.zeros((n, weight.shape[1]), np.int64)
    np.add.at(out, [g for gs in which for g in gs], np.repeat(weight[own], list(map(len, which)), axis=0))
    return out


def chosen_group(gained: np.ndarray, before: np.ndarray) -> int | None:
    """The group that a feature goes to: of those that it improves the most informative one, else
    the first that it leaves as informative, else none. Of equals the lowest number."""
    better = np.flatnonzero(gained > before)
    if len(better):
        return int(better[gained[better].argmax()])
    same = np.flatnonzero(gained == before)
    return int(same[0]) if len(same) else None


def _merged(totals: list[int]):
    """One round of one key: its groups and its documents give its groups."""
    totals = np.array(totals, np.int64)

    def fn(groups: pa.Table, rows: pa.Table) -> pa.Table:
        groups = groups.sort_by("grp")
        key = groups.column("key")[0].as_py()
        counts = np.array(groups.column("counts").to_pylist(), np.int64).reshape(len(groups), len(totals))
        mi = groups.column("mi").to_numpy().copy()
        turns = groups.column("turns").to_pylist()
        cls, n = rows.column("cls").to_numpy(), rows.column("n").to_numpy()
        weight = np.zeros((len(rows), len(totals)), np.int64)
        weight[np.arange(len(rows)), cls] = n
        flat = lambda name: (
            np.repeat(np.arange(len(rows)), np.diff(c.offsets.to_numpy())) if len(c := rows.column(name).combine_chunks()) else np.zeros(0, np.int64),
            c.flatten().to_numpy(),
        )
        row, grp = flat("groups")
        groups_of = [grp[i:j].tolist() for i, j in zip(*spans_of(row, len(rows)), strict=True)]  # by document row
        row, turn = flat("turns")
        order = np.argsort(turn, kind="stable")
        row, turn = row[order], turn[order]
        cut = np.flatnonzero(np.diff(turn)) + 1
        for own, which in zip(np.split(row, cut), turn[np.append(0, cut)] if len(turn) else [], strict=False):
            mine = weight[own].sum(axis=0)
            gained = information(counts + mine - shared_counts(own, groups_of, weight, len(counts)), totals)
            g = chosen_group(gained, mi)
            if g is None:
                g = len(mi)
                counts, mi = np.vstack([counts, np.zeros_like(mine)]), np.append(mi, 0.0)
                turns.append([])
            fresh = [r for r in own.tolist() if g not in groups_of[r]]
            counts[g] += weight[fresh].sum(axis=0)
            mi[g] = information(counts[g], totals)
            turns[g].append(int(which))
            for r in fresh:
                groups_of[r].append(g)
        return pa.table(
            [
                pa.array([key] * len(mi), pa.string()), pa.array(range(len(mi)), pa.int32()), pa.array(counts.tolist(), pa.list_(pa.int64())),
                pa.array(mi, pa.float64()), pa.array(turns, pa.list_(pa.int32())),
            ],
            names=["key", "grp", "counts", "mi", "turns"],
        )

    return fn
