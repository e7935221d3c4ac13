"""Merkle manifest of a dataset: a leaf per row, a tree per group, and a tree over the groups.

Digests are lowercase hex sha256 and are hashed as hex text. A tree takes every ``FANOUT``
consecutive nodes of a level (the last run may be shorter, even a single node) to one node of
the next, until one is left.

Checkpoint and recompute: of all levels only every ``STEP``-th is written, as rows that hold
one aligned subtree each (at most ``FANOUT ** STEP`` nodes). Proofs are made from the top down.
Each task takes a stored subtree, hashes its missing interior nodes again, emits the siblings of
every stored node below the proof of its root, and drops the interior.

No group is in one task: rows are dealt by range of (group, id), numbered inside their range
and shifted by the rows of the ranges before.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from quillspark.llm.common import Scratch

#: Consecutive nodes that become one.
FANOUT = 2
#: Levels between two that are written: subtrees of 2**9 nodes.
STEP = 9

#: A level of a proof: digests of the run's other nodes, joined, left and right of the node.
SIBLINGS = ArrayType(StructType([StructField("left", StringType()), StructField("right", StringType())]))
GROUP = "g"


def leaf_digest(values: Sequence[Column]) -> Column:
    """Hex sha256 of values: ``-`` for null, else UTF-8 byte count, ``:`` and the value, joined."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def node(children: Sequence[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


def levels_of(digests: list[str], rise: int, fanout: int) -> list[list[str]]:
    """The nodes of an aligned subtree, level by level, ``rise`` levels up."""
    out = [digests]
    for _ in range(rise):
        below = out[-1]
        out.append([node(below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return out


def siblings(nodes: list[str], fanout: int) -> tuple[list[str], list[str]]:
    """For every node of a level, what stands left and right of it in its run."""
    runs = [nodes[i - i % fanout : i - i % fanout + fanout] for i in range(len(nodes))]
    left = ["".join(run[: i % fanout]) for i, run in enumerate(runs)]
    return left, ["".join(run[i % fanout + 1 :]) for i, run in enumerate(runs)]


def rise_of(height: int, level: int, step: int) -> int:
    """Levels that a subtree stored at ``level`` climbs in a tree of that height."""
    return max(0, min(step, height - level))


def height_of(n: Column, fanout: int) -> Column:
    """Levels above the leaves: the least h with fanout ** h >= n."""
    powers = [fanout**h for h in range(1, 64) if fanout**h < 1 << 63]
    return F.size(F.filter(F.array(*[F.lit(p) for p in [1, *powers]]), lambda p: p < n))


def numbered(leaves: DataFrame, scratch: Scratch) -> DataFrame:
    """``leaves`` (g, id, leaf, …) with pos, the row's place in its group by (id, leaf), and n, the group's rows.

    Null groups and ids come first. Rows alike in all of these share what follows from them,
    so it does not matter which comes first; their place in the file only spreads them.
    """
    keys = [F.col(c).asc_nulls_first() for c in (GROUP, "id", "leaf")]
    spread = leaves.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(*keys, "at")
    dealt = scratch.keep(spread.drop("at").withColumn("part", F.spark_partition_id()), "dealt")
    scratch.release(leaves)
    # groups are ranges too, so this has about as many rows as there are groups and ranges together
    sums = dealt.groupBy(GROUP, "part").agg(F.count(F.lit(1)).alias("rows"))
    whole = Window.partitionBy(GROUP)
    upto = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col(GROUP).alias("of"), F.col("part").alias("in"), F.coalesce(F.sum("rows").over(upto), F.lit(0)).alias("before"),
        F.sum("rows").over(whole).alias("n"),
    )
    inside = dealt.withColumn("no", F.row_number().over(Window.partitionBy(GROUP, "part").orderBy(*keys[1:])) - 1)
    out = inside.join(sums, F.col(GROUP).eqNullSafe(F.col("of")) & (F.col("part") == F.col("in")))
    return out.withColumn("pos", F.col("before") + F.col("no")).drop("of", "in", "before", "no", "part")


def subtrees(nodes: DataFrame, size: int, *carried: str) -> DataFrame:
    """(g, block, height, nodes): every ``size`` consecutive nodes (g, pos, height, leaf, …) as one row, in order."""
    held = F.collect_list(F.struct("pos", "leaf", *carried))
    grouped = nodes.groupBy(GROUP, F.floor(F.col("pos") / size).cast("long").alias("block"))
    return grouped.agg(F.max("height").alias("height"), F.array_sort(held).alias("nodes"))


class Forest:
    """Trees over groups of nodes, of which every ``step``-th level is stored.

    ``nodes`` has g, pos, n and leaf, and the columns ``carried`` of the leaves.
    """

    def __init__(self, nodes: DataFrame, scratch: Scratch, name: str, fanout: int, step: int, carried: Sequence[str] = ()):
        self.scratch, self.name, self.fanout, self.step = scratch, name, fanout, step
        self.carried, self.stored = list(carried), []
        level = nodes.withColumn("height", height_of(F.col("n"), fanout)).drop("n")
        while True:
            more = self.carried if not self.stored else []
            kept = scratch.keep(subtrees(level, fanout**step, *more), f"{name}-level-{len(self.stored) * step}")
            top = kept.agg(F.max("height")).first()[0] if not self.stored else top  # the driver learns one number
            self.stored.append(kept)
            level = self._roots(kept, (len(self.stored) - 1) * step)
            if top is None or top <= len(self.stored) * step:
                break
        self.tops = scratch.keep(level.select(GROUP, "leaf"), f"{name}-tops")

    def _roots(self, stored: DataFrame, level: int) -> DataFrame:
        """The node above each stored subtree, as a node of the next stored level."""
        fanout, step = self.fanout, self.step

        def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rises = [rise_of(h, level, step) for h in b.column("height").to_pylist()]
                digests = [[x["leaf"] for x in row] for row in b.column("nodes").to_pylist()]
                tops = [levels_of(d, r, fanout)[-1][0] for d, r in zip(digests, rises, strict=True)]
                columns = [b.column(GROUP), b.column("block"), b.column("height"), pa.array(tops, pa.string())]
                yield pa.record_batch(columns, names=[GROUP, "pos", "height", "leaf"])

        slim = stored.select(GROUP, "block", "height", F.transform("nodes", lambda x: F.struct(x["leaf"].alias("leaf"))).alias("nodes"))
        return slim.mapInArrow(climb, "g string, pos long, height int, leaf string")

    def proofs(self, above: DataFrame) -> DataFrame:
        """(g, pos, leaf, carried …, proof) of every leaf; ``above`` (g, above) is the proof of each group's top.

        Levels from the top down; only the proofs of stored nodes are handed on.
        """
        got = above.select(F.col(GROUP).alias("of"), F.lit(0).cast("long").alias("to"), F.col("above"))
        for k in reversed(range(len(self.stored))):
            stored = self.stored[k]
            joined = stored.join(got, F.col(GROUP).eqNullSafe(F.col("of")) & (F.col("block") == F.col("to"))).drop("of", "to")
            made = self._extract(joined, k * self.step)
            if k:
                got = made.select(F.col(GROUP).alias("of"), F.col("pos").alias("to"), F.col("proof").alias("above"))
        return made

    def _extract(self, joined: DataFrame, level: int) -> DataFrame:
        fanout, step, strings = self.fanout, self.step, pa.string()
        nodes = joined.schema["nodes"].dataType.elementType

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):  # a stored subtree at a time; its interior is gone after it
                    row = b.slice(i, 1)
                    inner = row.column("nodes").flatten()
                    digests = inner.field("leaf").to_pylist()
                    rise = rise_of(row.column("height")[0].as_py(), level, step)
                    over = row.column("above").flatten()
                    left, right, at = [], [], []
                    for h, nodes_at in enumerate(levels_of(digests, rise, fanout)[:rise]):
                        at.append(len(left) + np.arange(len(digests)) // fanout**h)
                        l, r = siblings(nodes_at, fanout)
                        left += l
                        right += r
                    at += [np.full(len(digests), len(left) + j) for j in range(len(over))]
                    left += over.field("left").to_pylist()
                    right += over.field("right").to_pylist()
                    picks = pa.array(np.stack(at, 1).ravel() if at else np.zeros(0, np.int64))
                    pairs = pa.StructArray.from_arrays(
                        [pa.array(left, strings).take(picks), pa.array(right, strings).take(picks)], names=["left", "right"]
                    )
                    proof = pa.ListArray.from_arrays(np.arange(len(digests) + 1, dtype=np.int32) * len(at), pairs)
                    group = pa.array([row.column(GROUP)[0].as_py()] * len(digests), strings)
                    yield pa.record_batch([group, *inner.flatten(), proof], names=[GROUP, *inner.type.names, "proof"])

        names = [StructField(GROUP, StringType()), *nodes.fields, StructField("proof", SIBLINGS)]
        return joined.select(GROUP, "height", "nodes", "above").mapInArrow(emit, StructType(names))


def manifest(
    docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id",
    group_col: str = "lang", keep: Sequence[Column] = (), fanout: int = FANOUT, step: int = STEP,
) -> DataFrame:
    """leaf, subroot, root, proof and a struct ``kept`` for every row.

    A leaf is the digest of the row's ``columns``. Leaves of a group ascend by id (null first,
    equal ids by leaf); a null group is a group, the first. Subroots ascend by group, bytewise.
    ``proof`` holds for every level from the leaf to the root what stands left and right of the
    node in its run, both empty for a node that is alone. The expressions ``keep`` are computed
    on the rows of ``docs`` and carried along in ``kept``; no other column is looked at and names
    of ``docs`` clash with nothing. Equal rows are leaves of their own. An empty table has no rows.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    rows = docs.select(
        F.col(group_col).cast("string").alias(GROUP), F.col(id_col).alias("id"), leaf_digest([F.col(c) for c in columns]).alias("leaf"),
        F.struct(*(keep or [F.col(id_col)])).alias("kept"),
    )
    leaves = scratch.keep(rows, "leaves")
    trees = Forest(numbered(leaves, scratch), scratch, "rows", fanout, step, ["kept"])

    tops = scratch.keep(trees.tops.select(F.lit(None).cast("string").alias(GROUP), F.col(GROUP).alias("id"), "leaf"), "subroots")
    over = Forest(numbered(tops, scratch), scratch, "groups", fanout, step, ["id"])
    none = over.tops.select(GROUP, F.array().cast(SIBLINGS).alias("above"))
    groups = scratch.keep(over.proofs(none).select(F.col("id").alias(GROUP), F.col("leaf").alias("subroot"), F.col("proof").alias("above")), "above")

    root = over.tops.first()  # one digest; none for an empty table
    made = trees.proofs(groups.select(GROUP, "above")).select(GROUP, "leaf", "proof", "kept")
    named = groups.select(F.col(GROUP).alias("of"), "subroot", F.lit(root and root["leaf"]).cast("string").alias("root"))
    return made.join(named, F.col(GROUP).eqNullSafe(F.col("of"))).select("leaf", "subroot", "root", "proof", "kept")


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda at, s: F.sha2(F.concat(s["left"], at, s["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """Hex sha256 of a proof's digests, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def audit(docs: DataFrame, altered: Column, change: str = "n_chars", **options) -> DataFrame:
    """Proves every row of ``docs`` against the manifest, with ``change`` one larger in rows that are ``altered``.

    doc_id, leaf, subroot, root, proof_sha256 (all of the rows as they are), folded_root (from the
    leaf as altered and the original proof) and verified. A null ``change`` stays null, and a null
    ``altered`` alters nothing, so such rows verify.
    """
    columns = options.get("columns", ("doc_id", "source", "lang", "n_chars", "text"))
    id_col = options.get("id_col", "doc_id")
    other = leaf_digest([F.col(c) + 1 if c == change else F.col(c) for c in columns])
    keep = [F.col(id_col).alias("doc_id"), F.when(altered, other).alias("other")]
    out = manifest(docs, keep=keep, **options)
    folded = fold(F.coalesce("kept.other", "leaf"), F.col("proof"))
    return out.select(
        "kept.doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
