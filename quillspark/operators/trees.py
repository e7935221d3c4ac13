"""Parse trees in bracket notation, one row per node.

Reading a bracket string is the one step that needs Python per row; it runs on Arrow
batches and everything after it is DataFrame work.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: What is known of a node, and its type.
NODE = {
    "pos": "int", "root": "string", "template": "string", "span": "string", "depth": "int",
    "production": "string", "flat": "string", "subtree": "string", "children": "int",
}
#: Trees read before their nodes go back to Spark.
TREES = 256


def _squeeze(s: str) -> str:
    # pieces hold no white space, so that only blanks can meet
    return re.sub(r"\s+", " ", s) if "  " in s else s


def _sides(span: str) -> tuple[str, str]:
    cut = span.rfind("/")
    return span[:cut], span[cut + 1 :]


def _open_end(span: str) -> str:
    bare = span.strip()
    if bare.endswith("/"):
        return bare + "ϵ"
    if bare.startswith("/"):
        return "ϵ" + bare
    return span


class _Open:
    """A node that is not closed yet, with what its children gave."""

    __slots__ = ("children", "depth", "flats", "full", "leaves", "names", "root", "spans", "templates", "texts")

    def __init__(self) -> None:
        self.root, self.children, self.depth, self.full = "", 0, 0, False
        self.names, self.templates, self.spans, self.texts, self.leaves, self.flats = [], [], [], [], [], []


def read_nodes(text: str | None, paired: bool, fields: Sequence[str] = tuple(NODE)) -> dict[str, list] | None:
    """The named fields of all nodes, children first, as one list a field; None when the string
    is no single well-formed tree.

    Paired leaves look like left/right; spans then join each side on its own and an
    empty side reads ϵ.
    """
    if text is None:
        return None
    out = {f: [] for f in fields}
    production, template, span, subtree, flat = (f in out for f in ("production", "template", "span", "subtree", "flat"))
    stack: list[_Open] = []
    node, pos, closed, after_open = None, 0, False, False
    for piece in text.replace("(", " ( ").replace(")", " ) ").split():
        if closed:
            return None
        if piece == "(":
            node = _Open()
            stack.append(node)
            after_open = True
            continue
        if node is None:
            return None
        if piece != ")":
            if after_open:
                node.root, after_open = piece, False
                continue
            node.children += 1
            node.full = True
            if production:
                node.names.append(repr(piece))
            if template:
                node.templates.append("*")
            if span:
                node.spans.append(piece)
            if subtree:
                node.texts.append(piece)
            if flat:
                node.leaves.append(piece)
                node.flats.append(None)
            continue
        after_open = False
        stack.pop()
        up = stack[-1] if stack else None
        got = {"pos": pos, "root": node.root, "depth": node.depth + 1, "children": node.children}
        if production:
            got["production"] = f"({', '.join(node.names)}{',' if len(node.names) == 1 else ''})"
        if template:
            got["template"] = f"({' '.join([node.root, *node.templates])})"
        if span:
            got["span"] = _joined(node.spans, paired).replace("_", "")
        if subtree:
            got["subtree"] = f"({' '.join([node.root, *node.texts])})"
        if flat:
            two = node.flats[:2]
            got["flat"] = f"({node.root} {two[0]} {two[1]})" if len(two) == 2 and None not in two else ""
        for f, values in out.items():
            values.append(got[f])
        pos += 1
        if up is None:
            closed = True
            continue
        up.children += 1
        up.full |= node.full
        up.depth = max(up.depth, node.depth + 1)
        if production:
            up.names.append(node.root)
        if template:
            up.templates.append(got["template"])
        if span:
            up.spans.append(got["span"])
        if subtree:
            up.texts.append(got["subtree"])
        if flat:
            up.flats.append(f"({node.root} {' '.join(node.leaves)})")
            up.leaves += node.leaves
        node = up
    if not closed:
        return None
    if not node.full:
        return {f: [] for f in fields}  # no leaf, no spans
    if span:
        out["span"] = [_squeeze(_open_end(s) if paired else s) for s in out["span"]]
    return out


def _joined(spans: list[str], paired: bool) -> str:
    if not paired:
        return " ".join(spans)
    sides = [_sides(s) for s in spans]
    return " ".join(a for a, _ in sides) + "/" + " ".join(b for _, b in sides)


def tree_rows(
    df: DataFrame, tree: str, paired: bool = False, keep: list[str] | None = None, fields: Sequence[str] = tuple(NODE)
) -> DataFrame:
    """One row per node of each tree: keep… and ``fields``, all of pos, root, template, span,
    depth, production, flat, subtree, children unless fewer are named. Unreadable trees give no row."""
    keep = keep if keep is not None else [c for c in df.columns if c != tree]
    fields = list(fields)
    kinds = {"int": IntegerType(), "string": StringType()}
    held = df.select(*keep, F.col(tree).cast("string").alias(tree))
    schema = StructType([*held.schema.fields[: len(keep)], *(StructField(f, kinds[NODE[f]]) for f in fields)])
    arrow = {"int": pa.int32(), "string": pa.string()}
    none = {f: [] for f in fields}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TREES):
                batch = whole.slice(at, TREES)
                read = [read_nodes(text, paired, fields) or none for text in batch.column(len(keep)).to_pylist()]
                rows = np.repeat(np.arange(len(read)), [len(nodes[fields[0]]) for nodes in read])
                found = [pa.array([v for nodes in read for v in nodes[f]], arrow[NODE[f]]) for f in fields]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(rows)) for i in range(len(keep))), *found], names=schema.names)

    return held.mapInArrow(read, schema)


def subtree_features(nodes: DataFrame, doc: str, max_depth: int | None = None) -> DataFrame:
    """Distinct (doc, template, span), optionally of bounded template depth."""
    kept = nodes.filter(F.col("depth") <= max_depth) if max_depth is not None else nodes
    return kept.select(F.col(doc).alias("doc"), "root", "template", "span").distinct()


def production_features(nodes: DataFrame, doc: str) -> DataFrame:
    """Distinct (doc, lhs, rhs)."""
    return nodes.select(F.col(doc).alias("doc"), F.col("root").alias("lhs"), F.col("production").alias("rhs")).distinct()


def production_tree_features(nodes: DataFrame, doc: str) -> DataFrame:
    """Distinct (doc, production, flat): nodes with at least two children, together with
    their first two children flattened to labels and leaves."""
    two = nodes.filter("children > 1")
    name = F.concat(F.lit("'"), F.col("root"), F.lit("' '"), F.col("production"), F.lit("'"))
    return two.select(F.col(doc).alias("doc"), name.alias("production"), "flat").distinct()


def root_label(template: Column) -> Column:
    return F.when(
        template.contains(" "), F.substring_index(F.substr(template, F.lit(2)), " ", 1)
    ).otherwise("")
