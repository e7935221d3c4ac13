"""Filter interaction audit: what every order of a set of filters would remove, and where.

A document is a mask of the filters it fails. Documents are counted by (part, mask) first, so
that the orders meet at most 32 cells of a part. Every cell is folded across the array of all
orders by higher-order functions: ``aggregate`` walks an order with the filters seen so far,
``transform`` does so for all 120 orders, and the cell's counts weigh the 600 resulting structs.
The cells of a part are then added up element by element.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.binding import let
from quillspark.llm.common import Scratch, words_of

FILTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def own_failures(text: Column) -> Column:
    """Mask of the filters that a text fails by itself (A to D); an empty text has no words and fails A."""

    def mask(words: Column) -> Column:
        n = F.size(words)
        fails = {
            "A": n < 100,
            "B": F.size(F.array_distinct(words)) * 100 < n * 80,
            "C": F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.char_length(text) * 10,
            "D": text.rlike("[#$%&*|]"),
        }
        out = F.lit(0)
        for letter, failed in fails.items():
            out = out + F.when(failed, bit(letter)).otherwise(0)
        return out

    return let(words_of(text), mask)


def failure_cells(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part by the filters they fail."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        own_failures(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("same"),
    )
    # rows equal in all of these are counted before anything else is shuffled by less
    rows = scratch.keep(rows.groupBy("doc_id", "part", "mask", "same").agg(F.count(F.lit(1)).alias("n")), "rows")

    # a text passes E where its id is the smallest of that text; the join is dealt by (text, id),
    # so that copies spread, and rows without id, which meet nothing, are dealt by their text
    first = rows.groupBy("same").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    rows = rows.join(first, ["same", "doc_id"], "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    rows = rows.withColumn("mask", F.col("mask") + F.when(copy, bit("E")).otherwise(0))

    # (max of nothing is null: such a label is not 1)
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("of"))
    known = known.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = known.withColumn("salt", F.lit(0).cast("long"))
    rows = rows.withColumn("by", F.when(F.col("doc_id").isNull(), F.xxhash64("same")).otherwise(F.lit(0).cast("long")))
    rows = rows.join(known, (F.col("doc_id") == F.col("of")) & (F.col("by") == F.col("salt")), "left")
    weigh = lambda c: F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c)
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), weigh("good"), weigh("toxic"))


def orders_of(letters: str) -> list[list[int]]:
    return [[bit(x) for x in order] for order in permutations(letters)]


def weighed_steps(cell: Column, orders: Column) -> Column:
    """The cell's counts at every step of every order: 600 structs, order by order."""
    mask, n = cell["mask"], cell["n"]
    zero = F.lit(0).cast("long")

    def walk(order: Column) -> Column:
        def step(state: Column, this: Column) -> Column:
            fails = mask.bitwiseAND(this) != 0
            gone = mask.bitwiseAND(state["seen"]) != 0
            removed = fails & ~gone
            counts = F.struct(
                F.when(~fails & ~gone, n).otherwise(zero).alias("kept"),
                F.when(removed, n).otherwise(zero).alias("removed"),
                F.when(fails & gone, n).otherwise(zero).alias("redundant"),
                F.when(mask == this, n).otherwise(zero).alias("unique_fails"),
                F.when(removed, cell["good"]).otherwise(zero).alias("good_lost"),
                F.when(removed, cell["toxic"]).otherwise(zero).alias("toxic_lost"),
                this.alias("filter"),
            )
            return F.struct(state["seen"].bitwiseOR(this).alias("seen"), F.concat(state["out"], F.array(counts)).alias("out"))

        shape = ", ".join([*(f"{c}: bigint" for c in COUNTS), "filter: int"])
        start = F.struct(F.lit(0).alias("seen"), F.array().cast(f"array<struct<{shape}>>").alias("out"))
        return F.aggregate(order, start, step, lambda s: s["out"])

    return F.flatten(F.transform(orders, walk))


def added(a: Column, b: Column) -> Column:
    """Two arrays of counts, added element by element."""
    return F.zip_with(a, b, lambda x, y: F.struct(*[(x[c] + y[c]).alias(c) for c in COUNTS], x["filter"].alias("filter")))


def filter_audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
) -> DataFrame:
    """part, filter_order, step and the counts of that step: 600 rows for every value of ``part_col``.

    Filters: A fewer than 100 words; B under 80 % distinct words; C over 10 % capitals A-Z; D a
    sign of #$%&*|; E a text that a row of smaller id has too, anywhere in the table. ``kept``
    are documents that pass all filters up to the step, ``removed`` those that this one takes,
    ``redundant`` those that fail it but are gone, ``unique_fails`` those that fail nothing
    else, ``good_lost`` and ``toxic_lost`` the removed with quality = 1 and toxic = 1 (if any
    label of their id says so), ``shapley`` what the step's filter removes in all orders together.

    A null text is empty, a null part is "". A row without id is no copy and makes none, and has
    no label; rows of one id are documents of their own, and no copies of each other. Other
    columns are not looked at. An empty table has no part and no rows.
    """
    scratch = Scratch(docs.sparkSession, "audit")
    cells = failure_cells(docs, labels, scratch, id_col, text_col, part_col)
    orders = F.lit(orders_of(FILTERS))
    # at most 32 cells a part
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    first, rest = F.col("cells")[0], F.slice("cells", 2, 1 << len(FILTERS))
    sums = F.aggregate(rest, weighed_steps(first, orders), lambda acc, cell: added(acc, weighed_steps(cell, orders)))
    parts = scratch.keep(parts.select("part", sums.alias("sums")), "sums")

    total = lambda x: F.aggregate(
        F.col("sums"), F.lit(0).cast("long"), lambda s, y: s + F.when(y["filter"] == x, y["removed"]).otherwise(F.lit(0).cast("long"))
    )
    shares = parts.select("part", F.array(*[total(bit(x)) for x in FILTERS]).alias("shares"), F.posexplode("sums").alias("at", "counts"))
    names = F.lit(["".join(o) for o in permutations(FILTERS)])
    order = F.get(names, F.floor(F.col("at") / len(FILTERS)).cast("int"))
    mine = F.log2(F.col("counts.filter")).cast("int")  # a filter's bit gives its place
    return shares.select(
        "part", order.alias("filter_order"), (F.col("at") % len(FILTERS) + 1).alias("step"),
        *[F.col(f"counts.{c}").alias(c) for c in COUNTS], F.get("shares", mine).alias("shapley"),
    )
