"""Mixing sources to target weights along a curriculum.

Every source has a target of words. Its documents, in hash order, are taken in whole passes
and one partial pass that ends nearest to the target. When they are seen in training follows
from the source's weight schedule: its share of the mix at time t in [0, 1] is proportional
to 1 + tilt * (2t - 1), so by time t it has asked for target * (t + tilt * (t*t - t)) words.
Inverting that demand at the words taken before a document gives the document's position;
range-sorting by position gives the order of training.

DataFrame functions only. Running sums are taken inside hash buckets of a source and shifted
by the buckets before, so that a hot source spreads over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import Scratch, words_of

MOST = 3
BUCKET_DIGITS = 3


def source_targets(sources: DataFrame, weights: int = 3, most: int = MOST) -> DataFrame:
    """Targets of sources (source, source_size): weights 1..weights by code point, null last.

    Shares of all words by weight; a target stops at ``most`` times its source and the excess
    goes to the others by weight until none is above: the water level L with
    sum(min(most * size, L * weight)) = sum(size). One row per source, sorted once.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = sources.withColumn("no", F.row_number().over(by_name) - 1)
    w = w.withColumn("weight", (F.col("no") % weights + 1).cast("long"))
    w = w.withColumn("total", F.sum("source_size").over(everything))
    order = Window.orderBy(F.col("source_size") * most / F.col("weight"), "no")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("capped", F.coalesce(F.sum(F.col("source_size") * most).over(upto), F.lit(0)))
    w = w.withColumn("open", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    share = (F.col("total") - F.col("capped")).cast("double") / F.col("open")
    # the first source in this order that its cap does not hold sets the level
    w = w.withColumn("share", F.when(F.col("source_size") * most >= share * F.col("weight"), share))
    first = F.first("share", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    level = F.coalesce(first, F.lit(0.0))
    target = F.least((F.col("source_size") * most).cast("double"), level * F.col("weight"))
    return w.select("source", "source_size", target.alias("target"), "no")


def tilt_of(no: Column) -> Column:
    """Slopes of the schedules: falling, level and rising sources, in turn."""
    return (no % 3 - 1).cast("double") * 0.5


def position(share: Column, tilt: Column) -> Column:
    """t with t + tilt * (t*t - t) = share, for a share in [0, 1]."""
    lead = 1 - tilt
    root = F.sqrt(lead * lead + 4 * tilt * share)
    return F.when(tilt == 0, share).otherwise((root - lead) / (2 * tilt))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MOST,
    keep: Sequence[str] = (),
) -> DataFrame:
    """doc_id, source, size, source_size, target, tilt, ahead, copies, taken, position, one row per row of docs.

    ``taken = copies * size`` with at most ``most`` copies. ``ahead`` are the words of the
    source before the document in one pass. ``position`` in [0, 1] is where the document's
    first copy stands; null if it is not taken. A null text or one without
    words has size 0 and is taken not at all; null sources are one source, the last; a null
    id sorts first; equal rows share a position where order cannot tell them apart. Columns
    named in ``keep`` are carried along and break ties.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    size = F.coalesce(F.size(words_of(F.col(text_col).cast("string"))), F.lit(0)).cast("long")
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), *keep)
    mark = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = scratch.keep(sized.withColumn("mark", mark).withColumn("bucket", F.substring("mark", 1, BUCKET_DIGITS)), "rows")

    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0)))
    targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), most=most)
    a, b = starts.alias("a"), targets.alias("b")
    plan = scratch.keep(
        a.join(b, F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.source", "bucket", "start", "source_size", "target", "no"),
        "plan",
    )

    # running sums first, so that a hot source is split by bucket before anything is joined
    inside = Window.partitionBy("source", "bucket").orderBy("mark", "doc_id", "size", *keep)
    run = rows.withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    r, p = run.alias("r"), plan.alias("p")
    same = F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.bucket") == F.col("p.bucket"))
    out = r.join(p, same).select("r.doc_id", "r.source", "r.size", "source_size", "target", "no", (F.col("start") + F.col("upto") - F.col("size")).alias("ahead"), *keep)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    out = out.withColumn("passes", F.least(whole, F.lit(most)).cast("long"))
    left = F.col("target") - F.col("passes") * F.col("source_size")
    extra = (F.col("size") > 0) & (F.col("passes") < most) & (F.col("ahead") + F.col("size") / 2 <= left)
    out = out.withColumn("copies", F.when(F.col("size") > 0, F.col("passes") + extra.cast("long")).otherwise(F.lit(0).cast("long")))
    out = out.withColumn("tilt", tilt_of(F.col("no"))).withColumn("ahead", F.col("ahead").cast("double"))
    where = F.when(F.col("copies") > 0, place(F.col("ahead")))
    return out.select(
        "doc_id", "source", "size", "source_size", "target", "tilt", "ahead", "copies",
        (F.col("copies") * F.col("size")).alias("taken"), where.alias("position"), *keep,
    )


def place(ahead: Column) -> Column:
    """Where the word after ``ahead`` words of a source stands."""
    return position(F.least(ahead / F.greatest("target", F.lit(1.0)), F.lit(1.0)), F.col("tilt"))


def schedule(mixed: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, position (and ``keep``): a row for every copy taken, at its own place."""
    copies = mixed.filter("copies > 0").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return copies.select("doc_id", place(F.col("ahead") + F.col("pass") * F.col("source_size")).alias("position"), *keep)


def mixture(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MOST,
    keep: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """The plan of ``mix`` with a number ``row`` for every row, and the mix: a row for every copy
    taken (row, doc_id, size, position and ``keep``), in the order of training."""
    scratch = Scratch(docs.sparkSession, "mixture")
    keep = [*keep, "row"]
    plan = scratch.keep(mix(docs.withColumn("row", F.monotonically_increasing_id()), id_col, text_col, source_col, most, keep), "plan")
    copies = schedule(plan, ["size", *keep]).orderBy("position", "doc_id", "row")
    return plan, copies
