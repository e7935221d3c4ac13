"""Sampling, splitting and numbering that never sort one whole label in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.hashing import draw, draw32
from quillspark.operators.mining import with_row

ROWS_PER_BUCKET = 100_000


def numbered(
    df: DataFrame, by: Sequence[str], order: str, bucket: Column, out: str = "rn"
) -> DataFrame:
    """``row_number() over (partition by by order by order)`` for groups of any size.

    ``bucket`` must be non-decreasing in ``order`` and bound the rows of one
    (group, bucket). Rows are numbered inside their bucket and shifted by the
    rows of the buckets before it, so a hot group spreads over many tasks.
    """
    by = list(by)
    df = df.withColumn("_b", bucket)
    sizes = df.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*by, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(order))
    keyed = df.alias("d").join(
        starts.alias("s"),
        [F.col(f"d.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*by, "_b"]],
    )
    cols = [F.col(f"d.{c}") for c in df.columns if c != "_b"]
    return (
        keyed.select(*cols, F.col("d._b"), F.col("s._start"))
        .withColumn(out, (local + F.col("_start")).cast("bigint"))
        .drop("_b", "_start")
    )


def id_bucket(row_id: str, rows: int = ROWS_PER_BUCKET) -> Column:
    """Bucket of a unique integer id: at most ``rows`` ids fall into one."""
    return F.floor(F.col(row_id) / F.lit(rows)).cast("bigint")


def per_class_split(
    df: DataFrame, label: str, row_id: str, test: int = 1000, dev: int = 1000,
    bucket_rows: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """First rows of each class to test, the next to dev, the rest to train."""
    out = numbered(df, [label], row_id, id_bucket(row_id, bucket_rows), "_rn")
    part = (
        F.when(F.col("_rn") <= test, "test")
        .when(F.col("_rn") <= test + dev, "dev")
        .otherwise("train")
    )
    return out.withColumn("split", part).drop("_rn")


def half_split(df: DataFrame, uid: str, seed="split") -> DataFrame:
    """Random halves by uid."""
    half = F.when(draw32(seed, F.col(uid)) % 2 == 0, "a").otherwise("b")
    return df.withColumn("half", half)


def capped_sample(df: DataFrame, uid: str, n: int, seed) -> DataFrame:
    """Random sample of at most n rows; the sample, not the input, is small."""
    return df.orderBy(draw(seed, F.col(uid)), uid).limit(n)


def resample_by_label(
    df: DataFrame, label: str, row_id: str, target: int = 500, seed="resample",
    bucket_rows: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Sample with replacement, ``round(n_label * target / N)`` rows per label, shuffled.

    Draw j of a label picks position hash(j) of that label; positions come from
    ``numbered``, and the join key (label, position) is as wide as the label is.
    """
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    whole = df.agg(F.count(F.lit(1)).alias("_total"))
    plan = (
        with_row(sizes, whole)
        .withColumn("_m", F.rint(F.col("_n") * F.lit(float(target)) / F.col("_total")).cast("int"))
        .filter("_m > 0")
        .select(label, "_n", F.explode(F.sequence(F.lit(1), F.col("_m"))).alias("draw_no"))
        .withColumn("_rn", 1 + draw32(seed, F.col(label), F.col("draw_no")) % F.col("_n"))
    )
    placed = numbered(df, [label], row_id, id_bucket(row_id, bucket_rows), "_rn")
    return (
        plan.select(label, "draw_no", "_rn")
        .join(placed, [label, "_rn"])
        .withColumn("sort_key", draw(f"{seed}s", F.col(label), F.col("draw_no")))
        .drop("_rn")
    )
