"""Example records: defaults, clean-up, length filters, pairs and reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import strip_blank


def strip_breaks(text: Column) -> Column:
    """Remove <br /> marks from a text that starts with one."""
    out = F.replace(F.replace(text, F.lit("<br />"), F.lit("")), F.lit("<br / >"), F.lit(""))
    return F.when(text.startswith("<br"), out).otherwise(text)


def tidy_examples(df: DataFrame, row_id: str, remove_br: bool = True) -> DataFrame:
    """Examples (row_id, uid?, text): uid defaults to the row id, blank texts drop."""
    uid = F.coalesce(F.col("uid").cast("string"), F.col(row_id).cast("string")) if "uid" in df.columns else F.col(row_id).cast("string")
    text = strip_breaks(F.col("text")) if remove_br else F.col("text")
    return df.withColumn("uid", uid).withColumn("text", text).filter(strip_blank(F.col("text")) != "")


def tidy_pairs(df: DataFrame, row_id: str) -> DataFrame:
    """Pairs with structs a and b (uid, text): missing uids take the row id; no text drops."""
    default = F.col(row_id).cast("string")
    side = lambda c: F.struct(F.coalesce(F.col(f"{c}.uid"), default).alias("uid"), F.col(f"{c}.text").alias("text"))
    return df.withColumn("a", side("a")).withColumn("b", side("b"))


def example_length(a: Column, b: Column | None = None, product: bool = False) -> Column:
    """Tokens of an example; of a pair the sum or the product of both sides."""
    if b is None:
        return F.size(a)
    return F.size(a) * F.size(b) if product else F.size(a) + F.size(b)


def within_length(df: DataFrame, length: Column, low: int, high: int) -> DataFrame:
    return df.filter(length.between(low, high))


def drop_ends(ids: Column) -> Column:
    """Without the first and the last id."""
    return F.when(F.size(ids) > 2, F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 2, F.lit(0)))).otherwise(
        F.filter(ids, lambda x: F.lit(False))
    )


def without_special(ids: Column, special: Column) -> Column:
    return F.filter(ids, lambda x: ~F.array_contains(special, x))


def to_single(df: DataFrame, keep: str = "b", detail: str = "a", cat: bool = False) -> DataFrame:
    """One side of a pair stays, the other becomes its details; ids optionally appended."""
    ids = F.col(f"{keep}.input_ids")
    if cat:
        ids = F.concat(ids, F.col(f"{detail}.input_ids"))
    return df.select(
        F.col(f"{keep}.uid").alias("uid"), F.col(f"{keep}.text").alias("text"),
        ids.alias("input_ids"), F.col(detail).alias("details"), "label",
    )


def concatenated_ids(a: Column, b: Column) -> tuple[Column, Column]:
    """Ids of both sides and their positions (b continues after a)."""
    return F.concat(a, b), F.transform(F.concat(a, b), lambda x, i: i)


def sentences_to_reviews(df: DataFrame, reviews: DataFrame, as_lists: bool = False) -> DataFrame:
    """Sentences (review_id, pos, sentence, tree, label, label_name) of known reviews, each
    with the label of its review's first sentence.

    The long form keeps one row per sentence, so a review may be of any size. ``as_lists``
    gives one row per review with ordered lists, for reviews that fit a row.
    """
    known = df.join(reviews.select(F.col("uid").alias("review_id")), "review_id", "left_semi")
    first = known.groupBy("review_id").agg(
        F.min_by("label", "pos").alias("label"), F.min_by("label_name", "pos").alias("label_name")
    )
    if not as_lists:
        return known.drop("label", "label_name").join(first, "review_id")
    ordered = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("pos", c))), lambda s: s[c])
    lists = known.groupBy("review_id").agg(ordered("sentence").alias("sentences"), ordered("tree").alias("trees"))
    return lists.join(first, "review_id")


def last_by_uid(df: DataFrame, uid: str, order: str) -> DataFrame:
    """One row per uid, the last one wins."""
    cols = [c for c in df.columns if c != uid]
    return df.groupBy(uid).agg(F.max_by(F.struct(*cols), order).alias("_r")).select(uid, "_r.*")
