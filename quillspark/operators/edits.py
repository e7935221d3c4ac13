"""Edited predictions against their originals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.mining import with_row


def pair_edits(edits: DataFrame, originals: DataFrame) -> DataFrame:
    """Edited predictions (uid, original_uid, …, predicted, label) next to the original's
    prediction: adds orig_predicted, orig_acc, acc, changed. Orphans drop."""
    old = originals.select(
        F.col("uid").alias("original_uid"),
        F.col("predicted").alias("orig_predicted"),
        (F.col("predicted") == F.col("label")).cast("int").alias("orig_acc"),
    )
    return (
        edits.join(old, "original_uid")
        .withColumn("acc", (F.col("predicted") == F.col("label")).cast("int"))
        .withColumn("changed", (F.col("predicted") != F.col("orig_predicted")).cast("int"))
    )


def edit_text(w: Column, w_new: Column) -> Column:
    return F.concat(F.array_join(w, " "), F.lit("→"), F.array_join(w_new, " "))


def pair_edit_text(w: Column, w_new: Column) -> Column:
    """Edits of pairs: both sides joined by a slash."""
    side = lambda x: F.array_join(F.transform(x, lambda s: F.array_join(s, " ")), "/")
    return F.concat(side(w), F.lit("→"), side(w_new))


def edits_by_edit(pairs: DataFrame) -> DataFrame:
    """(tpl, edit, total, n_changed, pct)."""
    return pairs.groupBy("tpl", "edit").agg(
        F.count(F.lit(1)).alias("total"), F.sum("changed").alias("n_changed")
    ).withColumn("pct", F.round(100 * F.col("n_changed") / F.col("total"), 2))


def top_edits(pairs: DataFrame, k: int = 10) -> DataFrame:
    return edits_by_edit(pairs).orderBy(F.desc("n_changed"), "tpl", "edit").limit(k)


def changes_by_template(pairs: DataFrame, n: int = 10, k: int = 3) -> DataFrame:
    """(rank, tpl, edits, total, pct, lmi): templates by local MI of (template, changed).

    Add-one over the whole template x {same, changed} table; the k edits of a template
    that change most are listed.
    """
    per_edit = edits_by_edit(pairs)
    per_tpl = per_edit.groupBy("tpl").agg(F.sum("total").alias("total"), F.sum("n_changed").alias("changed"))
    whole = per_tpl.agg(
        (F.sum("total") + 2 * F.count(F.lit(1))).alias("_all"),
        (F.sum("changed") + F.count(F.lit(1))).alias("_chg"),
    )
    p = (F.col("changed") + 1) / F.col("_all")
    p_x = (F.col("total") + 2) / F.col("_all")
    p_y = F.col("_chg") / F.col("_all")
    scored = with_row(per_tpl, whole).withColumn("lmi", p * F.ln(p / (p_x * p_y)))
    top = scored.orderBy(F.desc(F.round("lmi", 12)), "tpl").limit(n)
    # at most n rows get a rank
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("lmi", 12)), "tpl")))
    order = Window.partitionBy("tpl").orderBy(F.desc("n_changed"), "edit")
    shown = (
        per_edit.withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= k)
        .groupBy("tpl")
        .agg(
            F.array_join(
                F.transform(F.sort_array(F.collect_list(F.struct("_n", "edit"))), lambda s: s["edit"]), ", "
            ).alias("edits")
        )
    )
    return ranked.join(shown, "tpl").select(
        "rank", "tpl", "edits", "total",
        F.round(100 * F.col("changed") / F.col("total"), 2).alias("pct"), "lmi",
    )


def contrast(pairs: DataFrame) -> DataFrame:
    """One row: edits, share changed, right before, right before and wrong now."""
    right = F.col("orig_acc") == 1
    return pairs.agg(
        F.count(F.lit(1)).alias("edits"),
        F.round(100 * F.sum("changed") / F.count(F.lit(1)), 2).alias("pct_changed"),
        F.count(F.when(right, 1)).alias("previously_correct"),
        F.count(F.when(right & (F.col("acc") == 0), 1)).alias("now_wrong"),
    )


def edit_error_rate(edits: DataFrame, originals: DataFrame, target: int) -> DataFrame:
    """One row: over (original, grp) whose original prediction is not the target, how
    many, the share with some edit predicted as target, and the mean share of edits."""
    old = originals.select(F.col("uid").alias("original_uid"), F.col("predicted").alias("orig_predicted"))
    hit = (F.col("predicted") == target).cast("int")
    per_group = (
        edits.join(old.filter(F.col("orig_predicted") != target), "original_uid")
        .groupBy("original_uid", "grp")
        .agg(F.max(hit).alias("any_hit"), F.avg(hit).alias("share"))
    )
    return per_group.agg(
        F.count(F.lit(1)).alias("n"), F.avg("any_hit").alias("any_rate"), F.avg("share").alias("mean_rate")
    )
