"""Scores of predictions and reports over runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import fixed as fx
from quillspark.functions.vectors import argmax, log_sum_exp


def with_prediction(df: DataFrame, log_probs: str = "log_probs", loss: str = "loss") -> DataFrame:
    """Add predicted (first maximum), acc and score = -loss."""
    return (
        df.withColumn("predicted", argmax(F.col(log_probs)))
        .withColumn("acc", (F.col("predicted") == F.col("label")).cast("int"))
        .withColumn("score", -F.col(loss))
    )


def collapse_classes(df: DataFrame, log_probs: str = "log_probs") -> DataFrame:
    """Classes 1..n become one; predicted and loss follow the two remaining classes."""
    lp = F.col(log_probs)
    two = F.array(F.get(lp, F.lit(0)), log_sum_exp(F.slice(lp, F.lit(2), F.size(lp) - 1)))
    return (
        df.withColumn("full_log_probs", lp)
        .withColumn(log_probs, two)
        .withColumn("predicted", argmax(F.col(log_probs)))
        .withColumn("loss", -F.get(F.col(log_probs), F.col("label")))
    )


def mean_scores(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg("acc").alias("acc"), F.avg("loss").alias("loss"))


def average_runs(long: DataFrame, by: Sequence[str] = ("dataset", "metric"), run: str = "run") -> DataFrame:
    """(by…, mean, std, values): mean and population deviation over runs; values in run order."""
    return long.groupBy(*by).agg(
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.transform(F.sort_array(F.collect_list(F.struct(run, "value"))), lambda s: s["value"]).alias("values"),
    )


def percent(x: Column) -> Column:
    return F.format_string("%.1f", F.round(100 * x, 1))


def mean_std_text(mean: Column, std: Column) -> Column:
    return F.concat(percent(mean), F.lit("±"), percent(std))


def dataset_title(dataset: Column) -> Column:
    out = dataset
    for key, title in fx.DATASET_NAMES.items():
        out = F.when(dataset == key, title).otherwise(out)
    return out


def run_setting(name: Column) -> Column:
    """K and lambda out of a run name like k8L0.5, else the name itself."""
    k = F.regexp_extract(name, r"^.(\d+)L(.*)$", 1)
    lam = F.regexp_extract(name, r"^.(\d+)L(.*)$", 2)
    return F.when(k != "", F.concat(F.lit("K="), k, F.lit(", λ="), lam)).otherwise(name)


def method_table(long: DataFrame, datasets: Sequence[str], by: Sequence[str] = ("method",)) -> DataFrame:
    """One row per method, one "mean±std" accuracy column per data set; a method without
    a data set has a null there."""
    acc = long.filter(F.col("metric") == "acc")
    averaged = average_runs(acc, (*by, "dataset")).withColumn("cell", mean_std_text(F.col("mean"), F.col("std")))
    return averaged.groupBy(*by).pivot("dataset", list(datasets)).agg(F.first("cell"))


def subset_scores(rows: DataFrame, subset: Column, by: Sequence[str] = ("method", "run", "dataset"), acc: str = "acc") -> DataFrame:
    """(by…, subset, value): mean of ``acc`` over all rows ("acc") and over each subset, from one pass."""
    by = list(by)
    named = rows.withColumn("subset", subset)
    sets = named.groupingSets([by, [*by, "subset"]], *by, "subset")
    out = sets.agg(F.avg(acc).alias("value"), F.grouping("subset").alias("_all"))
    return out.withColumn("subset", F.when(F.col("_all") == 1, "acc").otherwise(F.col("subset"))).drop("_all")


def subset_table(
    scores: DataFrame, datasets: Sequence[str], subsets: Sequence[str] = ("acc", "support", "counter"), by: Sequence[str] = ("method",)
) -> DataFrame:
    """One row per method and two levels of columns, "<data set> <subset>" with "mean±std" over
    runs; null where a method has no such rows. ``scores`` is (by…, run, dataset, subset, value)."""
    averaged = average_runs(scores.filter(F.col("subset").isin(*subsets)), (*by, "dataset", "subset"))
    cells = averaged.withColumn("at", F.concat_ws(" ", "dataset", "subset")).withColumn("cell", mean_std_text(F.col("mean"), F.col("std")))
    return cells.groupBy(*by).pivot("at", [f"{d} {s}" for d in datasets for s in subsets]).agg(F.first("cell"))


def single_run_table(long: DataFrame, datasets: Sequence[str]) -> DataFrame:
    acc = long.filter(F.col("metric") == "acc").withColumn("cell", percent(F.col("value")))
    return acc.groupBy("method").pivot("dataset", list(datasets)).agg(F.first("cell"))


def split_report(preds: DataFrame) -> DataFrame:
    """(run, split, supporting / counter accuracy and count) for predictions
    (run, split, grp, acc) whose grp is supporting or counter."""
    cols = []
    for g in ("supporting", "counter"):
        cond = F.col("grp") == g
        cols += [
            F.avg(F.when(cond, F.col("acc"))).alias(f"{g}_acc"),
            F.count(F.when(cond, F.lit(1))).alias(f"{g}_count"),
        ]
    return preds.groupBy("run", "split").agg(*cols)


def split_drift(original: DataFrame, new: DataFrame) -> DataFrame:
    """(split, counts, original and new accuracy, their difference), averaged over runs."""
    def over_runs(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy("split").agg(
            F.avg("supporting_acc").alias(f"{tag}_s"),
            F.avg("counter_acc").alias(f"{tag}_c"),
            F.avg("supporting_count").alias(f"{tag}_sn"),
            F.avg("counter_count").alias(f"{tag}_cn"),
        )

    both = over_runs(original, "old").join(over_runs(new, "new"), "split")
    return both.select(
        "split",
        F.col("new_sn").alias("supporting_count"), F.col("old_s").alias("old_supporting"),
        F.col("new_s").alias("new_supporting"), (F.col("new_s") - F.col("old_s")).alias("drift_supporting"),
        F.col("new_cn").alias("counter_count"), F.col("old_c").alias("old_counter"),
        F.col("new_c").alias("new_counter"), (F.col("new_c") - F.col("old_c")).alias("drift_counter"),
    )
