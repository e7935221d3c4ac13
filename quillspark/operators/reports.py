"""Reports about merged feature groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_documents(feats: DataFrame, members: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Distinct (doc, keep…, grp): documents that hold a member of a group.

    ``members`` is (grp, feature).
    """
    return feats.join(members.select("grp", "feature"), "feature").select("doc", *keep, "grp").distinct()


def label_profile(train: DataFrame, classes: Sequence[int]) -> DataFrame:
    """(grp, train_n, count_<y>, majority, rarest) over train documents (doc, y, grp).

    majority is the most, rarest the least frequent class; the lowest id wins ties.
    """
    counts = [F.count(F.when(F.col("y") == y, 1)).alias(f"count_{y}") for y in classes]
    out = train.groupBy("grp").agg(F.count(F.lit(1)).alias("train_n"), *counts)
    cs = [F.col(f"count_{y}") for y in classes]

    def first_equal(best: Column) -> Column:
        pick = F.lit(classes[-1])
        for y, c in reversed(list(zip(classes, cs))):
            pick = F.when(c == best, y).otherwise(pick)
        return pick

    top = F.greatest(*cs) if len(cs) > 1 else cs[0]
    low = F.least(*cs) if len(cs) > 1 else cs[0]
    return out.withColumn("majority", first_equal(top)).withColumn("rarest", first_equal(low))


def group_report(
    train: DataFrame,
    dev: DataFrame,
    classes: Sequence[int],
    models: Sequence[str],
    hard_counter: bool = False,
    forced_majority: DataFrame | None = None,
) -> DataFrame:
    """Per group: train label counts, accuracy of the majority on train and dev, and per
    model its accuracy on supporting and counter documents of dev (null when none).

    ``train`` is (doc, y, grp), ``dev`` (doc, y, grp, acc_<model>…). With ``hard_counter``
    only documents of the rarest class count as counter. ``forced_majority`` (grp, forced)
    replaces the class that support is measured against.
    """
    profile = label_profile(train, classes)
    cs = [F.col(f"count_{y}") for y in classes]
    profile = profile.withColumn("train_acc", F.greatest(*cs) / F.col("train_n"))
    if forced_majority is not None:
        profile = (
            profile.join(forced_majority.select("grp", "forced"), "grp", "left")
            .withColumn("majority", F.coalesce("forced", "majority"))
            .drop("forced")
        )
    # dev documents fold to counts per (group, class) before they meet the profile
    folded = dev.groupBy("grp", "y").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"acc_{m}").alias(f"r_{m}") for m in models]
    )
    support = F.col("y") == F.col("majority")
    counter = (F.col("y") == F.col("rarest")) if hard_counter else ~support
    share = lambda cond, c: F.try_divide(
        F.sum(F.when(cond, F.col(c))), F.sum(F.when(cond, F.col("n")))
    )
    aggs = [
        F.coalesce(F.sum("n"), F.lit(0)).alias("dev_n"),
        F.try_divide(
            F.coalesce(F.sum(F.when(support, F.col("n"))), F.lit(0)), F.sum("n")
        ).alias("dev_acc"),
        F.coalesce(F.sum(F.when(support, F.col("n"))), F.lit(0)).alias("support_n"),
        F.coalesce(F.sum(F.when(counter, F.col("n"))), F.lit(0)).alias("counter_n"),
    ]
    for m in models:
        aggs += [share(support, f"r_{m}").alias(f"{m}_support"), share(counter, f"r_{m}").alias(f"{m}_counter")]
    measured = profile.select("grp", "majority", "rarest").join(folded, "grp", "left").groupBy("grp").agg(*aggs)
    return profile.join(measured, "grp")


def family_majority(train: DataFrame, family: Column, classes: Sequence[int]) -> DataFrame:
    """(grp, forced): every group with the majority class of the family it is in.

    ``train`` is (doc, y, grp); a document counts once for a family, however many of its
    groups it is in. The result is what ``group_report`` takes as ``forced_majority``.
    """
    named = train.select("doc", "y", "grp", family.alias("family"))
    whole = label_profile(named.select("doc", "y", F.col("family").alias("grp")).distinct(), classes)
    groups = named.select("grp", "family").distinct()
    return groups.join(whole.select(F.col("grp").alias("family"), F.col("majority").alias("forced")), "family").select("grp", "forced")


def first_of_each(report: DataFrame, label: str, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of every label; partial ranks are cut before the shuffle."""
    ranked = report.withColumn("_n", F.row_number().over(Window.partitionBy(label).orderBy(*order)))
    return ranked.filter(F.col("_n") <= k).drop("_n")


def support_masks(dev: DataFrame, profile: DataFrame) -> DataFrame:
    """(doc, grp, support, counter) flags for the documents of a group."""
    return dev.join(profile.select("grp", "majority"), "grp").select(
        "doc", "grp",
        (F.col("y") == F.col("majority")).alias("support"),
        (F.col("y") != F.col("majority")).alias("counter"),
    )


def member_text(members: DataFrame, limit: int | None) -> DataFrame:
    """(grp, members): the first ``limit`` member names in MI order."""
    order = Window.partitionBy("grp").orderBy(F.desc("mi"), "feature")
    kept = members.withColumn("_n", F.row_number().over(order))
    if limit is not None:
        kept = kept.filter(F.col("_n") <= limit)
    return kept.groupBy("grp").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("_n", "feature"))), lambda s: s["feature"]), ", "
        ).alias("members")
    )


def keys_by_information(groups: DataFrame, k: int) -> DataFrame:
    """Groups (key, grp, mi) of the k keys whose groups carry most MI in sum."""
    total = groups.groupBy("key").agg(F.round(F.sum("mi"), 10).alias("key_mi"))
    return groups.join(total.orderBy(F.desc("key_mi"), "key").limit(k), "key")


def equivalent_groups(families: DataFrame, classes: Sequence[int], force_first: bool = False) -> DataFrame:
    """Compare groups of equal index across feature families.

    ``families``: (family, idx, y, n, right) folded counts of train (n) per group and
    class, plus dev counts: (dev_n, dev_right). The first family in name order sets the
    group's class when ``force_first``. Returns (family, idx, count, y_hat, p_y,
    support_acc, counter_acc, drop).
    """
    best = families.groupBy("family", "idx").agg(
        F.sum("n").alias("count"),
        F.max_by("y", F.struct(F.col("n"), -F.col("y"))).alias("own_y"),
    )
    first = best.groupBy("idx").agg(F.min_by("own_y", "family").alias("first_y"))
    chosen = best.join(first, "idx").withColumn("y_hat", F.col("first_y") if force_first else F.col("own_y"))
    joined = families.join(chosen, ["family", "idx"])
    hit = F.col("y") == F.col("y_hat")
    rate = lambda cond: F.try_divide(
        F.sum(F.when(cond, F.col("dev_right"))), F.sum(F.when(cond, F.col("dev_n")))
    )
    out = joined.groupBy("family", "idx", "count", "y_hat", "first_y").agg(
        ((F.coalesce(F.max(F.when(F.col("y") == F.col("first_y"), F.col("n"))), F.lit(0)) + 1)
         / (F.sum("n") + len(classes))).alias("p_y"),
        rate(hit).alias("support_acc"),
        rate(~hit).alias("counter_acc"),
    )
    return out.withColumn("drop", F.col("support_acc") - F.col("counter_acc")).drop("first_y")


def melt_metrics(df: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Long form (ids…, metric, subset, value): columns named <metric>_<subset>."""
    long = df.unpivot(list(ids), list(values), "variable", "value")
    return long.select(
        *ids,
        F.substring_index("variable", "_", 1).alias("metric"),
        F.when(F.col("variable").endswith("support"), "support").otherwise("counter").alias("subset"),
        "value",
    )
