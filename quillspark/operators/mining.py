"""Features per document, their mutual information with the class, and group merges.

A feature set is the long table (doc, feature), distinct. Only present pairs are stored
and counted; absence follows from the class totals.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.binding import once
from quillspark.session import materialise

def features_of(docs: DataFrame, doc: str, features: Column, keep: Sequence[str] = ()) -> DataFrame:
    """(doc, …, feature): the distinct features of each document, no shuffle needed when
    ``docs`` has one row per document."""
    return docs.select(F.col(doc).alias("doc"), *keep, F.explode(F.array_distinct(features)).alias("feature"))


def class_counts(feats: DataFrame, feature: str | Sequence[str] = "feature", cls: str = "y") -> DataFrame:
    by = [feature] if isinstance(feature, str) else list(feature)
    return feats.groupBy(*by, cls).agg(F.count(F.lit(1)).alias("c"))


def class_totals(docs: DataFrame, cls: str = "y") -> DataFrame:
    return docs.groupBy(cls).agg(F.count(F.lit(1)).alias("n_y"))


def with_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Attach the columns of a global aggregate, which is one row, to every row."""
    return df.join(F.broadcast(one), how="inner", on=F.lit(True))


def _g(k: Column, t: Column) -> Column:
    return (k / t) * F.ln(k / t)


def mutual_information(
    counts: DataFrame, totals: DataFrame, by: Sequence[str] = ("feature",), cls: str = "y",
    keep: Sequence[Column] = (),
) -> DataFrame:
    """(by…, mi, count, majority, max_c[, keep]) from (by…, y, c) and (y, n_y).

    Add-one on the class x present/absent table. With T its sum, p = k/T and
    g(k) = p ln p, the information is sum_y g(c+1) + g(n-c+1) - sum_y p_y ln p_y
    - sum_z p_z ln p_z; classes in which a feature never occurs contribute the same
    constant to every feature, so only present classes are summed.
    """
    by = list(by)
    everything = Window.partitionBy()  # a row per class, with the constants of all of them
    n, t = F.col("n_y").cast("double"), F.col("_T")
    absent = _g(F.lit(1.0), t) + _g(n + 1, t)
    p_y = (n + 2) / t
    per_class = (
        totals.withColumn("_N", F.sum(n).over(everything))
        .withColumn("_C", F.count(F.lit(1)).over(everything).cast("double"))
        .withColumn("_T", F.col("_N") + 2 * F.col("_C"))
        .withColumn("_base", F.sum(absent - p_y * F.ln(p_y)).over(everything))
    )
    # one row per class, so the counts stay where they are
    present = counts.join(F.broadcast(per_class.select(cls, "n_y", "_N", "_C", "_T", "_base")), cls).withColumn(
        "_gain",
        _g(F.col("c") + 1.0, t) + _g(n - F.col("c") + 1, t) - absent,
    )
    grouped = present.groupBy(*by).agg(
        F.sum("_gain").alias("_gain"),
        F.sum("c").alias("count"),
        F.max("c").alias("max_c"),
        # largest count, lowest class on ties
        F.max_by(F.col(cls), F.struct(F.col("c"), -F.col(cls))).alias("majority"),
        *[F.max(c).alias(c) for c in ("_N", "_C", "_T", "_base")],
        *keep,
    )
    pz1 = (F.col("count") + F.col("_C")) / t
    pz0 = (F.col("_N") - F.col("count") + F.col("_C")) / t
    mi = F.col("_base") + F.col("_gain") - pz1 * F.ln(pz1) - pz0 * F.ln(pz0)
    own = (*by, "_gain", "count", "max_c", "majority", "_N", "_C", "_T", "_base")
    names = [c for c in grouped.columns if c not in own]
    return (
        grouped.withColumn("mi", mi)
        .withColumn("pct_majority", (F.col("max_c") + 1) / (F.col("count") + F.col("_C")))
        .select(*by, "mi", "count", "majority", "max_c", "pct_majority", *names)
    )


class CountCube:
    """Documents by (feature, split, class) and by (feature, class), counted in one pass and written.

    A document stands once for each of its features and once for none, so the totals of the
    classes come from the pass that counts features. Whatever is asked of the cube reads the
    written counts and no document.
    """

    def __init__(self, docs: DataFrame, features: Column, cls: str = "y", split: str = "split"):
        self.cls = cls
        found = F.filter(F.array_distinct(features), lambda x: x.isNotNull())
        rows = docs.select(
            F.col(cls).alias("y"), F.col(split).alias("split"), F.explode(once(F.array_append(found, F.lit(None)))).alias("feature")
        )
        cells = rows.groupingSets([["feature", "y", "split"], ["feature", "y"]], "feature", "y", "split").agg(
            F.grouping("split").alias("whole"), F.count(F.lit(1)).alias("c")
        )
        self.cells = materialise(cells, "cube")

    def _slice(self, split: str | None) -> DataFrame:
        return self.cells.filter("whole = 1" if split is None else (F.col("whole") == 0) & (F.col("split") == split))

    def counts(self, split: str | None = None) -> DataFrame:
        """(feature, class, c) of a split, or of all."""
        return self._slice(split).filter("feature is not null").select("feature", F.col("y").alias(self.cls), "c")

    def totals(self, split: str | None = None) -> DataFrame:
        """(class, n_y) of a split, or of all."""
        return self._slice(split).filter("feature is null").select(F.col("y").alias(self.cls), F.col("c").alias("n_y"))

    def information(self, split: str | None = None, keep: Sequence[Column] = ()) -> DataFrame:
        return mutual_information(self.counts(split), self.totals(split), ["feature"], self.cls, keep)


def per_class_counts(classes: Sequence[int], cls: str = "y") -> list[Column]:
    """One count column per known class, to keep beside the information."""
    return [F.coalesce(F.sum(F.when(F.col(cls) == y, F.col("c"))), F.lit(0)).alias(f"count_{y}") for y in classes]


def feature_mi(feats: DataFrame, docs: DataFrame, cls: str = "y") -> DataFrame:
    """MI of each feature; ``feats`` is (doc, y, feature), ``docs`` (doc, y)."""
    return mutual_information(class_counts(feats, "feature", cls), class_totals(docs, cls), ["feature"], cls)


def feature_table(feats: DataFrame, docs: DataFrame, classes: Sequence[int], cls: str = "y") -> DataFrame:
    """MI table with one count column per known class."""
    return mutual_information(
        class_counts(feats, "feature", cls), class_totals(docs, cls), ["feature"], cls, per_class_counts(classes, cls)
    )


def ranked(table: DataFrame, order: str = "mi", name: str = "feature") -> DataFrame:
    return table.orderBy(F.desc(order), name)


def seen_only(feats: DataFrame, train_feats: DataFrame) -> DataFrame:
    """Features of another split that occur in train; the rest drop."""
    return feats.join(train_feats.select("feature").distinct(), "feature", "left_semi")


def add_features(
    docs: DataFrame, func: Callable[[DataFrame], DataFrame], sort: bool = True
) -> DataFrame:
    """MI table of a caller's feature function: documents (doc, y, …) -> (doc, feature)."""
    feats = func(docs).select("doc", "feature").distinct()
    table = feature_mi(feats.join(docs.select("doc", "y"), "doc"), docs)
    return ranked(table) if sort else table


def top_features(
    table: DataFrame, k: int, where: Column | None = None
) -> DataFrame:
    """The k features of highest MI among those the predicate keeps."""
    kept = table.filter(where) if where is not None else table
    return kept.orderBy(F.desc("mi"), "feature").limit(k)


def merge_by_majority(
    feats: DataFrame, docs: DataFrame, chosen: DataFrame, key: Column, classes: Sequence[int],
    include_empty: bool = True, totals: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Merge chosen features by (key, majority class): a document has the group when it
    has any member. ``totals`` (y, n_y) spares counting ``docs``.

    Returns (table, members): table is (key, cls, mi, count, count_<y>, majority,
    pct_majority, support_count, counter_count), members (key, cls, feature, mi).
    """
    members = chosen.select(key.alias("key"), F.col("majority").alias("cls"), "feature", "mi")
    grouped = feats.join(members.select("feature", "key", "cls"), "feature").select("doc", "y", "key", "cls").distinct()
    counts = grouped.groupBy("key", "cls", "y").agg(F.count(F.lit(1)).alias("c"))
    if include_empty:
        # every key stands with every class, also with no member at all
        every = members.select("key").distinct().select(
            "key", F.explode(F.array(*[F.lit(c) for c in classes])).alias("cls")
        ).select("key", "cls", F.lit(classes[0]).alias("y"), F.lit(0).cast("bigint").alias("c"))
        counts = counts.unionByName(every).groupBy("key", "cls", "y").agg(F.sum("c").alias("c"))
    whole = class_totals(docs) if totals is None else totals
    table = mutual_information(counts, whole, ["key", "cls"], "y", per_class_counts(classes))
    table = table.withColumn("support_count", F.col("max_c")).withColumn(
        "counter_count", F.col("count") - F.col("max_c")
    )
    return table, members


def group_examples(members: DataFrame, example: str = "feature", k: int = 8) -> DataFrame:
    """First k member names of a group in MI order, comma-joined."""
    order = Window.partitionBy("key", "cls").orderBy(F.desc("mi"), example)
    return (
        members.withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= k)
        .groupBy("key", "cls")
        .agg(
            F.array_join(
                F.transform(F.sort_array(F.collect_list(F.struct("_n", example))), lambda s: s[example]), ", "
            ).alias("examples")
        )
    )


def attach_predictions(docs: DataFrame, predictions: DataFrame, doc: str = "doc") -> DataFrame:
    """Classifier predictions by uid: adds predicted and acc (1 when right)."""
    return docs.join(predictions.select(F.col("uid").alias(doc), "predicted"), doc).withColumn(
        "acc", (F.col("predicted") == F.col("y")).cast("int")
    )


def support_counter_accuracy(feats: DataFrame, majority: DataFrame, by: Sequence[str] = ("feature",)) -> DataFrame:
    """(by…, support_n, support_acc, counter_n, counter_acc): mean correctness over the
    documents whose label equals / differs from the train majority; null when none.

    ``feats`` is (doc, y, acc, by…), ``majority`` (by…, majority).
    """
    by = list(by)
    same = F.col("y") == F.col("majority")
    # classes and correctness first fold into counts, so the join moves counts only
    folded = feats.groupBy(*by, "y").agg(F.count(F.lit(1)).alias("n"), F.sum("acc").alias("right"))
    joined = folded.join(majority.select(*by, "majority"), by)
    total = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    out = joined.groupBy(*by).agg(
        total(same, "n").alias("support_n"),
        total(same, "right").alias("_sr"),
        total(~same, "n").alias("counter_n"),
        total(~same, "right").alias("_cr"),
    )
    return out.select(
        *by,
        "support_n",
        F.try_divide(F.col("_sr"), F.col("support_n")).alias("support_acc"),
        "counter_n",
        F.try_divide(F.col("_cr"), F.col("counter_n")).alias("counter_acc"),
    )


def smoothed_majority(counts: Sequence[Column]) -> Column:
    """(max + 1) / (sum + number of classes)."""
    total = counts[0]
    for c in counts[1:]:
        total = total + c
    top = F.greatest(*counts) if len(counts) > 1 else counts[0]
    return (top + 1) / (total + len(counts))
