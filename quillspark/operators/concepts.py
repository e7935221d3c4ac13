"""Keyword groups per label and the prompts that ask for a concept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import fixed as fx


def keyword_groups(table: DataFrame, k: int) -> DataFrame:
    """(label, grp, kw_no, kw): keywords of the top 2k groups of a label by MI.

    ``table`` is (label, examples, mi); label compares in lower case, examples are
    comma-separated; [UNK] and blanks drop.
    """
    order = Window.partitionBy("label").orderBy(F.desc("mi"), "examples")
    top = (
        table.withColumn("label", F.lower("label"))
        .withColumn("grp", F.row_number().over(order))
        .filter(F.col("grp") <= 2 * k)
    )
    kws = F.filter(
        F.transform(F.split("examples", ","), lambda w: F.trim(w)), lambda w: ~w.contains("[UNK]") & (w != "")
    )
    return top.select("label", "grp", F.posexplode(kws).alias("kw_no", "kw"))


def keyword_sentences(groups: DataFrame, rows: DataFrame, single_words: bool = False) -> DataFrame:
    """(label, grp, kw_no, kw, sentence): first row of the label that contains the keyword.

    ``rows`` is (row_id, label_name, sentence). Keyword lists are bounded (2k groups of at
    most eight examples per label), so they travel to the rows as one array per label and
    the search is a map-side scan. ``single_words``: keywords are words of the sentence
    split on blanks, found by an equi-join.
    """
    wanted = groups.withColumn("needle", F.replace("kw", F.lit(" ' "), F.lit("'")))
    if single_words:
        words = rows.select(
            "row_id", F.lower("label_name").alias("label"),
            F.explode(F.array_distinct(F.split("sentence", " "))).alias("needle"),
        )
        hits = words.join(wanted.select("label", "needle").distinct(), ["label", "needle"])
    else:
        lists = wanted.groupBy("label").agg(F.collect_set("needle").alias("needles"))
        hits = rows.join(lists, F.lower("label_name") == F.col("label")).select(
            "row_id", "label",
            F.explode(F.filter("needles", lambda n: F.col("sentence").contains(n))).alias("needle"),
        )
    first = hits.groupBy("label", "needle").agg(F.min("row_id").alias("row_id"))
    found = first.join(rows.select("row_id", "sentence"), "row_id")
    return wanted.join(found, ["label", "needle"]).select("label", "grp", "kw_no", "kw", "sentence")


def concept_prompts(found: DataFrame, k: int) -> DataFrame:
    """(label, n, instruction): groups with more than one found keyword, the first k of
    them per label, the first k distinct keywords of each."""
    once = found.groupBy("label", "grp", "kw").agg(
        F.min("kw_no").alias("kw_no"), F.min_by("sentence", "kw_no").alias("sentence")
    )
    by_kw = Window.partitionBy("label", "grp").orderBy("kw_no")
    numbered = once.withColumn("_n", F.row_number().over(by_kw)).withColumn(
        "_all", F.count(F.lit(1)).over(Window.partitionBy("label", "grp"))
    )
    line = F.concat(F.lit("{sentence: "), "sentence", F.lit(", keyword: "), "kw", F.lit("}\n"))
    shown = (
        numbered.filter((F.col("_all") > 1) & (F.col("_n") <= k))
        .groupBy("label", "grp")
        .agg(
            F.array_join(
                F.transform(F.sort_array(F.collect_list(F.struct("_n", line.alias("line")))), lambda s: s["line"]), ""
            ).alias("lines")
        )
    )
    order = Window.partitionBy("label").orderBy("grp")
    return (
        shown.withColumn("n", F.row_number().over(order))
        .filter(F.col("n") <= k)
        .select("label", "n", F.concat(F.lit(fx.CONCEPT_REQUEST), "lines").alias("instruction"))
    )
