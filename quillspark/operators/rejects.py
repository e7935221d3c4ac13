"""Rows that cannot be used, kept apart with the reason instead of an error or a silent null.

The reasons of a frame are found in one pass and written with the rows; accepted and rejected
rows are two reads of that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import literal_list
from quillspark.operators.ner import gloss_map, gloss_text
from quillspark.session import materialise


def parted(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): rows without a reason, and rows with theirs in ``reason``."""
    given = [c for c in df.columns if c != "reason"]
    marked = materialise(df.select(*given, reason.alias("reason")), "parted")
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def part_labels(df: DataFrame, label: str, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Label text replaced by its id beside label_name; rows of a label that ``table`` lacks are rejected.

    ``table`` (label_name, label) is a list of label names; of equal names the smallest id counts.
    """
    ids = table.groupBy(F.col("label_name").alias("_name")).agg(F.min("label").alias("_id"))
    out = df.join(ids, F.col(label) == F.col("_name"), "left").withColumn("label_name", F.col(label))
    reason = F.when(F.col("_id").isNull(), F.concat(F.lit("unknown label: "), F.coalesce("label_name", F.lit("null"))))
    accepted, rejected = parted(out.drop("_name"), reason)
    return (
        accepted.withColumn(label, F.col("_id")).drop("_id"),
        rejected.drop("_id", "label_name"),
    )


def part_tagged(df: DataFrame, tokens: str = "tokens", tags: str = "ner_tags") -> tuple[DataFrame, DataFrame]:
    """List literals as arrays; rejected as they were given are literals that do not parse, hold a
    null, or differ in length."""
    read = df.withColumn("_tokens", literal_list(F.col(tokens))).withColumn("_tags", literal_list(F.col(tags)))
    bad = lambda c: F.col(c).isNull() | F.exists(c, lambda x: x.isNull())
    reason = (
        F.when(bad("_tokens"), "tokens are no list of strings")
        .when(bad("_tags"), "tags are no list of strings")
        .when(F.size("_tokens") != F.size("_tags"), F.format_string("%d tokens, %d tags", F.size("_tokens"), F.size("_tags")))
    )
    accepted, rejected = parted(read, reason)
    accepted = accepted.withColumn(tokens, F.col("_tokens")).withColumn(tags, F.col("_tags"))
    return accepted.drop("_tokens", "_tags"), rejected.drop("_tokens", "_tags")


def part_glosses(df: DataFrame, phrases: str, tags: str, dataset: str, name: str = "ner_labels") -> tuple[DataFrame, DataFrame]:
    """Gloss text of a row's phrases in ``name``; rows with a tag that has no gloss are rejected,
    all such tags named once, in order."""
    glosses = gloss_map(dataset)
    unknown = F.array_sort(F.array_distinct(F.filter(tags, lambda t: F.try_element_at(glosses, F.coalesce(t, F.lit(""))).isNull())))
    reason = F.when(F.size(unknown) > 0, F.concat(F.lit("no gloss: "), F.array_join(unknown, ", ", "null")))
    accepted, rejected = parted(df, reason)
    return accepted.withColumn(name, gloss_text(F.col(phrases), F.col(tags), glosses)), rejected
