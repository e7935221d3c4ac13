"""Sinks. All write distributed directories; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.ner import conll_block

TSV = {"sep": "\t", "header": True, "quote": '"', "escape": '"'}


def write_tsv(df: DataFrame, path: str) -> None:
    """TSV with header. An empty string reads back as null, as it does with pandas."""
    df.write.options(**TSV).csv(path)


def instruction_record(instruction: Column, record_input: Column, output: Column) -> list[Column]:
    return [
        instruction.alias("instruction"),
        record_input.cast("string").alias("input"),
        output.cast("string").alias("output"),
    ]



def record_layout(layout: str, side: int = 1) -> list[Column]:
    """Columns of one of the instruction record layouts.

    topic: prompt, label twice; abstract: abstract prompt, label as output; ner: prompt,
    row index as output; qa: abstract prompt, answer as output; pair: abstract prompt and
    text of one side; exemplar: abstract prompt, label in, text out.
    """
    c, none = F.col, F.lit("")
    layouts = {
        "topic": lambda: (c("final_topic_const"), c("label"), c("label")),
        "abstract": lambda: (c("abs_const"), none, c("label")),
        "ner": lambda: (c("final_topic_const"), none, c("row_id")),
        "ner_abstract": lambda: (c("abs_const"), none, c("row_id")),
        "qa": lambda: (c("abs_const"), none, c("answer")),
        "pair": lambda: (c(f"abs_const{side}"), none, c(f"text{side}")),
        "exemplar": lambda: (c("abs_const"), c("label"), c("text")),
    }
    return instruction_record(*layouts[layout]())


def write_instructions(df: DataFrame, layout: str, path: str, side: int = 1) -> None:
    df.select(*record_layout(layout, side)).write.json(path)


def write_predictions(df: DataFrame, path: str) -> None:
    df.select("row_id", "seq_no", "label", "predict").write.json(path)


def write_conll(df: DataFrame, path: str, words: str = "words", tags: str = "tags") -> None:
    """token<TAB>tag lines, a blank line after each sentence."""
    df.select(conll_block(F.col(words), F.col(tags)).alias("value")).write.option("lineSep", "\n\n").text(path)


def write_scored(df: DataFrame, path: str) -> None:
    """Scored predictions, one folder per data set."""
    df.write.partitionBy("dataset").json(path)


def write_by_label(df: DataFrame, label: str, path: str) -> None:
    """One CSV folder per label."""
    df.write.partitionBy(label).option("header", True).csv(path)
