"""The loop around a text generator: wrap, repeat, run, parse, join back, unite."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import fixed as fx
from quillspark.functions.text import answer_part, tidy_answer


def wrap_chat(prompt: Column, system: str = fx.CHAT_SYSTEM) -> Column:
    """First-turn wrapper: system block and instruction marks around the prompt."""
    head = fx.CHAT_OPEN + fx.CHAT_PREFIX.replace("{system}", system)
    return F.concat(F.lit(head), prompt, F.lit(fx.CHAT_CLOSE))


def chat_response(decoded: Column) -> Column:
    """What follows the closing mark (up to a second one)."""
    return F.get(F.split(decoded, r"\[/INST\]"), F.lit(1))


def instruction_label(record_input: Column, record_output: Column) -> Column:
    return F.when(F.length(record_input) > 0, record_input).otherwise(record_output)


def instructions(records: DataFrame, multiple: int = 1, row_id: str = "row_id") -> DataFrame:
    """(row_id, copy, prompt, label) from instruction records, repeated ``multiple`` times."""
    return records.select(
        row_id,
        F.explode(F.sequence(F.lit(1), F.lit(multiple))).alias("copy"),
        F.col("instruction").alias("prompt"),
        instruction_label(F.col("input"), F.col("output").cast("string")).alias("label"),
    )


def repeat_requests(prompts: DataFrame, n: int) -> DataFrame:
    """Each request n times with its own seq_no; the label stays beside it."""
    return prompts.withColumn("seq_no", F.explode(F.sequence(F.lit(1), F.lit(n))))


def run_generator(
    requests: DataFrame, prompt: str, fn: Callable[[Sequence[str]], Sequence[str]], batch: int = 2
) -> DataFrame:
    """Add ``predict`` by calling ``fn`` on lists of at most ``batch`` prompts inside tasks."""
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([*requests.schema.fields, StructField("predict", StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame[prompt].tolist()
            answers: list[str] = []
            for at in range(0, len(texts), batch):
                answers += list(fn(texts[at : at + batch]))
            yield frame.assign(predict=answers)

    return requests.mapInPandas(run, schema)


def echo_generator(texts: Sequence[str]) -> list[str]:
    """Deterministic stand-in: repeats the last line of the prompt behind a colon."""
    return [f"Here it is:{t.rsplit(chr(10), 1)[-1]}" for t in texts]


def paste_abstract(
    rows: DataFrame, row_id: str, predictions: DataFrame, predict: str = "predict"
) -> DataFrame:
    """(row_id, k, instruction, label): both mixed prompts with the row's abstract in place.

    Rows whose answer has no usable abstract drop out.
    """
    abstracts = predictions.select(
        F.col(row_id), answer_part(F.col(predict), strict=True).alias("_abs")
    ).filter(F.length("_abs") > 0)
    both = rows.join(abstracts, row_id).select(
        row_id, "label", "_abs",
        F.posexplode(F.array("mix_const_1", "mix_const_2")).alias("_k", "_mix"),
    )
    return both.select(
        row_id,
        (F.col("_k") + 1).alias("k"),
        F.replace("_mix", F.lit("$abs$"), F.col("_abs")).alias("instruction"),
        "label",
    )


def parsed_answers(predictions: DataFrame, predict: str = "predict") -> DataFrame:
    """Answers as (…, text): lenient parse, tidied; empty answers drop out."""
    return (
        predictions.withColumn("text", answer_part(F.col(predict), strict=False))
        .filter(F.length("text") > 0)
        .withColumn("text", tidy_answer(F.col("text")))
        .drop(predict)
    )


def unite(original: DataFrame, solo: DataFrame, mix_1: DataFrame, mix_2: DataFrame) -> DataFrame:
    """Original rows and the three kinds of generated rows as (part, text, label)."""
    parts = [original.select(F.lit("original").alias("part"), "text", "label")]
    for name, df in (("solo", solo), ("mix_1", mix_1), ("mix_2", mix_2)):
        parts.append(parsed_answers(df).select(F.lit(name).alias("part"), "text", "label"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
