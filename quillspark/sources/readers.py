"""Readers: files to DataFrames with a row_id where rows need an identity.

``row_id`` comes from the file's own id column where there is one. Plain TSV rows have
none, so it is the order of the rows inside the file (file part, position), unique and
repeatable for the same files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.text import SPACE, literal_list

TSV = {"sep": "\t", "quote": '"', "escape": '"', "multiLine": "true"}
PREDICTION = "row_id bigint, seq_no int, label string, predict string"


def with_row_id(df: DataFrame) -> DataFrame:
    return df.withColumn("row_id", F.monotonically_increasing_id())


def read_tsv(spark: SparkSession, path, header: bool = True) -> DataFrame:
    return spark.read.options(**TSV).option("header", header).csv(path)


def read_labelled(spark: SparkSession, path, debug: int | None = None) -> DataFrame:
    """(row_id, text, label); a header of literal 0 and 1 is renamed. ``debug`` keeps the
    first rows only."""
    df = read_tsv(spark, path)
    if "0" in df.columns:
        df = df.withColumnRenamed("0", "text").withColumnRenamed("1", "label")
    out = with_row_id(df)
    return out.orderBy("row_id").limit(debug) if debug else out


def read_pairs(spark: SparkSession, path) -> DataFrame:
    """(row_id, uid, text1, text2, label[, label_name], details)."""
    df = with_row_id(read_tsv(spark, path))
    if "sentence1" in df.columns:
        df = df.withColumnRenamed("sentence1", "text1").withColumnRenamed("sentence2", "text2")
    own = F.col("uid") if "uid" in df.columns else F.lit(None).cast("string")
    df = df.withColumn("uid", F.coalesce(own.cast("string"), F.col("row_id").cast("string")))
    if "review_id" in df.columns:
        df = df.withColumn("details", F.create_map(F.lit("original_uid"), F.col("review_id").cast("string")))
    return df


def read_ids(spark: SparkSession, path) -> DataFrame:
    """Headerless (title, id) list."""
    return read_tsv(spark, path, header=False).toDF("title", "id")


def parse_tagged(df: DataFrame, tokens: str = "tokens", tags: str = "ner_tags") -> DataFrame:
    """Turn list literals into arrays."""
    return df.withColumn(tokens, literal_list(F.col(tokens))).withColumn(tags, literal_list(F.col(tags)))


def read_tagged(spark: SparkSession, path) -> DataFrame:
    return parse_tagged(with_row_id(read_tsv(spark, path)))


def parse_conll(block: Column) -> tuple[Column, Column, Column]:
    """(id line, tokens, tags) of one block of token<TAB>tag lines."""
    lines = F.filter(F.split(block, "\r?\n"), lambda s: F.trim(s) != "")
    about = F.get(F.filter(lines, lambda s: s.startswith("# id")), F.lit(0))
    rows = F.filter(lines, lambda s: ~s.startswith("# id"))
    cut = lambda s: F.split(s, "\t")
    return (
        about,
        F.transform(rows, lambda s: F.get(cut(s), F.lit(0))),
        F.transform(rows, lambda s: F.element_at(cut(s), -1)),
    )


def conll_sentences(df: DataFrame, block: str) -> DataFrame:
    """Replace a text block column by about, tokens and ner_tags; blank blocks drop."""
    about, tokens, tags = parse_conll(F.col(block))
    return (
        df.withColumn("about", about).withColumn("tokens", tokens).withColumn("ner_tags", tags)
        .filter(F.size("tokens") > 0).drop(block)
    )


_RUN = "file string, part long, no long, first boolean, last boolean, row_id long, value string"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of lines (file, part, line, value) between blank ones, joined by line feeds, as _RUN.

    A split of a file comes as a whole, its lines in order. Its first and its last run, empty
    ones too, may go on in the splits beside it; a split without a blank line is both.
    """
    key, no, start, held, out = None, 0, None, [], []

    def done(last: bool) -> None:
        out.append((*key, no, no == 0, last, start, "\n".join(held)))

    def found() -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.string()]
        names = [c.split()[0] for c in _RUN.split(", ")]
        return pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        file, part, line, value = batch.columns
        number, at = file.dictionary_encode().indices.to_numpy(), part.to_numpy()
        cuts = np.flatnonzero((np.diff(number) != 0) | (np.diff(at) != 0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if lo == hi:
                continue
            now = file[int(lo)].as_py(), int(at[lo])
            if now != key:
                if key:
                    done(True)
                key, no, start, held = now, 0, None, []
            for i, v in enumerate(value.slice(lo, hi - lo).to_pylist(), int(lo)):
                if v and not v.isspace():
                    if not held:
                        start = line[i].as_py()
                    held.append(v)
                elif held or no == 0:
                    done(False)
                    no, held = no + 1, []
        if out:
            yield found()
            out = []
    if key:
        done(True)
        yield found()


def sentence_rows(lines: DataFrame) -> DataFrame:
    """(row_id, value) of lines (file, part, line, value) as they were read: blank lines end a
    sentence, whose number is that of its first line.

    Sentences are put together where a split is read, so that a large file is many tasks; only
    the two runs at the ends of a split are shuffled.
    """
    runs = lines.select("file", "part", "line", "value").mapInArrow(_runs, _RUN)
    inner = runs.filter("not first and not last").select("row_id", "value")
    # the last run of a split with a blank line opens a sentence; first runs after it go on with it
    upto = Window.partitionBy("file").orderBy("part", "no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = runs.filter("first or last").withColumn("sentence", F.sum((~F.col("first")).cast("long")).over(upto))
    pieces = F.sort_array(F.collect_list(F.struct("part", "no", "row_id", "value")))
    joined = ends.filter("value <> ''").groupBy("file", "sentence").agg(pieces.alias("rows")).select(
        F.get("rows", F.lit(0))["row_id"].alias("row_id"), F.array_join(F.transform("rows", lambda r: r["value"]), "\n").alias("value")
    )
    return inner.filter("value <> ''").unionByName(joined)


def read_conll(spark: SparkSession, path) -> DataFrame:
    """(row_id, about, tokens, ner_tags), one row per sentence; sentences end at a blank line,
    which may hold white space, and lines at LF, CR or CRLF."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"),
        F.monotonically_increasing_id().alias("line"), "value",
    )
    return conll_sentences(sentence_rows(lines), "value").select("about", "tokens", "ner_tags", "row_id")


def _json(spark: SparkSession, schema: str, path, layout: str) -> DataFrame:
    """JSON records: ``lines`` (one a line, splittable) or ``array`` (a file is one value)."""
    if layout not in ("lines", "array"):
        raise ValueError(f"layout must be lines or array, not {layout!r}")
    return spark.read.schema(schema).option("multiLine", layout == "array").json(path)


def read_instructions(spark: SparkSession, path, layout: str = "lines") -> DataFrame:
    """(row_id, instruction, input, output) from JSON lines or JSON arrays."""
    return with_row_id(_json(spark, "instruction string, input string, output string", path, layout))


def read_predictions(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema(PREDICTION).json(path)


_SIDE = "struct<text:string>"
TREE_PREDICTION = (
    f"e struct<uid:string,text:string,a:{_SIDE},b:{_SIDE},label:int,"
    "details:struct<original_uid:string>>, tree string"
)


def flatten_tree_predictions(df: DataFrame, names: list[str]) -> DataFrame:
    """(uid, sentence, sentence1, sentence2, review_id, label, label_name, tree)."""
    return df.select(
        F.col("e.uid").alias("uid"),
        F.col("e.text").alias("sentence"),
        F.col("e.a.text").alias("sentence1"),
        F.col("e.b.text").alias("sentence2"),
        F.col("e.details.original_uid").alias("review_id"),
        F.col("e.label").alias("label"),
        F.get(F.array(*[F.lit(n) for n in names]), F.col("e.label")).alias("label_name"),
        "tree",
    )


def read_tree_predictions(
    spark: SparkSession, paths: dict[str, str], names: list[str], layout: str = "lines"
) -> DataFrame:
    """Tree predictions of several splits, with an explicit split column."""
    parts = [
        flatten_tree_predictions(_json(spark, TREE_PREDICTION, p, layout), names)
        .withColumn("split", F.lit(s))
        for s, p in paths.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_splits(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """TSV per split, with a split column and uid as string; missing files are skipped."""
    out = None
    for split, path in paths.items():
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path):
            continue
        df = with_row_id(read_tsv(spark, path)).withColumn("split", F.lit(split))
        df = df.withColumn("uid", F.col("uid" if "uid" in df.columns else "row_id").cast("string"))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(", ".join(paths.values()))
    return out


EXAMPLE = (
    "uid string, text string, a struct<uid:string,text:string>, "
    "b struct<uid:string,text:string>, label string"
)


def read_examples(spark: SparkSession, path, layout: str = "lines") -> DataFrame:
    """Example JSON: (row_id, uid, text, a, b, label); see operators.examples for defaults."""
    return with_row_id(_json(spark, EXAMPLE, path, layout))


def parse_prefixed(line: Column) -> tuple[Column, Column]:
    """(label, text) of a line such as "0 some text"."""
    bare = F.regexp_replace(line, f"^[{SPACE}]+|[{SPACE}]+$", "")
    return F.substring(bare, 1, 1).cast("int"), F.substr(bare, F.lit(3))


def read_prefixed(spark: SparkSession, path) -> DataFrame:
    label, text = parse_prefixed(F.col("value"))
    return with_row_id(spark.read.text(path)).select("row_id", label.alias("label"), text.alias("text"))


def read_metrics(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Metric files of runs laid out as …/<method>/s<seed>/<file>.json; absent runs are
    simply not matched by the pattern."""
    path = F.input_file_name()
    return spark.read.schema(schema).option("multiLine", True).json(pattern).select(
        F.regexp_extract(path, r"([^/]+)/s\d+/[^/]+$", 1).alias("method"),
        F.regexp_extract(path, r"/s(\d+)/[^/]+$", 1).cast("int").alias("seed"),
        "*",
    )


def leaves(df: DataFrame, text: str, depth: int = 8) -> DataFrame:
    """``df`` with path and value in place of ``text``: a row for every number of a JSON text of unknown shape.

    ``path`` joins keys and array places (from 0) by dots. An object opens level by level, a value
    that is none stays as it is; what lies deeper than ``depth`` levels, text, true, false, null and
    texts that are no JSON give no row.
    """
    rest = [c for c in df.columns if c != text]
    none = F.array().cast("array<string>")
    level = df.select(*rest, F.try_parse_json(F.col(text)).alias("_v"), none.alias("_path"))
    for _ in range(depth):
        inner = df.sparkSession.tvf.variant_explode_outer(F.col("_v").outer())
        step = F.coalesce("key", F.col("pos").cast("string"))
        level = level.lateralJoin(inner).select(
            *rest, F.coalesce("value", "_v").alias("_v"),
            F.when(step.isNull(), F.col("_path")).otherwise(F.array_append("_path", step)).alias("_path"),
        )
    number = F.schema_of_variant("_v").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return level.filter(number).select(*rest, F.array_join("_path", ".").alias("path"), F.try_variant_get("_v", "$", "double").alias("value"))


def read_reports(spark: SparkSession, pattern: str, depth: int = 8) -> DataFrame:
    """(method, seed, path, value) of nested metric files laid out as …/<method>/s<seed>/<file>; one JSON text a file."""
    path = F.col("_metadata.file_path")
    texts = spark.read.text(pattern, wholetext=True).select(
        F.regexp_extract(path, r"([^/]+)/s\d+/[^/]+(/[^/]+)?$", 1).alias("method"),
        F.regexp_extract(path, r"/s(\d+)/[^/]+(/[^/]+)?$", 1).cast("int").alias("seed"),
        "value",
    )
    return leaves(texts.withColumnRenamed("value", "_text"), "_text", depth)
