"""From raw documents to token ids: the stages of a training corpus.

Every stage takes the documents its predecessor kept, with the columns of ``documents``;
the last one gives token ids. No stage can be put in SQL as a whole because of the
classifier, so the pipeline is tested against brute-force versions.

Ids may be null or repeated, so stages tell rows apart by a number or by 128 bits of hash of all
columns, never by ``doc_id``. Helper columns take names that the documents do not have.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.bpe import round_trip
from quillspark.llm.common import Scratch, table
from quillspark.llm.lines import dedup_lines
from quillspark.llm.mixing import mix, schedule
from quillspark.llm.near_dup import near_duplicates
from quillspark.llm.quality import quality


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go. Learns from the labelled rows of ``docs``."""
    return quality(docs, table(spark, sf_dir, "labels"), keep=docs.columns).filter("predicted <> 0").select("kept.*")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: texts lose lines that an earlier line repeats, up to one edit."""
    out = dedup_lines(docs).withColumn("n_chars", F.length("text").cast("bigint"))
    return out.select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: the first row of every near-duplicate group stays, by id (null last).

    Every row is a document, with an id of its own or not; of equal rows one stays. Rows
    without words are in no group and stay.
    """
    scratch, row = Scratch(spark, "one-of-each"), unused(docs, "_row")
    rows = scratch.keep(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    groups = near_duplicates(rows, id_col=row).filter("n_shingles > 0").select(F.col("doc_id").alias("no"), "component_id")
    groups = scratch.keep(groups, "groups")
    many = groups.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("component_id")
    ids = rows.select(F.col(row).alias("no"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(row).alias("no")).alias("at"))
    members = groups.join(many, "component_id").join(ids, "no")
    members = scratch.keep(members.select("component_id", "at"), "members")
    first = members.groupBy("component_id").agg(F.min("at").alias("first"))
    gone = members.join(first, "component_id").filter("at.no <> first.no").select(F.col("at.no").alias(row))
    return rows.join(gone, row, "left_anti").select(docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: a row for every copy taken, in the order of training; rows not taken go."""
    scratch = Scratch(spark, "mixed")
    rows, key = keyed(docs)
    at = unused(rows, "_at")
    order = schedule(mix(rows, keep=key), keep=key).select(*key, F.col("position").alias(at))
    # equal rows stand once on the side of the texts and with all their copies on the other
    out = once(rows, key, scratch).join(order, key)
    return out.orderBy(at, "doc_id", *key).select(docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: ids of every text, and the digest of what they decode to.

    ``shard`` and ``row`` are the file and the row in it that a text was read from. The stage
    before writes its files in order, so (shard, row) is the order of training. Both are null
    for documents that were not read from files.
    """
    try:
        held = docs.select(F.struct("doc_id", F.col("_metadata.file_name").alias("shard"), F.col("_metadata.row_index").alias("row")).alias("doc_id"), "text")
    except AnalysisException:  # not a scan of files
        held = docs.select(F.struct("doc_id", F.lit(None).cast("string").alias("shard"), F.lit(None).cast("long").alias("row")).alias("doc_id"), "text")
    out = round_trip(held)
    return out.select(
        "doc_id.doc_id", F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"), "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"), "doc_id.shard", "doc_id.row",
    )


def unused(docs: DataFrame, name: str) -> str:
    """``name``, or longer, so that ``docs`` has no such column."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def keyed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with two 64-bit hashes of all columns, and their names; a null is not skipped but hashed as one."""
    values = [x for c in docs.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    key = [unused(docs, "_row"), unused(docs, "_again")]
    return docs.withColumns({key[0]: F.xxhash64(*values), key[1]: F.xxhash64(F.lit("again"), *values)}), key


def once(rows: DataFrame, key: list[str], scratch: Scratch) -> DataFrame:
    """One of equal rows; only repeated rows are shuffled."""
    repeated = scratch.keep(rows.groupBy(*key).count().filter("count > 1").select(*key), "repeated")
    return rows.join(repeated, key, "left_anti").unionByName(rows.join(repeated, key, "left_semi").dropDuplicates(key))


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", without_repeated_lines),
    ("minhash near-dedup", one_of_each_group),
    ("mixing sources", mixed_sources),
    ("byte-level bpe", token_ids),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of the mixed corpus of ``documents``; every stage is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
