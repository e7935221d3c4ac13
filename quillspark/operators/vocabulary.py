"""Word vocabulary, encoding and n-gram pattern features."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import fixed as fx
from quillspark.functions.binding import once
from quillspark.functions.text import ngrams_upto, vocabulary_tokens

CLS, SEP, UNK = 1, 2, 3


def vocabulary(docs: DataFrame, text: str, size: int = 20_000, min_frequency: int = 3) -> DataFrame:
    """(token, id, freq): special tokens first, then words by frequency; ``size`` in all."""
    spark = docs.sparkSession
    special = fx.SPECIAL_TOKENS
    counts = (
        docs.select(F.explode(vocabulary_tokens(F.col(text))).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("freq"))
        .filter(F.col("freq") >= min_frequency)
    )
    top = counts.orderBy(F.desc("freq"), "token").limit(size - len(special))
    # at most ``size`` rows are numbered
    order = Window.orderBy(F.desc("freq"), "token")
    words = top.select(
        "token", (F.row_number().over(order) + (len(special) - 1)).cast("int").alias("id"), "freq"
    )
    head = spark.createDataFrame([(t, i, 0) for i, t in enumerate(special)], "token string, id int, freq bigint")
    return head.unionByName(words)


def encode(docs: DataFrame, doc: str, text: str, vocab: DataFrame) -> DataFrame:
    """(doc, input_ids, tokens): [CLS] ids [SEP], unknown words as [UNK].

    The vocabulary, of bounded size as ``vocabulary`` makes it, goes to every task, which looks
    up the words of a document where they stand: no word is shuffled.
    """
    listed = vocab.select("token", F.col("id").cast("int").alias("id")).dropna(subset=["token"]).toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(listed.combine_chunks())

    @F.arrow_udf("array<int>")
    def look_up(tokens: pa.Array) -> pa.Array:
        table = shared.value
        at = pc.index_in(tokens.values, value_set=table["token"].combine_chunks())
        ids = pc.fill_null(table["id"].combine_chunks().take(at), UNK).cast(pa.int32())
        return pa.ListArray.from_arrays(tokens.offsets, ids)  # no list is null

    none = F.array().cast("array<string>")
    held = docs.select(F.col(doc).alias("doc"), F.coalesce(vocabulary_tokens(F.col(text)), none).alias("words"))
    full = held.withColumn("ids", look_up("words"))
    known = lambda w, i: F.when(i == UNK, fx.SPECIAL_TOKENS[UNK]).otherwise(w)
    return full.select(
        "doc",
        F.concat(F.array(F.lit(CLS)), "ids", F.array(F.lit(SEP))).alias("input_ids"),
        F.zip_with("words", "ids", known).alias("tokens"),
    )


def decode(encoded: DataFrame, doc: str, ids: str, vocab: DataFrame) -> DataFrame:
    """(doc, tokens) from ids."""
    places = (
        encoded.select(F.col(doc).alias("doc"), F.posexplode(once(ids)).alias("pos", "id"))
        .groupBy("doc", "id")
        .agg(F.collect_list("pos").alias("at"))
    )
    named = places.join(F.broadcast(vocab.select("id", "token")), "id", "left")
    items = F.flatten(F.collect_list(F.transform("at", lambda p: F.struct(p.alias("p"), F.col("token")))))
    return named.groupBy("doc").agg(F.transform(F.sort_array(items), lambda s: s["token"]).alias("tokens"))


def _gram_hits(docs: DataFrame, doc: str, tokens: str, patterns: DataFrame, side: str) -> DataFrame:
    """Occurrences of a side's patterns, as long as the longest of them is."""
    n = patterns.agg(F.max(F.size(F.split(side, " ")))).first()[0] or 1
    grams = docs.select(
        F.col(doc).alias("doc"),
        F.explode(F.array_distinct(F.transform(ngrams_upto(F.col(tokens), n), lambda g: F.array_join(g, " ")))).alias("gram"),
    )
    return grams.join(patterns.select("list_id", "pair_no", F.col(side).alias("gram")), "gram").select(
        "doc", "list_id", "pair_no", F.lit(side).alias("side")
    )


def ngram_pair_features(
    docs: DataFrame, doc: str, left: str, right: str, patterns: DataFrame
) -> DataFrame:
    """(doc, list_id): documents in which some pair of a list has its left n-gram on the
    left and its right n-gram on the right; ϵ on a side asks for the other side only.

    ``patterns`` is (list_id, pair_no, u, v) with n-grams as space-joined strings.
    """
    eps = lambda c: F.substring(F.col(c), 1, 1) == "ϵ"
    open_left, open_right = patterns.filter(eps("u")), patterns.filter(~eps("u") & eps("v"))
    closed = patterns.filter(~eps("u") & ~eps("v"))
    left_hits = _gram_hits(docs, doc, left, patterns.filter(~eps("u")), "u")
    right_hits = _gram_hits(docs, doc, right, open_left.unionByName(closed), "v")
    need = patterns.select("list_id", "pair_no", F.when(eps("u") | eps("v"), 1).otherwise(2).alias("need"))
    hits = left_hits.unionByName(right_hits).groupBy("doc", "list_id", "pair_no").agg(
        F.count(F.lit(1)).alias("got")
    )
    return hits.join(need, ["list_id", "pair_no"]).filter(F.col("got") == F.col("need")).select("doc", "list_id").distinct()


def right_ngram_features(
    docs: DataFrame, doc: str, right: str, patterns: DataFrame
) -> DataFrame:
    """(doc, list_id): any right n-gram of a list occurs; the left side is ignored."""
    return _gram_hits(docs, doc, right, patterns, "v").select("doc", "list_id").distinct()
