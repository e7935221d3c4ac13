"""Part-of-speech helpers over token / tag columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pos_sequence(tags: Column) -> Column:
    return F.array_join(tags, " ")


def words_of_class(tokens: Column, tags: Column, test) -> Column:
    """Distinct words whose tag passes the test."""
    kept = F.filter(F.arrays_zip(tokens.alias("w"), tags.alias("t")), lambda p: test(p["t"]))
    return F.array_distinct(F.transform(kept, lambda p: p["w"]))


def word_lists(df: DataFrame, tokens: str, tags: str, stopwords: Column) -> DataFrame:
    """Add pos_seq, nouns, verbs, others (content words only)."""
    skip = F.concat(F.array(F.lit("''"), F.lit("'s")), stopwords)
    pairs = F.filter(
        F.arrays_zip(F.col(tokens).alias("w"), F.col(tags).alias("t")),
        lambda p: ~F.array_contains(skip, p["w"]) & (F.char_length(p["w"]) >= 2) & (F.trim(p["w"]) != ""),
    )
    of = lambda test: F.array_distinct(F.transform(F.filter("_p", lambda p: test(p["t"])), lambda p: p["w"]))
    return (
        df.withColumn("_p", pairs)
        .withColumn("pos_seq", pos_sequence(F.col(tags)))
        .withColumn("nouns", of(lambda t: t == "NOUN"))
        .withColumn("verbs", of(lambda t: t == "VERB"))
        .withColumn("others", of(lambda t: ~t.isin("NOUN", "VERB")))
        .drop("_p")
    )


def wordnet_class(penn: Column) -> Column:
    """Penn tag -> a, v, n, r or empty."""
    first = F.substring(penn, 1, 1)
    return (
        F.when(first == "J", "a").when(first == "V", "v").when(first == "N", "n")
        .when(first == "R", "r").otherwise("")
    )
