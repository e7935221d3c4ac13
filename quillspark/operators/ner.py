"""Entity tags: spans out of tagged tokens, glosses, and tags painted on new text."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from quillspark.functions import fixed as fx
from quillspark.functions.binding import let, once
from quillspark.functions.text import is_alphabetic, label_words

#: White space that parts the words of a phrase: that of ``\s`` in Spark's patterns.
BLANKS = re.compile(r"[ \t\n\x0b\f\r]+")
#: The words of ``label_words``; ``\s`` of Python's patterns is the white space listed there.
LABEL_WORDS = re.compile(r"[,.]|[^,.\s]+")


def _positions(tags: Column, test) -> Column:
    """1-based positions for which test(i) holds; none for an empty list."""
    n = F.size(tags)
    return F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & test(i))


def _tag(tags: Column, i: Column) -> Column:
    return F.coalesce(F.get(tags, (i - 1).cast("int")), F.lit("O"))


def spans(tokens: Column, tags: Column, split_on_b: bool = False) -> Column:
    """array<struct<phrase, tag, first, last>> of the maximal runs of non-O tags.

    A run takes its last B- tag ("" without one). Adjacent entities merge unless
    ``split_on_b``.
    """

    def opens(tags: Column, i: Column) -> Column:
        begins = _tag(tags, i - 1) == "O"
        if split_on_b:
            begins = begins | _tag(tags, i).startswith("B-")
        return (_tag(tags, i) != "O") & begins

    def closes(tags: Column, i: Column) -> Column:
        ends = _tag(tags, i + 1) == "O"
        if split_on_b:
            ends = ends | _tag(tags, i + 1).startswith("B-")
        return (_tag(tags, i) != "O") & ends

    def describe(tokens: Column, tags: Column, r: Column) -> Column:
        length = r["l"] - r["f"] + 1
        begun = F.filter(F.slice(tags, r["f"], length), lambda t: t.startswith("B-"))
        return F.struct(
            F.array_join(F.slice(tokens, r["f"], length), " ").alias("phrase"),
            F.coalesce(F.try_element_at(begun, F.lit(-1)), F.lit("")).alias("tag"),
            r["f"].alias("first"),
            r["l"].alias("last"),
        )

    def find(row: Column) -> Column:
        ws, ts = row["ws"], row["ts"]
        runs = F.arrays_zip(
            _positions(ts, lambda i: opens(ts, i)).alias("f"), _positions(ts, lambda i: closes(ts, i)).alias("l")
        )
        return F.transform(runs, lambda r: describe(ws, ts, r))

    return let(F.struct(tokens.alias("ws"), tags.alias("ts")), find)


def with_spans(
    df: DataFrame, tokens: str, tags: str, split_on_b: bool = False, flush_last: bool = False
) -> DataFrame:
    """Add all_phrases (for the include list), ner_phrases and ner_phrase_tags.

    A span that ends the sentence is in all_phrases only, unless ``flush_last``.
    """
    found = df.withColumn("_s", spans(F.col(tokens), F.col(tags), split_on_b))
    closed = F.col("_s") if flush_last else let(
        F.size(tags), lambda n: F.filter("_s", lambda s: s["last"] < n)
    )
    return (
        found.withColumn("all_phrases", F.transform("_s", lambda s: s["phrase"]))
        .withColumn("_s", closed)
        .withColumn("ner_phrases", F.transform("_s", lambda s: s["phrase"]))
        .withColumn("ner_phrase_tags", F.transform("_s", lambda s: s["tag"]))
        .drop("_s")
    )


def plain_words(tokens: Column, tags: Column, stopwords: Column) -> Column:
    """Alphabetic words outside entities that are no stopwords."""
    pairs = F.filter(
        F.arrays_zip(tokens.alias("w"), tags.alias("t")),
        lambda p: (p["t"] == "O") & is_alphabetic(p["w"]) & ~F.array_contains(stopwords, p["w"]),
    )
    return F.transform(pairs, lambda p: p["w"])


def gloss_map(dataset: str) -> Column:
    """Tag -> gloss as a constant map; a handful of entries per dataset, which must be known."""
    if dataset not in fx.GLOSSES:
        raise ValueError(f"no glosses for dataset {dataset!r}; known: {', '.join(fx.GLOSSES)}")
    entries = [F.lit("O"), F.lit("other")]
    for kind, gloss in fx.GLOSSES[dataset].items():
        for prefix in ("B-", "I-"):
            entries += [F.lit(prefix + kind), F.lit(gloss)]
    return F.create_map(*entries)


def gloss_text(phrases: Column, tags: Column, glosses: Column) -> Column:
    """"X is person, Y is location"; a tag without gloss is an error upstream, "?" here."""
    lines = F.transform(
        F.arrays_zip(phrases.alias("p"), tags.alias("t")),
        lambda s: F.concat(
            s["p"], F.lit(" is "), F.coalesce(F.try_element_at(glosses, s["t"]), F.lit("?"))
        ),
    )
    return F.array_join(lines, ", ")


def painted(words: list[str], phrases: list[str | None], tags: list[str | None]) -> tuple[list[str], list[int]]:
    """Tags of the words of a row, and the places of the phrases that never occur; lower-case words and phrases."""
    wanted: dict[tuple[str, ...], list[int]] = {}
    for ord_, phrase in enumerate(phrases):
        if phrase is not None:
            wanted.setdefault(tuple(w for w in BLANKS.split(phrase) if w), []).append(ord_)
    places: dict[str, list[int]] = {p[0]: [] for p in wanted if p}
    for i, word in enumerate(words):
        if word in places:
            places[word].append(i)
    out, lost, found = ["O"] * len(words), [], []
    for phrase, ords in wanted.items():
        n, pw = len(phrase), list(phrase)
        starts = [i for i in places[pw[0]] if n == 1 or words[i : i + n] == pw] if n else []
        if starts:
            found.append((ords[-1], n, starts))  # equal phrases cover the same places: the last of them paints
        else:
            lost += ords
    for ord_, n, starts in sorted(found):
        tag = tags[ord_]
        first, inner = ("O", "O") if tag is None else (tag, "I-" + tag.split("-")[-1])
        for i in starts:
            out[i : i + n] = [first, *[inner] * (n - 1)]
    return out, sorted(lost)


@F.arrow_udf(StructType().add("tags", ArrayType(StringType())).add("lost", ArrayType(IntegerType())))  # not as DDL: that needs a session
def _painted(texts: pa.Array, phrases: pa.Array, tags: pa.Array) -> pa.Array:
    made = []
    for text, ps, ts in zip(texts, phrases, tags, strict=True):
        low = [p and p.lower() for p in ps.as_py()]
        made.append(painted([w.lower() for w in LABEL_WORDS.findall(text.as_py() or "")], low, ts.as_py()))
    parts = [pa.array([m[0] for m in made], pa.list_(pa.string())), pa.array([m[1] for m in made], pa.list_(pa.int32()))]
    return pa.StructArray.from_arrays(parts, names=["tags", "lost"])


def paint_rows(df: DataFrame, row_id: str, text: str, phrases: str, tags: str) -> DataFrame:
    """Tag a generated text: (id, words, tags, missing), missing being the (ord, phrase) that never occur.

    Each phrase matches case-insensitively at every position; its first word takes the
    tag, the rest I-; later phrases overwrite earlier ones. Words and phrases of a row meet by
    first word in an index inside the row (``painted``), so work follows the matches and nothing is shuffled.
    """
    ents = F.coalesce(F.arrays_zip(F.col(phrases).alias("p"), F.col(tags).alias("t")), F.array().cast("array<struct<p: string, t: string>>"))
    rows = df.select(F.col(row_id).alias("id"), F.col(text).alias("text"), ents.alias("ents"))
    made = rows.withColumn("r", _painted("text", F.transform("ents", lambda e: e["p"]), F.transform("ents", lambda e: e["t"])))
    words = F.coalesce(label_words(F.col("text")), F.array().cast("array<string>"))
    missing = let(F.col("ents"), lambda es: F.transform("r.lost", lambda i: F.struct(i.alias("ord"), F.get(es, i)["p"].alias("phrase"))))
    return made.select("id", words.alias("words"), "r.tags", missing.alias("missing"))


def paint(df: DataFrame, row_id: str, text: str, phrases: str, tags: str) -> tuple[DataFrame, DataFrame]:
    """(id, words, tags) and (id, ord, phrase) of the phrases that never occur; see ``paint_rows``."""
    out = paint_rows(df, row_id, text, phrases, tags)
    missing = out.select("id", F.explode(once("missing")).alias("m")).select("id", "m.ord", "m.phrase")
    return out.select("id", "words", "tags"), missing


def conll_block(words: Column, tags: Column) -> Column:
    """token<TAB>tag lines of one sentence, each ended by a newline."""
    lines = F.transform(
        F.arrays_zip(words.alias("w"), tags.alias("t")),
        lambda p: F.concat(p["w"], F.lit("\t"), p["t"]),
    )
    return F.array_join(lines, "\n")
