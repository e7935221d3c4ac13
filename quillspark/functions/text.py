"""Scalar text functions, all JVM-side column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.binding import let, once

# ---- fixed values: character classes that results depend on -------------------------
# Unicode white space as Python's str.split() sees it.
SPACE = r"\t\n\x0B\f\r \x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# Characters the cleaner keeps. The A-z range also holds [ \ ] ^ _ and the backtick.
KEPT = r"a-zA-z0-9.\-_,!?/:;\"'"
# The other characters, in two classes that take a step each: listed ASCII ones, and all beyond ASCII
# but the white space among them. One negated class of all ranges costs several times as much a character.
DROPPED = "".join(rf"\x{c:02X}" for c in (*range(9), *range(14, 28), 127, *map(ord, "#$%&()*+<=>@{|}~")))
BEYOND = r"[^\x00-\x7F](?<![\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}])"
TOKEN = r"[\p{L}\p{N}]+|'[\p{L}]+|[^\s\p{L}\p{N}]"
WORD = r"[\p{L}]+"
ALPHABETIC = r"^[A-Za-z]+$"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# -------------------------------------------------------------------------------------


def clean(text: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(text, f"[{DROPPED}]", ""), BEYOND, "")
    for old, new in (("\n", " "), ("\t", " "), ("  ", " "), ("'s", ""), ("\\n", " "), ("\\t", " ")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def words(text: Column) -> Column:
    """Split on runs of Unicode white space, no empty pieces."""
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def min_words(n: Column, halved: bool = False) -> Column:
    low = F.floor(n / 2) if halved else n
    return F.greatest(low.cast("int"), F.lit(5))


def max_words(n: Column) -> Column:
    return F.greatest(F.floor(n * 3 / 2).cast("int"), F.lit(10))


def sentences(text: Column) -> Column:
    """Cut after . ! ? followed by white space (rule-based; abbreviations also cut)."""
    marked = F.regexp_replace(text, r"([.!?])\s+", "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda s: F.trim(s) != "")


def sentence_key(n: Column) -> Column:
    return F.when(n == 1, "sentence").otherwise("sentences")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def content_tokens(tok: Column, stopwords: Column) -> Column:
    """Distinct tokens without quotes, clitic 's, stopwords, one-letter and blank ones."""
    kept = F.array_except(
        F.array_distinct(tok), F.concat(F.array(F.lit("''"), F.lit("'s")), stopwords)
    )
    return F.filter(kept, lambda w: (F.char_length(w) >= 2) & (F.trim(w) != ""))


def letter_runs(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def lower_words(text: Column) -> Column:
    """Distinct lower-case letter runs."""
    return F.array_distinct(letter_runs(text))


def is_alphabetic(word: Column) -> Column:
    return word.rlike(ALPHABETIC)


def lower_all(xs: Column) -> Column:
    return F.transform(xs, F.lower)


def ascii_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "")


def tidy_answer(text: Column, quotes_only: bool = False) -> Column:
    """Final tidy of a generated text: no quotes, no newlines, trimmed."""
    if quotes_only:
        return F.btrim(text, F.lit('"'))
    out = F.replace(F.replace(text, F.lit('"'), F.lit("")), F.lit("\n"), F.lit(""))
    return F.regexp_replace(out, f"^[{SPACE}]+|[{SPACE}]+$", "")


def strip_blank(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def answer_part(response: Column, strict: bool) -> Column:
    """The answer inside a response.

    The piece between the first and the second colon, its first non-blank paragraph.
    Without a colon: null when strict, else the whole response. All-blank pieces are null.
    """
    pieces = F.split(response, ":")
    paragraphs = F.filter(F.split(F.get(pieces, F.lit(1)), "\n\n"), lambda p: strip_blank(p) != "")
    found = F.get(paragraphs, F.lit(0))
    plain = F.lit(None).cast("string") if strict else F.nullif(response, F.lit(""))
    return F.when(F.size(pieces) > 1, found).otherwise(plain)


def label_words(text: Column) -> Column:
    """Words for tag files: comma and full stop are tokens of their own."""
    return F.regexp_extract_all(text, F.lit(f"[,.]|[^,.{SPACE}]+"), F.lit(0))


def subst_tokens(text: Column) -> Column:
    """Tokens for substitution: hyphens open up, punctuation inside tokens goes."""
    tok = tokens(F.replace(text, F.lit("-"), F.lit(" ")))
    return F.transform(
        tok,
        lambda w: F.when(F.lit(PUNCTUATION).contains(w), w).otherwise(F.translate(w, PUNCTUATION, "")),
    )


def concept(text: Column) -> Column:
    """Generated concept: no # and ., trimmed, lower-case."""
    return F.lower(strip_blank(F.translate(text, "#.", "")))


def marker_clean(token: Column, repl: str = "_") -> Column:
    return F.replace(token, F.lit("Ġ"), F.lit(repl))


def span_clean(span: Column) -> Column:
    return F.regexp_replace(F.replace(span, F.lit("_"), F.lit("")), r"\s+", " ")


def _accent_table() -> tuple[str, str]:
    """Latin letters whose canonical decomposition starts with another letter."""
    src, dst = [], []
    for lo, hi in ((0xC0, 0x250), (0x1E00, 0x1F00)):
        for code in range(lo, hi):
            base = unicodedata.normalize("NFD", chr(code))
            if len(base) > 1:
                src.append(chr(code))
                dst.append(base[0])
    return "".join(src), "".join(dst)


def strip_accents(text: Column) -> Column:
    src, dst = _accent_table()
    return F.regexp_replace(F.translate(text, src, dst), r"\p{Mn}", "")


def vocabulary_tokens(text: Column) -> Column:
    """Lower-case, accent-free words; each punctuation character stands alone."""
    plain = F.lower(strip_accents(text))
    return F.regexp_extract_all(
        plain, F.lit(rf"[^\p{{P}}$+<=>^`|~{SPACE}]+|[\p{{P}}$+<=>^`|~]"), F.lit(0)
    )


def ngrams(xs: Column, n: int) -> Column:
    """Contiguous n-grams as arrays; none when the list is shorter."""
    def cut(ys: Column) -> Column:
        count = F.size(ys) - (n - 1)
        starts = F.filter(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: i <= count)
        return F.transform(starts, lambda i: F.slice(ys, i, n))

    return let(xs, cut)


def ngrams_upto(xs: Column, n: int) -> Column:
    return let(xs, lambda ys: F.flatten(F.array(*[ngrams(ys, k) for k in range(1, n + 1)])))


def counted_ngrams(rows: DataFrame, words: str, n: int) -> DataFrame:
    """(gram, n): the contiguous 1- to n-grams of an array of words, joined by blanks, and how often they occur.

    Every place of a list is a row with the words that follow; no array is made per gram.
    """
    shifted = [F.slice(words, k + 1, F.greatest(F.size(words), F.lit(0))).alias(f"w{k}") for k in range(n)]
    places = rows.select(F.explode(once(F.arrays_zip(*shifted))).alias("p")).select("p.*")
    starts = F.array(*[
        # null where the list ends before
        F.concat(*[x for j in range(k + 1) for x in (F.lit(" "), F.col(f"w{j}"))][1:]) for k in range(n)
    ])
    grams = places.select(F.explode(starts).alias("gram")).filter("gram is not null")
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def literal_list(text: Column) -> Column:
    """A Python-style list literal of strings as an array; nothing is evaluated."""
    return F.from_json(
        text, "array<string>", {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}
    )
