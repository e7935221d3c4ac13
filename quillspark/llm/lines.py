"""Line dedup by a deletion-neighbourhood join: lines within one word edit of an earlier one go.

The unit of an edit is a word (insert, delete or replace one). Lines of fewer than
``MIN_WORDS`` words have an edit bound of 0: they go only if an earlier line has the same
words. Longer ones have a bound of 1 and emit hashed variants with one word left out. Two
kinds of variant suffice for one edit: *replaced* (both lines without the word at the same
place) and *deleted* (one line without a word is the other line).

All lines that share a replaced variant are within one edit of each other, so each of them
meets only the earliest; a deleted variant meets whole lines only. No group becomes its
pairs. Matches are verified by the words before a line goes.

Before variants are made, lines that share neither their first nor their last half with
another line are set aside: one edit leaves one of the halves as it is.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Scratch, words_of

MIN_WORDS = 8
#: Sums of word hashes stay below 2**63 for lines of up to 2**23 words.
HASH_BITS = 40
BLANKS = " \t\n\x0b\x0c\r"
#: Bits of a sieve: 16 for a row looked for, these at least and most (16 MB).
SIEVE_BITS = 1 << 20, 1 << 27


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w).bitwiseAND((1 << HASH_BITS) - 1))


def halves(words: Column) -> list[Column]:
    """Hashes of the halves that one edit can leave: of (n - 1) / 2 words at both ends, then of
    n / 2 words at both ends (null for an odd n, where they are the same)."""
    n = F.size(words)
    short, long = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    first = lambda k: F.xxhash64(F.lit("f"), k, F.slice(words, F.lit(1), k))
    last = lambda k: F.xxhash64(F.lit("l"), k, F.slice(words, n - k + 1, k))
    even = lambda c: F.when(n % 2 == 0, c)
    return [first(short), last(short), even(first(long)), even(last(long))]


def within_one(a: str, b: str) -> Column:
    """Whether word lists a and b are at most one edit apart: they agree but for one place."""
    same = f"zip_with({{0}}, {{1}}, (x, y) -> x <=> y)"
    lead = f"array_position({same.format(a, b)}, false)"
    tail = f"array_position({same.format(f'reverse({a})', f'reverse({b})')}, false)"
    upto = lambda p: f"(case when {p} = 0 then least(size({a}), size({b})) else {p} - 1 end)"
    return F.expr(
        f"abs(size({a}) - size({b})) <= 1 and {upto(lead)} + {upto(tail)} >= greatest(size({a}), size({b})) - 1"
    )


class Sieve:
    """Which rows of ``docs`` a small table of rows may hold, told where a text is read.

    The hashes of the rows looked for set bits in bitmaps of 4 KB, broadcast together. A text
    whose bit is not set is in none of the rows looked for and need not be shuffled to learn
    that; the others are joined by their rows. Above the bound on bits more texts pass, no result changes.
    """

    def __init__(self, rows: DataFrame, scratch: Scratch):
        least, most = SIEVE_BITS
        self.bits = min(most, max(least, 1 << (16 * rows.count()).bit_length()))
        bit = rows.select((self.bit() + 1).alias("bit"))  # buckets and places count from bit 1
        maps = bit.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
        self.maps = scratch.keep(maps, "sieve")

    def bit(self) -> Column:
        return F.pmod(F.xxhash64("row"), F.lit(self.bits))

    def part(self, docs: DataFrame, passing: bool) -> DataFrame:
        """The rows of ``docs`` (with a column row) that pass, or those that do not."""
        held = docs.withColumn("bit", self.bit()).withColumn("bucket", F.bitmap_bucket_number(F.col("bit") + 1))
        held = held.join(F.broadcast(self.maps), "bucket", "left")
        byte = F.conv(F.hex(F.expr("substring(bits, cast(bit % 32768 div 8 as int) + 1, 1)")), 16, 10).cast("int")
        hit = byte.bitwiseAND(F.expr("shiftleft(1, cast(bit % 8 as int))")) != 0
        hit = F.coalesce(hit, F.lit(False))  # no bit is set in a bucket without bitmap
        return held.filter(hit if passing else ~hit).select(docs.columns)


class Places:
    """The place of a line as one long that sorts by row, then line: part, offset, line.

    Rows are sorted and written once; a row's number is its part of that table and its offset
    there. The widths of the three fields come from the largest values that occur.
    """

    def __init__(self, docs: DataFrame, scratch: Scratch):
        counted = docs.select("row", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("n"))
        rows = counted.groupBy("row").agg(F.max("n").alias("n")).orderBy("row").withColumn("at", F.monotonically_increasing_id())
        self.rows = scratch.keep(rows, "rows")
        part, offset = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
        most = self.rows.agg(*(F.coalesce(F.max(c), F.lit(0)).cast("long") for c in (part, offset, F.col("n")))).first()
        parts, self.inner, self.line = (int(m).bit_length() for m in most)
        if parts + self.inner + self.line > 63:
            raise ValueError("rows and lines do not fit into 63 bits")
        number = F.shiftleft(part, self.inner).bitwiseOR(offset)
        self.rows = self.rows.select("row", number.alias("no"))

    def at(self) -> Column:
        return F.shiftleft("no", self.line).bitwiseOR(F.col("line").cast("long"))

    def of(self, at: Column) -> list[Column]:
        return [F.shiftright(at, self.line).alias("no"), at.bitwiseAND((1 << self.line) - 1).cast("int").alias("line")]


def repeated_lines(docs: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, line) of every line that goes; ``docs`` has row (in order) and text.

    Small tables are written before they are joined, so that their sizes are known and a join
    with one below the session's broadcast threshold shuffles nothing.
    """
    places = Places(docs, scratch)
    # blank lines are told by their text: a filter on the words would be pushed below them and make them twice
    lines = docs.select("row", F.posexplode(F.split("text", "\n", -1)).alias("line", "body"))
    lines = lines.filter(F.trim("body", F.lit(BLANKS)) != "").select("row", "line", words_of(F.col("body")).alias("words"))
    # a line is known by its hash and two more: of its outer halves if it is long, else of itself
    long, (a, b, c, d) = F.size("words") >= min_words, halves(F.col("words"))
    own = [F.xxhash64("words").alias("h"), F.when(long, a).otherwise(F.xxhash64(F.lit(1), "words")).alias("a"), F.when(long, b).otherwise(F.lit(0)).alias("b")]
    inner = [F.when(long, c).alias("c"), F.when(long, d).alias("d"), long.alias("long")]
    hashed = lines.select("row", "line", *own, *inner).join(places.rows, "row")
    where = scratch.keep(hashed.select(places.at().alias("at"), "h", "a", "b", "c", "d", "long"), "where")
    key = ["h", "a", "b"]
    firsts = where.groupBy(*key).agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("n"), *(F.min(k).alias(k) for k in ("c", "d", "long")))
    firsts = scratch.keep(firsts, "firsts")

    # an exact repeat goes; the hot side is split by the join, the other has a row a line
    repeats = scratch.keep(firsts.filter("n > 1").select(*key, F.col("at").alias("first")), "repeats")
    again = scratch.keep(where.join(repeats, key).filter("at > first").select("at"), "again")
    scratch.release(where, repeats)

    # lines that share a half with another
    half = firsts.filter("long").select("at", F.explode(F.array("a", "b", "c", "d")).alias("half")).filter("half is not null")
    shared = scratch.keep(half.groupBy("half").count().filter("count > 1").select("half"), "shared")
    some = scratch.keep(half.join(shared, "half", "left_semi").select("at").distinct(), "some")
    scratch.release(firsts, shared)
    marked = some.select(*places.of(F.col("at"))).groupBy("no").agg(F.collect_set("line").alias("wanted"))
    marked = scratch.keep(marked.join(places.rows, "no"), "marked")
    # rows that repeat id and text are one document: its lines are taken once
    sieve = Sieve(marked.select("row"), scratch)
    texts = sieve.part(docs, True).join(marked, "row").select("no", F.explode("wanted").alias("line"), F.split("text", "\n", -1).alias("body"))
    picked = texts.select(places.at().alias("at"), words_of(F.get("body", F.col("line"))).alias("words"))
    near = scratch.keep(picked.dropDuplicates(["at"]).withColumn("hashes", word_hashes(F.col("words"))), "near")
    scratch.release(some, marked, sieve.maps)

    n = F.size("hashes")
    bag = F.aggregate("hashes", F.lit(0).cast("long"), lambda s, h: s + h)
    placed = F.transform("hashes", lambda h, i: F.xxhash64(h, i).bitwiseAND((1 << HASH_BITS) - 1))
    base = near.select("at", n.alias("n"), "hashes", bag.alias("bag"), placed.alias("placed"))
    base = base.withColumn("sum", F.aggregate("placed", F.lit(0).cast("long"), lambda s, h: s + h))
    replaced = base.select(
        "at", F.explode(F.expr("transform(placed, (h, i) -> xxhash64('r', n, i, sum - h))")).alias("key")
    )
    earliest = replaced.groupBy("key").agg(F.min("at").alias("to"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("key", "to")
    earliest = scratch.keep(earliest, "earliest")
    # every member of a shared variant meets the earliest
    one = replaced.join(earliest, "key").filter(F.col("to") < F.col("at")).select("at", "to")
    fewer = base.select("at", F.explode(F.expr("array_distinct(transform(hashes, h -> xxhash64('d', n - 1, bag - h)))")).alias("key"))
    whole = scratch.keep(base.select(F.col("at").alias("to"), F.expr("xxhash64('d', n, bag)").alias("key")), "whole")
    met = fewer.join(whole, "key").select("at", "to")
    other = met.select(F.greatest("at", "to").alias("at"), F.least("at", "to").alias("to"))
    pairs = scratch.keep(one.union(other).distinct(), "pairs")
    words = near.select("at", "words")
    told = pairs.join(words.withColumnRenamed("words", "a"), "at")
    told = told.join(words.select(F.col("at").alias("to"), F.col("words").alias("b")), "to")
    edited = told.filter(within_one("a", "b")).select("at")
    gone = scratch.keep(again.union(edited).distinct(), "gone")
    scratch.release(again, near, earliest, whole, pairs)
    return gone.select(*places.of(F.col("at"))).join(places.rows, "no").select("row", "line")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Every row of ``docs`` with its text less the lines that go, and n_lines, n_removed.

    A line goes if an earlier line (by id, then a hash of the text, then line number) has the
    same words or, from ``min_words`` words on, words at most one edit away; whether that
    earlier line itself goes does not matter. Lines without words stay. A null text stays null
    with no lines; an empty one has one, without words. Rows without id come first; rows that
    repeat id and text are one document and lose the same lines. Columns are returned as
    given, with n_lines and n_removed replacing any of these names.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    given = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    body = F.col(f"doc.`{text_col}`").cast("string")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in given]).alias("doc"))
    held = held.withColumn("row", F.struct(F.col(f"doc.`{id_col}`").alias("id"), F.xxhash64(body).alias("mark")))
    gone = repeated_lines(held.select("row", body.alias("text")).dropna(subset=["text"]), scratch, min_words)
    lists = scratch.keep(gone.groupBy("row").agg(F.collect_set("line").alias("gone")), "lists")
    sieve = Sieve(lists.select("row"), scratch)
    whole = sieve.part(held, False).withColumn("gone", F.lit(None).cast("array<int>"))
    out = sieve.part(held, True).join(lists, "row", "left").unionByName(whole).withColumn("lines", F.split(body, "\n", -1))
    kept = F.filter("lines", lambda x, i: ~F.array_contains("gone", i))
    text = F.when(F.col("gone").isNull(), body).otherwise(F.array_join(kept, "\n"))
    return out.select(
        *[(text if c == text_col else F.col(f"doc.`{c}`")).alias(c) for c in given],
        F.greatest(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.greatest(F.coalesce(F.size("gone"), F.lit(0)), F.lit(0)).cast("long").alias("n_removed"),
    )
