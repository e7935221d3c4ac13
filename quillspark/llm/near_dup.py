"""Near-duplicate documents: MinHash bands, sequential Bayesian pruning, exact confirmation.

A document's set holds the hashes of its distinct word 5-grams. Documents of one set
collapse to one representative. Bands of MinHash values propose partners. A pair's
signatures are compared batch by batch; after each batch the posterior of its similarity
(uniform prior, so Beta(m + 1, n - m + 1) after m agreements in n) says how likely it still
reaches the threshold, and the pair goes when that falls below ``miss``. What is left is
confirmed on the full sets.

A bucket of copies never becomes all its pairs: first every member meets one centre of its
part of the bucket, and links merge into components; then only members of *different*
components of a bucket meet, in blocks of bounded size. Pairs that pass the Bayesian test
there are confirmed on their full sets, and one link of each two components leaves the
block. Every pair that shares a band is thus either
compared or already connected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import Scratch, WordHashes, byte_words, forget_tables, mixed, odd_numbers, runs

SHINGLE = 5
HASHES, BANDS, ROWS = 256, 32, 4
BATCH = 32
MISS = 1e-6
FAN, BLOCK, SLAB = 64, 1024, 64
STEP = 1024


def shingle_set(words: list[bytes], cache: WordHashes, n: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct n-word shingles; a shorter text is one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    h = cache.of(words)
    return np.unique(runs(h, n)) if len(h) >= n else runs(h, len(h), 11 + len(h))


@lru_cache(maxsize=4)
def _factors() -> tuple[np.ndarray, np.ndarray]:
    a = odd_numbers(HASHES, 3)
    b = odd_numbers(HASHES, 5)
    return (a >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (b >> np.uint64(32)).astype(np.uint32)


def minhashes(shingles: np.ndarray) -> np.ndarray:
    a, b = _factors()
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, np.uint32(0xFFFFFFFF))
    for i in range(0, len(x), STEP):
        np.minimum(out, (x[i : i + STEP, None] * a + b).min(axis=0), out=out)
    return out


def thresholds(similarity: float, miss: float, hashes: int = HASHES, batch: int = BATCH) -> list[int]:
    """Fewest agreements after each batch that keep a pair.

    P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m); t allows for the chance
    that different values agree in the 16 bits kept.
    """
    t = similarity + (1 - similarity) / 65536
    out = []
    for n in range(batch, hashes + 1, batch):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def agree(left: np.ndarray, right: np.ndarray, fewest: list[int]) -> np.ndarray:
    """Which pairs of signature rows stay possible after all batches."""
    alive = np.arange(len(left))
    seen = np.zeros(len(left), np.int32)
    for k, low in enumerate(fewest):
        part = slice(k * BATCH, (k + 1) * BATCH)
        seen = seen + (left[alive, part] == right[alive, part]).sum(axis=1)
        ok = seen >= low
        alive, seen = alive[ok], seen[ok]
    return alive


SIGNED = "doc_id long, n_shingles long, k1 long, k2 long, sig binary, bands array<long>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget_tables()
    cache = WordHashes()
    for batch in batches:
        ids, n, keys, sigs = batch.column(0), [], [], []
        for text in batch.column(1):
            s = shingle_set(byte_words(text.as_py()), cache)
            n.append(len(s))
            keys.append((np.add.reduce(mixed(s)), np.bitwise_xor.reduce(mixed(s + np.uint64(17)))) if len(s) else (0, 0))
            sigs.append(minhashes(s))
        if not n:
            continue
        m = np.array(sigs, np.uint32)
        bands = np.zeros((len(n), BANDS), np.uint64)
        parts = m[:, : BANDS * ROWS].astype(np.uint64).reshape(len(n), BANDS, ROWS)
        for r, by in enumerate(odd_numbers(ROWS, 23)):
            bands = mixed(bands + parts[:, :, r] * by)
        bands = mixed(bands + odd_numbers(BANDS, 29))
        low = np.ascontiguousarray(m.astype(np.uint16))
        k = np.array(keys, np.uint64).view(np.int64)
        yield pa.record_batch(
            [
                ids, pa.array(n, pa.int64()), pa.array(k[:, 0]), pa.array(k[:, 1]),
                pa.array([row.tobytes() for row in low], pa.binary()),
                pa.ListArray.from_arrays(
                    pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), pa.array(bands.view(np.int64).ravel())
                ),
            ],
            names=["doc_id", "n_shingles", "k1", "k2", "sig", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    for batch in batches:
        sets = [shingle_set(byte_words(t.as_py()), cache).view(np.int64) for t in batch.column(1)]
        yield pa.record_batch(
            [batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"]
        )


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


def _prune(fewest: list[int]):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ok = agree(_signatures(batch.column(2)), _signatures(batch.column(3)), fewest)
                yield pa.record_batch([batch.column(0).take(ok), batch.column(1).take(ok)], names=["a", "b"])

    return fn


def _linked(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs (i, j) of a block's sets reach the similarity."""
    flat = np.concatenate(sets)
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    start = np.append(0, size.cumsum())
    _, code = np.unique(flat, return_inverse=True)
    mark = np.zeros(len(flat) + 1, np.int32)
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    out = []
    cuts = np.flatnonzero(np.diff(i)) + 1
    for k in np.split(np.arange(len(i)), cuts):
        a, b = int(i[k[0]]), j[k]
        mark[code[start[a] : start[a + 1]]] = 1
        parts = np.concatenate([code[start[x] : start[x + 1]] for x in b])
        x = np.add.reduceat(mark[parts], np.append(0, size[b].cumsum()[:-1]))
        mark[code[start[a] : start[a + 1]]] = 0
        out.append(order[k[100 * x >= 100 * similarity * (size[a] + size[b] - x)]])
    return np.concatenate(out)


def _blocks(fewest: list[int], similarity: float):
    """Links of different components within each (bucket, block pair); rows come sorted by it.

    One link of two components is enough to join them, so a block gives no more.
    """

    def pairs(ids, n, comp, part, sigs, sets, start, stop):
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(start, stop, SLAB):
            row, col = slice(at, min(at + SLAB, stop)), slice(at, stop)
            small, large = np.minimum.outer(n[row], n[col]), np.maximum.outer(n[row], n[col])
            ok = np.triu(comp[row, None] != comp[None, col], 1) & (100 * small >= 100 * similarity * large)
            ok &= (part[row, 0][:, None] != part[None, col, 0]) | (part[start, 1] == part[start, 2])
            i, j = np.nonzero(ok)
            for k in range(0, len(i), 65536):
                x, y = i[k : k + 65536] + at, j[k : k + 65536] + at
                hit = agree(sigs[x], sigs[y], fewest)
                left.append(x[hit])
                right.append(y[hit])
        i, j = np.concatenate(left), np.concatenate(right)
        if not len(i):
            return {}
        hit = _linked([sets(k) for k in range(start, stop)], i - start, j - start, similarity)
        i, j = i[hit], j[hit]
        a, b = np.minimum(comp[i], comp[j]), np.maximum(comp[i], comp[j])
        return dict(zip(zip(a.tolist(), b.tolist(), strict=True), zip(ids[i].tolist(), ids[j].tolist(), strict=True), strict=True))

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
            t = t.combine_chunks()
            part = np.column_stack([t.column(c).to_numpy() for c in ("h", "i", "j")])
            key = t.column("key").to_numpy()
            ids, n, comp = (t.column(c).to_numpy() for c in ("id", "n", "comp"))
            sigs = _signatures(t.column("sig"))
            packed = t.column("shingles")
            sets = lambda k: np.asarray(packed[k].values)
            cut = np.flatnonzero((key[1:] != key[:-1]) | (part[1:, 1:] != part[:-1, 1:]).any(axis=1)) + 1
            found = {}
            for start, stop in zip([0, *cut], [*cut, len(key)], strict=True):
                found |= pairs(ids, n, comp, part, sigs, sets, start, stop)
            a = np.array([min(p) for p in found.values()], np.int64)
            b = np.array([max(p) for p in found.values()], np.int64)
            yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            if not t.num_rows:
                continue
            key = t.column("key").to_numpy()
            i, j = t.column("i").to_numpy(), t.column("j").to_numpy()
            last = np.flatnonzero((key != key[-1]) | (i != i[-1]) | (j != j[-1]))
            at = int(last[-1]) + 1 if len(last) else 0
            rest = t.slice(at)
            if at:
                yield from done(t.slice(0, at))
        if rest is not None and rest.num_rows:
            yield from done(rest)

    return fn


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Smallest reachable id of every end of ``edges(a, b)``: (id, comp), smallest labels with shortcuts."""
    both = scratch.keep(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both"
    )
    least = both.groupBy("a").agg(F.min("b").alias("b"))
    labels = scratch.keep(least.select(F.col("a").alias("id"), F.least("a", "b").alias("comp")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("id").alias("b"), "comp"), "b")
            .groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        )
        own = labels.join(near, "id").select("id", "comp", F.least("comp", "near").alias("to"))
        jump = labels.select(F.col("id").alias("to"), F.col("comp").alias("beyond"))
        moved = scratch.keep(
            own.join(jump, "to").select("id", F.col("comp").alias("was"), F.least("to", "beyond").alias("comp")), "moved"
        )
        changed = moved.filter("was <> comp").limit(1).count()
        scratch.release(labels)
        labels = moved
        if not changed:
            scratch.release(both)
            return labels.select("id", "comp")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.75, miss: float = MISS
) -> DataFrame:
    """Component of near-duplicates of every row: doc_id, n_shingles, component_id, kept.

    Words are lower-cased in A-Z. A null, empty or blank text has no shingles, is linked with
    nothing and is kept. A row without id is no node: component_id null, kept. Rows that
    repeat an id are one node. Texts are read whole; other columns are not looked at.
    A pair at the threshold escapes all 32 bands with probability 5e-6 and the Bayesian test
    with at most ``miss`` a batch; a document is lost to its component only if that happens
    to all its links.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dup")
    text = F.translate(F.col(text_col).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    fewest = thresholds(similarity, miss)
    near_size = F.expr(f"100 * least(n, m) >= {100 * similarity:g} * greatest(n, m)")

    signed = scratch.keep(docs.mapInArrow(_sign, SIGNED), "signed")
    found = signed.filter("n_shingles > 0 and doc_id is not null")
    reps = scratch.keep(found.groupBy("n_shingles", "k1", "k2").agg(F.min("doc_id").alias("rep")), "reps")
    first = reps.select(F.col("rep").alias("doc_id"), "n_shingles", "k1", "k2")
    heads = scratch.keep(
        found.join(first, ["doc_id", "n_shingles", "k1", "k2"], "left_semi")
        .select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "sig", "bands"),
        "heads",
    )

    # buckets of at least two, and the centre of every part of at most about FAN members
    rows = heads.select(F.explode("bands").alias("key"), "id", "n")
    many = rows.groupBy("key").count().filter("count > 1")
    members = scratch.keep(rows.join(many, "key").select("key", "id", "n", F.col("count").alias("c")), "members")
    part = members.withColumn("part", F.expr(f"pmod(xxhash64(id), cast(ceil(c / {FAN}) as bigint))"))
    centre = F.min(F.struct("id", "n")).over(Window.partitionBy("key", "part"))
    centred = part.select("key", "c", "id", "n", centre.alias("to"))
    stars = centred.select("id", "n", F.col("to.id").alias("to"), F.col("to.n").alias("m"))
    tops = centred.filter(f"c > {FAN} and id = to.id").select("key", "id", "n")
    above = tops.groupBy("key").agg(F.min(F.struct("id", "n")).alias("top"))
    tops = tops.join(above, "key").select("id", "n", F.col("top.id").alias("to"), F.col("top.n").alias("m"))
    pairs = stars.union(tops).filter(F.col("id") != F.col("to")).filter(near_size)
    pairs = pairs.select(F.col("to").alias("a"), F.col("id").alias("b")).distinct()

    sigs = heads.select("id", "sig")

    def likely(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a")
        both = with_a.join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
        return both.select("a", "b", "sa", "sb").mapInArrow(_prune(fewest), "a long, b long")

    wanted = members.select(F.col("id").alias("doc_id")).distinct()
    sets = scratch.keep(docs.join(wanted, "doc_id", "left_semi").mapInArrow(_sets, "id long, shingles array<long>"), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("xa")), "a")
        both = with_a.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("xb")), "b")
        common = both.select("a", "b", F.size("xa").alias("na"), F.size("xb").alias("nb"), F.size(F.array_intersect("xa", "xb")).alias("x"))
        return common.filter(f"100L * x >= {100 * similarity:g} * (na + nb - x)").select("a", "b")

    links = scratch.keep(confirmed(likely(pairs)), "links")
    comps = components(links, scratch)

    # members of one bucket that are still apart
    held = scratch.keep(
        members.join(comps, "id", "left").select("key", "id", "n", "c", F.coalesce("comp", "id").alias("comp")), "held"
    )
    apart = held.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("key")
    apart = held.join(apart, "key").withColumn("parts", F.expr(f"cast(ceil(c / {BLOCK}) as bigint)"))
    apart = apart.withColumn("h", F.expr("pmod(xxhash64(id, 1), parts)"))
    blocks = apart.select("key", "id", "n", "comp", "h", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("o"))
    blocks = blocks.select("key", "id", "n", "comp", "h", F.least("h", "o").alias("i"), F.greatest("h", "o").alias("j"))
    blocks = blocks.join(sigs, "id").join(sets, "id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    more = blocks.select("key", "i", "j", "h", "id", "n", "comp", "sig", "shingles").mapInArrow(_blocks(fewest, similarity), "a long, b long")
    more = scratch.keep(more.distinct(), "more")
    of = lambda side: comps.select(F.col("id").alias(side), F.col("comp").alias(f"c{side}"))
    joined = more.join(of("a"), "a", "left").join(of("b"), "b", "left")
    joined = joined.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    second = components(joined, scratch)
    merged = second.select(F.col("id").alias("comp"), F.col("comp").alias("end"))
    alone = second.join(comps, "id", "left_anti").select("id", F.col("comp").alias("end"))
    known = comps.join(merged, "comp", "left").select("id", F.coalesce("end", "comp").alias("end"))
    final = scratch.keep(known.union(alone), "final")

    placed = found.select("doc_id", "n_shingles", "k1", "k2").join(reps, ["n_shingles", "k1", "k2"])
    placed = placed.join(final.withColumnRenamed("id", "rep"), "rep", "left")
    placed = placed.select("doc_id", "n_shingles", F.coalesce("end", "rep").alias("component_id"))
    rest = signed.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return placed.union(rest).withColumn("kept", kept)
