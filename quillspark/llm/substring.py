"""Substring dedup: words covered by a window that stands anywhere else go.

Windows of ``window`` words are dealt by their *minimiser*, the least hash of the word 8-grams
inside: equal windows have equal minimisers. Consecutive windows of one minimiser form a
segment. Segments whose minimiser stands only once cannot hold a repeated window and are set
aside. Equal segments are counted once with a weight, so groups of copies shrink before they
are dealt. A minimiser with very many different segments is not dealt: the weights of its
windows are added up by the digest of the window, wherever it stands. Every other shard builds an FM-index of its segments and streams them
through backward search; intervals whose weight is two or more are reported.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Scratch, WordHashes, byte_words, runs
from quillspark.llm.fm_index import repeated_windows

WINDOW, GRAM = 35, 8
#: Words of one shard, about; different segments of one minimiser before it is dealt further.
SHARD_WORDS, HOT = 200_000, 1000


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, from windows of doubled width."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def segments(hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, number of windows, whether the minimiser stands twice in the
    text) of every run of windows with one minimiser."""
    if len(hashes) < window:
        return (np.zeros(0, np.int64),) * 4
    grams = runs(hashes, gram)
    least = sliding_least(grams, window - gram + 1)
    cut = np.append(0, np.flatnonzero(least[1:] != least[:-1]) + 1)
    # the longest segment has one window for each place of its minimiser; a longer run is cut
    size = np.diff(np.append(cut, len(least)))
    most = window - gram + 1
    if size.max() > most:
        cut = np.concatenate([np.arange(c, c + s, most) for c, s in zip(cut, size, strict=True)])
        size = np.diff(np.append(cut, len(least)))
    ordered = np.sort(grams)
    double = ordered[1:][ordered[1:] == ordered[:-1]]
    twice = np.isin(least[cut], double) if len(double) else np.zeros(len(cut), bool)
    return least[cut].view(np.int64), cut, size, twice


def _grams(window: int, gram: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes(7)
        for batch in batches:
            which, parts = [], []
            for k, text in enumerate(batch.column(2)):
                m, first, size, twice = segments(cache.of(byte_words(text.as_py())), window, gram)
                if len(m):
                    which.append(np.full(len(m), k))
                    parts.append((m, first << 8 | twice.astype(np.int64) << 7 | size))
            if which:
                rows = pa.array(np.concatenate(which))
                yield pa.record_batch(
                    [batch.column(0).take(rows), batch.column(1).take(rows), *(pa.array(np.concatenate(x)) for x in zip(*parts, strict=True))],
                    names=["id", "mark", "m", "at"],
                )

    return fn


def _contents(window: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], [], [], []]
            for k in range(batch.num_rows):
                words = byte_words(batch.column(2)[k].as_py())
                wanted = batch.column(3)[k].values
                for m, at in zip(wanted.field("m").to_pylist(), wanted.field("at").to_pylist(), strict=True):
                    first, size = at >> 8, at & 127
                    content = b" ".join(words[first : first + size + window - 1])
                    digest = hashlib.blake2b(content, digest_size=16).digest()
                    for column, value in zip(out, (k, m, first, size, digest, content), strict=True):
                        column.append(value)
            k, m, first, size, digest, content = out
            rows = pa.array(k, pa.int64())
            yield pa.record_batch(
                [
                    batch.column(0).take(rows), batch.column(1).take(rows), pa.array(m, pa.int64()), pa.array(first, pa.int32()),
                    pa.array(size, pa.int32()), pa.array(digest, pa.binary()), pa.array(content, pa.binary()),
                ],
                names=["id", "mark", "m", "first", "size", "digest", "content"],
            )

    return fn


def _windows(window: int):
    """Digests of the windows of segments, each with its place; no words."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, weight, content in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                words = content.split()
                for k in range(len(words) - window + 1):
                    rows.append((digest, weight, k, hashlib.blake2b(b" ".join(words[k : k + window]), digest_size=16).digest()))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.binary(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["digest", "weight", "offset", "content"])

    return fn


def repeated_one_by_one(segs: DataFrame, window: int) -> DataFrame:
    """(digest, low, high) of every window that stands twice in ``segs`` (digest, weight, content).

    Weights are added up before windows meet, so a window in many segments is one row of a sum;
    the verdict then goes back to its places.
    """
    at = segs.mapInArrow(_windows(window), "digest binary, weight long, offset int, content binary")
    twice = at.groupBy("content").agg(F.sum("weight").alias("weight")).filter("weight > 1").select("content")
    return at.join(twice, "content").select("digest", F.col("offset").alias("low"), F.col("offset").alias("high"))


def _shard(window: int):
    def fn(t: pa.Table) -> pa.Table:
        cache = WordHashes(7)
        hashes = [cache.of(c.split()) for c in t.column("content").to_pylist()]
        _, code = np.unique(np.concatenate(hashes), return_inverse=True)
        texts = np.split(code + 1, np.cumsum([len(h) for h in hashes])[:-1])
        digests = t.column("digest").to_pylist()
        out = []
        # windows of segments that stand twice are repeated; only the others are searched
        weight = t.column("weight").to_numpy()
        for k, hit in enumerate(repeated_windows(texts, weight, window, weight < 2)):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
            out += [(digests[k], int(a), int(b - 1)) for a, b in zip(edge[::2], edge[1::2], strict=True)]
        columns = list(zip(*out, strict=True)) or [()] * 3
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int32(), pa.int32()), strict=True)], names=["digest", "low", "high"])

    return fn


def _kept(window: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, texts = [], [], []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                words = byte_words(text.as_py())
                cover = np.zeros(len(words) + 1, np.int64)
                if spans.is_valid:
                    low, high = (spans.values.field(f).to_numpy() for f in ("low", "high"))
                    np.add.at(cover, low, 1)
                    np.add.at(cover, high + window, -1)
                gone = cover.cumsum()[:-1] > 0
                n.append(len(words))
                removed.append(int(gone.sum()))
                texts.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if removed[-1] else words).decode())
            yield pa.record_batch(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())],
                names=["doc_id", "spans", "n_words", "n_removed", "kept"],
            )

    return fn


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM
) -> DataFrame:
    """doc_id, n_words, n_removed, kept (kept words joined by one space), spans of every row.

    ``spans`` lists runs of repeated windows as (first, last) window numbers; they may overlap.
    A window is repeated if its words also start anywhere else in the table, in the same row
    too. Null and empty texts have no words and an empty ``kept``. A null id is an id like any
    other. Rows that repeat id and text repeat each other's windows, so all of those go; texts
    are read whole, words compared as they are.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    same = lambda a, b: F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.mark") == F.col(f"{b}.mark"))

    grams = scratch.keep(rows.mapInArrow(_grams(window, gram), "id long, mark long, m long, at long"), "grams")
    many = grams.groupBy("m").agg(F.count(F.lit(1)).alias("c"), F.max(F.col("at").bitwiseAND(128)).alias("twice"))
    many = many.filter("c > 1 or twice > 0").select("m")
    wanted = grams.join(many, "m").groupBy("id", "mark").agg(F.collect_list(F.struct("m", "at")).alias("wanted"))
    d, w = rows.alias("d"), wanted.alias("w")
    found = d.join(w, same("d", "w")).select("d.id", "d.mark", "d.text", "w.wanted")
    found = scratch.keep(
        found.mapInArrow(_contents(window), "id long, mark long, m long, first int, size int, digest binary, content binary"), "found"
    )
    scratch.release(grams)
    places = scratch.keep(found.select("id", "mark", "first", "digest"), "places")
    segs = found.groupBy("digest").agg(F.count(F.lit(1)).alias("weight"), F.min("m").alias("m"), F.first("content").alias("content"))
    segs = scratch.keep(segs, "segments")
    scratch.release(found)
    hot = segs.groupBy("m").count().filter(f"count > {HOT}").select("m")
    single = repeated_one_by_one(segs.join(hot, "m", "left_semi").select("digest", "weight", "content"), window)
    plain = segs.join(hot, "m", "left_anti").select("digest", "weight", "content", "m")
    n = segs.count()
    shards = max(1, -(-n * (window + window // 2) // SHARD_WORDS))
    dealt = plain.withColumn("shard", F.pmod(F.xxhash64("m"), F.lit(shards)))
    spans = dealt.groupBy("shard").applyInArrow(_shard(window), "digest binary, low int, high int")
    spans = scratch.keep(spans.union(single), "spans")
    scratch.release(segs)
    placed = places.join(spans, "digest")
    lists = placed.groupBy("id", "mark").agg(
        F.collect_set(F.struct((F.col("first") + F.col("low")).alias("low"), (F.col("first") + F.col("high")).alias("high"))).alias("spans")
    )
    s = lists.alias("s")
    out = d.join(s, same("d", "s"), "left").select("d.id", "d.text", "s.spans")
    return out.mapInArrow(
        _kept(window), "doc_id long, spans array<struct<low int, high int>>, n_words long, n_removed long, kept string"
    ).select("doc_id", "n_words", "n_removed", "kept", "spans")
