"""Helpers of the training-data operators: scratch tables, words and stable word hashes."""

from __future__ import annotations

import gc
import re
import uuid
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.session import new_path

#: A word: a run of anything but the six ASCII blanks. ``bytes.split()`` cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Scratch:
    """Intermediate tables in the shared folder, so that a lost executor loses nothing.

    ``keep`` writes a frame and reads it back; ``release`` deletes tables that no later
    frame reads. What the returned frame still reads stays until its folder is emptied.
    """

    def __init__(self, spark: SparkSession, stem: str):
        self.spark, self.root, self.paths = spark, new_path(spark, stem), {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def release(self, *frames: DataFrame) -> None:
        hadoop = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in frames:
            _, path = self.paths.pop(id(df))
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(hadoop).delete(where, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def low(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """All words of a text; an empty list for an empty one, null for null.

    Splitting at one plain character takes no regular expression.
    """
    for blank in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return F.filter(F.split(text, " ", -1), lambda w: w != "")


def byte_words(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


class WordHashes(dict):
    """Stable 64-bit hashes of words, remembered up to a bound and then forgotten."""

    def __init__(self, seed: int = 0, most: int = 400_000):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word, self.seed)
        return out

    def of(self, words: Iterable[bytes]) -> np.ndarray:
        words = list(words)
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit multiplicative hash; numpy wraps at 2**64."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit multipliers."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) | np.uint64(1)


def runs(hashes: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """A 64-bit hash of every n consecutive words."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    by, size = odd_numbers(n, seed), len(hashes) - n + 1
    out = np.zeros(size, np.uint64)
    for i in range(n):
        out += hashes[i : i + size] * by[i]
    return mixed(out)


def held_out(doc_id: Column, of: int, rest: int) -> Column:
    """Rows whose crc32 of the id as text leaves ``rest``; a row without id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % of == rest, F.lit(True))


FINDS = re.compile(WORD)

_KEPT: list = []


def kept_by_worker(make: Callable) -> Callable:
    """Results of ``make`` stay in a Python worker from task to task, until ``forget_tables``."""
    _KEPT.append(lru_cache(maxsize=2)(make))
    return _KEPT[-1]


def forget_tables() -> None:
    """Called where a task of another operator begins: workers live on, and what one operator keeps
    in them would stand beside the tables of the next, and in idle workers beside a full heap."""
    held = [x for x in _KEPT if x.cache_info().currsize]
    for x in held:
        x.cache_clear()
    if held:
        gc.collect()  # states refer to each other


#: Labelled rows a classifier is fitted on, at most (about).
TRAIN_ROWS = 16_000


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, of: int, rest: int, most: int = TRAIN_ROWS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Texts and labels to learn from: (mark, text, label), about ``most`` rows at most.

    Only rows whose crc32 of the id modulo ``of`` is not ``rest``. Ids are drawn by hash; null
    labels and texts are left out, of several labels of an id the largest counts. The drawn
    ids are bounded by ``most``, so they are broadcast and no text is shuffled to be found.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("label")).dropna()
    known = known.filter(~held_out(F.col("doc_id"), of, rest)).groupBy("doc_id").agg(F.max("label").alias("label"))
    n = known.count()
    mark = F.xxhash64("doc_id", F.lit(1))
    known = known.withColumn("mark", mark)
    if n > most:
        known = known.filter(F.pmod("mark", F.lit(1 << 40)) < int((1 << 40) * (most / n)))
    drawn = F.broadcast(known.limit(most + most // 4))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).dropna()
    return texts.join(drawn, "doc_id").select("mark", "text", "label")


def fitted(sample: DataFrame, fit) -> bytes | None:
    """Runs ``fit(texts, labels) -> bytes`` in one task over a bounded sample, in mark order."""
    import pyarrow as pa

    def fn(batches):
        forget_tables()
        rows = [pa.Table.from_batches([b]) for b in batches]
        if rows and sum(map(len, rows)):
            t = pa.concat_tables(rows).sort_by([("mark", "ascending"), ("text", "ascending")])
            model = fit(t.column("text").to_pylist(), np.array(t.column("label").to_pylist()))
            yield pa.record_batch([pa.array([model], pa.binary())], names=["model"])

    found = sample.repartition(1).mapInArrow(fn, "model binary").collect()
    return bytes(found[0]["model"]) if found else None
