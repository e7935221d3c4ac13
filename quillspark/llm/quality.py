"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL-proximal.

A text is the mean of one-hot vectors of its word unigrams and bigrams and of the unigrams
and bigrams of word *shapes* (letters by case, digits, runs of signs), so that unseen words
still speak. Scores are sparse dot products over whole texts.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillspark.llm.common import TRAIN_ROWS, WordHashes, byte_words, fitted, forget_tables, held_out, labelled_sample, mixed

BITS = 18
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 1e-4, 1e-4
SCALE = 8.0
THRESHOLD = 0.7
#: Rows scored and handed back at a time.
SLICE = 512

_RUNS = [(re.compile(r"[^\W\d_]+"), None), (re.compile(r"[0-9]+"), "9"), (re.compile(r"([^\w\s])\1+"), r"\1\1")]


def shape(word: str) -> str:
    """X for letters in capitals, x in small ones, Xx for a capital first, 9 for digits; signs stay, at most doubled."""

    def case(m: re.Match) -> str:
        w = m[0]
        if w.isupper():
            return "X" if len(w) > 1 else "A"
        return "x" if w.islower() else "Xx" if w[:1].isupper() and w[1:].islower() else "xX"

    word = _RUNS[0][0].sub(case, word)
    word = _RUNS[1][0].sub("9", word)
    return _RUNS[2][0].sub(r"\1\1", word)[:12]


class Shapes(dict):
    """Hash of a word's shape, by word; forgotten when there are too many."""

    def __init__(self, hashes: WordHashes, most: int = 150_000):
        super().__init__()
        self.hashes, self.most = hashes, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = out = self.hashes[b"\0" + shape(word.decode(errors="replace")).encode()]
        return out


def features(text: str | None, words: WordHashes, shapes: Shapes) -> np.ndarray:
    """Feature numbers with repeats; empty for a text without words."""
    found = byte_words(text)
    if not found:
        return np.zeros(0, np.int64)
    w = words.of(found)
    s = np.fromiter(map(shapes.__getitem__, found), np.uint64, len(found))
    pair = lambda x, k: mixed(x[:-1] * np.uint64(3) + x[1:] * np.uint64(5) + np.uint64(k))
    return (np.concatenate([w, s, pair(w, 1), pair(s, 2)]) >> np.uint64(64 - BITS)).astype(np.int64)


def machinery() -> tuple[WordHashes, Shapes]:
    words = WordHashes(5, 150_000)
    return words, Shapes(words)


def fit(texts: list[str], labels: np.ndarray) -> bytes:
    """FTRL-proximal, one document at a time; the bias is the last weight."""
    tools = machinery()
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    # all rows in two arrays: many small ones take twice as much and are not given back to the system
    numbers, counts, ends, scales = array("i"), array("i"), [0], []
    for text in texts:
        f = features(text, *tools)
        index, count = np.unique(f, return_counts=True)
        numbers.frombytes(index.astype(np.intc).tobytes())
        counts.frombytes(count.astype(np.intc).tobytes())
        ends.append(len(numbers))
        scales.append(SCALE / max(len(f), 1))
    numbers, counts = np.asarray(numbers), np.asarray(counts)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    order = np.arange(len(texts))
    for epoch in range(EPOCHS):
        for k in np.random.default_rng(epoch).permutation(order):
            part = slice(ends[k], ends[k + 1])
            i, x = np.append(numbers[part], size), np.append(counts[part] * scales[k], 1.0)
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - labels[k]) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    return weights(np.arange(size + 1)).astype(np.float32).tobytes()


def score(text: str | None, weights: np.ndarray, tools: tuple[WordHashes, Shapes]) -> float:
    f = features(text, *tools)
    total = weights[-1] + (weights[f].sum(dtype=np.float64) * SCALE / len(f) if len(f) else 0.0)
    return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality",
    of: int = 4, rest: int = 2, most: int = TRAIN_ROWS, threshold: float = THRESHOLD, keep: Sequence[str] = (),
) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Fitted on about ``most`` labelled rows at most, none of them held out (crc32 of the id
    modulo ``of`` is ``rest``; a null id is held out). A null, empty or blank text gets the
    score of the bias alone; without any label every score is 0.5. Rows stay as they are,
    repeated ones too; other columns are not looked at. Columns named in ``keep`` are carried
    along in a struct ``kept``.
    """
    spark = docs.sparkSession
    model = fitted(labelled_sample(docs, labels, label, of, rest, most, id_col, text_col), fit)
    shared = spark.sparkContext.broadcast(model or np.zeros((1 << BITS) + 1, np.float32).tobytes())

    inside = text_col in keep  # then the text goes to the workers once, inside ``kept``

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tables()
        weights, tools = np.frombuffer(shared.value, np.float32), machinery()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                texts = pc.cast(batch.column("kept").field(text_col), pa.string()) if inside else batch.column("text")
                scores = [score(t.as_py(), weights, tools) for t in texts]
                kept = {"kept": batch.column("kept")} if keep else {}
                out = {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": pa.array(scores, pa.float64()), **kept}
                yield pa.RecordBatch.from_pydict(out)

    ident = F.col(id_col)
    rows = docs.select(
        ident.alias("doc_id"), held_out(ident, of, rest).alias("held_out"),
        *([F.struct(*keep).alias("kept")] if keep else []), *([] if inside else [F.col(text_col).cast("string").alias("text")]),
    )
    given = {f.name: f for f in rows.schema.fields if f.name != "text"}
    fields = [given["doc_id"], given["held_out"], StructField("score", DoubleType()), *([given["kept"]] if keep else [])]
    out = rows.mapInArrow(fn, StructType(fields))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
