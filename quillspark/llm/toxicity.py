"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a lexicon mined from the labels (words whose odds are
far higher in toxic rows), hits near a second person, capitals, punctuation, and signs or
digits inside words. Words are looked up after undoing such obfuscation.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import TRAIN_ROWS, FINDS, fitted, held_out, labelled_sample

THRESHOLD = 0.7
LEXICON, SUPPORT, ODDS = 200, 4, 8.0
TREES, DEPTH, RATE, BINS, LAMBDA = 60, 3, 0.2, 32, 1.0
NEAR = 6

# fixed values: second persons of common languages, and signs that stand for letters
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te ti toi ton ta tes vous votre vos usted ustedes vosotros".split())
SIGNS = str.maketrans("0134578@$!|", "oieastbasil")

_INSIDE = re.compile(r"(?<=\w)[^\w\s'’\-]+(?=\w)|(?<=[^\W\d_])[0-9@$]+(?=[^\W\d_])")
_LONG = re.compile(r"(.)\1{2,}")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_CAPITAL = re.compile(r"[A-ZÀ-Þ]")
_SIGN = re.compile(r"[^\w\s]")


def plain(word: str) -> tuple[str, bool]:
    """A word in small letters without edge signs, with signs that stand for letters read as
    those, and whether that changed more than case and edges."""
    bare = _EDGE.sub("", word.lower())
    if bare.isalpha() and not _LONG.search(bare):
        return bare, False
    read = re.sub(r"[^\w]|_", "", bare.translate(SIGNS)) if any(c.isalpha() for c in bare) else bare
    read = _LONG.sub(r"\1", read)
    return read, read != bare


class Plain(dict):
    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> tuple[str, bool]:
        if len(self) >= self.most:
            self.clear()
        self[word] = out = plain(word)
        return out


def mine(texts: list[str], labels: np.ndarray, known: Plain) -> dict[str, float]:
    """Words with their log odds ratio, the strongest ones; a text counts once."""
    toxic, clean = Counter(), Counter()
    n = [0, 0]
    for text, label in {t: int(y) for t, y in zip(texts, labels, strict=True)}.items():
        n[label] += 1
        (toxic if label else clean).update({known[w][0] for w in FINDS.findall(text)})
    found = []
    for word, k in toxic.items():
        if k >= min(SUPPORT, 1 + n[1] // 8) and len(word) > 1:
            odds = (k + 0.5) / (n[1] + 1) / ((clean[word] + 0.5) / (n[0] + 1))
            if odds >= ODDS:
                found.append((-k * math.log(odds), word, math.log(odds)))
    return {word: odds for _, word, odds in sorted(found)[:LEXICON]}


NAMES = (
    "hits", "kinds", "density", "strength", "crowd", "hidden_hits", "near_second", "second", "capitals", "shouted",
    "signs", "calls", "inside", "stretched", "words",
)


def features(text: str | None, lexicon: dict[str, float], known: Plain) -> list[float]:
    words = FINDS.findall(text or "")
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    read = [known[w] for w in words]
    at = [i for i, (w, _) in enumerate(read) if w in lexicon]
    second = [i for i, (w, _) in enumerate(read) if w in SECOND]
    near, k = 0, 0
    for i in at:
        while k < len(second) and second[k] < i - NEAR:
            k += 1
        near += k < len(second) and second[k] <= i + NEAR
    crowd = max((j - i + 1) / (at[j] - at[i] + 20) for i in range(len(at)) for j in range(i, min(i + 4, len(at)))) if at else 0.0
    letters = sum(map(len, words))
    capitals = len(_CAPITAL.findall(text))
    return [
        math.log1p(len(at)), len({read[i][0] for i in at}), len(at) / n, sum(lexicon[read[i][0]] for i in at) / n, crowd,
        math.log1p(sum(read[i][1] for i in at)), near / n, len(second) / n, capitals / letters,
        sum(w.isupper() and len(w) > 2 for w in words) / n, len(_SIGN.findall(text)) / letters,
        (text.count("!") + text.count("?")) / n, sum(h for _, h in read) / n, len(_LONG.findall(text)) / n, math.log1p(n),
    ]


def boost(x: np.ndarray, y: np.ndarray) -> dict:
    """Logistic gradient boosting on binned features; trees are lists of (feature, bin) per level order."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    b = np.column_stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)])
    rate = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    base = float(np.log(rate / (1 - rate)))
    f = np.full(len(y), base)
    trees = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        node, splits = np.zeros(len(y), np.int64), []
        for depth in range(DEPTH):
            width = 1 << depth
            best = [(0.0, 0, BINS)] * width  # bin BINS sends every row to the left
            for j in range(x.shape[1]):
                key = node * BINS + b[:, j]
                gs = np.bincount(key, g, width * BINS).reshape(width, BINS).cumsum(axis=1)
                hs = np.bincount(key, h, width * BINS).reshape(width, BINS).cumsum(axis=1)
                G, H = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + LAMBDA) + (G - gs) ** 2 / (H - hs + LAMBDA) - G**2 / (H + LAMBDA)
                gain[(hs < 1e-3) | (H - hs < 1e-3)] = 0
                for v in range(width):
                    k = int(gain[v].argmax())
                    if gain[v, k] > best[v][0] + 1e-9:
                        best[v] = (float(gain[v, k]), j, k)
            splits += [(j, k) for _, j, k in best]
            which = np.array([(j, k) for _, j, k in best])
            node = 2 * node + (b[np.arange(len(y)), which[node, 0]] > which[node, 1])
        leaf = np.bincount(node, g, 1 << DEPTH) / (np.bincount(node, h, 1 << DEPTH) + LAMBDA) * RATE
        f += leaf[node]
        trees.append({"splits": [(int(j), int(k)) for j, k in splits], "leaf": leaf.tolist()})
    return {"base": base, "edges": [e.tolist() for e in edges], "trees": trees}


def margins(model: dict, x: np.ndarray) -> np.ndarray:
    b = np.column_stack([np.searchsorted(np.array(e), x[:, j], side="right") for j, e in enumerate(model["edges"])])
    f = np.full(len(x), model["base"])
    rows = np.arange(len(x))
    for tree in model["trees"]:
        node = np.zeros(len(x), np.int64)
        splits = np.array(tree["splits"])
        for depth in range(DEPTH):
            at = splits[(1 << depth) - 1 + node]
            node = 2 * node + (b[rows, at[:, 0]] > at[:, 1])
        f += np.array(tree["leaf"])[node]
    return f


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[list[float], list[float]]:
    """Rates that never fall with the margin, pooled from neighbours; ends are kept off 0 and 1.

    Rows of equal margin are one pool from the start, so that a margin has one rate.
    """
    own, which, count = np.unique(margin, return_inverse=True, return_counts=True)
    pools: list[list[float]] = []
    for m, v, k in zip(own, np.bincount(which, y), count, strict=True):
        pools.append([float(v), float(k), float(m), float(m)])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            s, n, _, high = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += n
            pools[-1][3] = high
    at, rate = [], []
    for s, n, low, high in pools:
        r = (s + 0.05) / (n + 0.1)
        at += [low, high] if high > low else [low]
        rate += [r, r] if high > low else [r]
    return at, np.maximum.accumulate(rate).tolist()


def fit(texts: list[str], labels: np.ndarray) -> bytes:
    """Lexicon and trees on three of four rows, calibration on the rest."""
    known = Plain()
    part = np.arange(len(texts)) % 4 == 3
    if labels[part].min(initial=1) == labels[part].max(initial=0):
        part[:] = False
    own = np.flatnonzero(~part)
    lexicon = mine([texts[i] for i in own], labels[own], known)
    x = np.array([features(t, lexicon, known) for t in texts])
    model = boost(x[own], labels[own])
    rest = np.flatnonzero(part) if part.any() else own
    model["isotonic"] = isotonic(margins(model, x[rest]), labels[rest])
    return json.dumps(model | {"lexicon": lexicon}).encode()


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic",
    of: int = 3, rest: int = 1, most: int = TRAIN_ROWS, threshold: float = THRESHOLD,
) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Fitted on about ``most`` labelled rows at most, none of them held out (crc32 of the id
    modulo ``of`` is ``rest``; a null id is held out). A null, empty or blank text has all
    features 0; without any label every score is 0.5. Rows stay as they are, repeated ones
    too; other columns are not looked at.
    """
    spark = docs.sparkSession
    model = fitted(labelled_sample(docs, labels, label, of, rest, most, id_col, text_col), fit)
    shared = spark.sparkContext.broadcast(model)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = json.loads(shared.value) if shared.value else None
        known = Plain()
        for batch in batches:
            scores = np.full(batch.num_rows, 0.5)
            if m and batch.num_rows:
                x = np.array([features(t.as_py(), m["lexicon"], known) for t in batch.column(2)])
                scores = np.clip(np.interp(margins(m, x), *m["isotonic"]), 0, 1)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(scores)], names=["doc_id", "held_out", "score"])

    rows = docs.select(
        F.col(id_col).alias("doc_id"), held_out(F.col(id_col), of, rest).alias("held_out"), F.col(text_col).cast("string").alias("text")
    )
    out = rows.mapInArrow(fn, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
