"""LM scoring: a log-bilinear neural model trained by noise-contrastive estimation.

Vocabulary. Counts of all training tokens are summed on Spark. Every token counted at least
``least`` times has an input and an output vector (the ``TABLE`` most frequent at most, a
bound on memory). In order of frequency these tokens are cut into about as many classes as
the square root of their number, at equal sums of the square roots of their counts. All other
tokens, and unknown ones, share ``GROUPS`` classes by the hash of their last bytes. Sizes thus
follow from the counts and grow with the corpus.

Model. The vectors of the last ``context`` tokens, each scaled by a vector of its distance,
add up to a prediction. P(token | context) = P(class | context) * P(token | class, context):
both are softmaxes of products with the prediction, plus biases. In the ``GROUPS`` classes the
second factor is (c + 1) / (class count + class kinds + 1), the last 1 being all unknown tokens.

Training. Rows fall by a hash of id and text into ``ROUNDS`` rounds and, in a round, into shards
whose number follows from counts, so scores depend neither on files nor on partitions. Every
shard of a round goes on from the average of the round before, its rows in order of the hash,
by NCE: classes against the class frequencies, a token against tokens drawn evenly from its
class. Shards are averaged in pieces, weighted by tokens, with the roots of the sums of squares
that set the step sizes. Scoring takes softmaxes by batched matrix products.

Counts of the ``TABLE`` most frequent tokens are broadcast (a fixed bound); the rest are
joined by hash, one row for each text and rare token, so no vocabulary has to fit anywhere.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Scratch, WordHashes, byte_words, held_out, low, mixed

GROUPS = 64
DIMS, CONTEXT, LEAST = 16, 4, 20
TABLE = 1 << 19
FLUSH = 300_000
BATCH, NOISE, WITHIN = 4096, 32, 4
#: Step size, and the sum of squares that every parameter starts with.
RATE, START = 0.3, 1.0
SLAB = 1 << 16
#: A shard has at least this many tokens, and this many for each token that has vectors, so
#: that the copies of the model stay in proportion to the text; there are at most ``SHARDS``.
ROUNDS, SHARD_TOKENS, PER_VECTOR, SHARDS = 3, 1 << 20, 16, 1024
PIECE = 1 << 13
END = b"\n"  # no word holds a line feed


class Groups(dict):
    """Group of a word: the hash of its last two bytes, remembered by those."""

    def __missing__(self, tail: bytes) -> int:
        self[tail] = out = int(WordHashes(3)[tail] % GROUPS)
        return out


def tokens(text: str | None) -> list[bytes]:
    return [*byte_words(text), END]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, groups = Counter(), Groups()

    def out() -> pa.RecordBatch:
        words = list(counts)
        h = WordHashes(1, len(words) + 1).of(words).view(np.int64)
        g = np.fromiter((groups[w[-2:]] for w in words), np.int32, len(words))
        c = np.fromiter(counts.values(), np.int64, len(words))
        counts.clear()
        return pa.record_batch([pa.array(h), pa.array(g), pa.array(c)], names=["h", "grp", "c"])

    for batch in batches:
        for text in batch.column(0):
            counts.update(tokens(text.as_py()))
            if len(counts) > FLUSH:
                yield out()
    if counts:
        yield out()


class Table:
    """The broadcast counts: hashes in order, their counts, and their ranks by frequency (-1
    for a token without vectors). ``h`` and ``c`` come in order of frequency."""

    def __init__(self, h: np.ndarray, c: np.ndarray, sizes: Sizes):
        order = np.argsort(h)
        self.h, self.c, self.sizes = h[order], c[order], sizes
        self.rank = np.where(order < sizes.words, order, -1)


class Sizes:
    """Classes of the tokens that have vectors: class k holds the ranks from ``starts[k]`` on."""

    def __init__(self, counts: np.ndarray, dims: int = DIMS, context: int = CONTEXT):
        self.words, self.dims, self.context = len(counts), dims, context
        mass = np.sqrt(counts.astype(np.float64)).cumsum()
        cut = (mass * (math.isqrt(self.words) / mass[-1] * (1 - 1e-9))).astype(np.int64) if self.words else np.zeros(0, np.int64)
        self.class_of = np.cumsum(np.append(0, np.diff(cut) > 0)) if self.words else cut
        self.starts = np.append(np.unique(self.class_of, return_index=True)[1], self.words).astype(np.int64)
        self.own = len(self.starts) - 1
        self.classes, self.inputs = self.own + GROUPS, self.words + GROUPS + 1


class Reader(dict):
    """Numbers of tokens met before, up to a bound, and what the table says of each: input
    vector, class, rank (-1 without vectors), count (-1 for a token not in the table), hash."""

    def __init__(self, table: Table, most: int = 300_000):
        super().__init__()
        self.t, self.most, self.groups = table, most, Groups()
        self.new: list[bytes] = []
        self.columns = np.empty((5, 1 << 12), np.int64)

    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self)
        self.new.append(word)
        return i

    def _look_up(self) -> None:
        words, t, sizes = self.new, self.t, self.t.sizes
        h = WordHashes(1, len(words) + 1).of(words).view(np.int64)
        g = np.fromiter((self.groups[w[-2:]] for w in words), np.int64, len(words))
        none = np.full(len(words), -1)
        rows = np.array([sizes.words + g, sizes.own + g, none, none, h])
        if len(t.h):
            i = np.minimum(np.searchsorted(t.h, h), len(t.h) - 1)
            hit = t.h[i] == h
            rank = np.where(hit, t.rank[i], -1)
            known = rank >= 0
            rows[0, known], rows[1, known] = rank[known], sizes.class_of[rank[known]]
            rows[2], rows[3] = rank, np.where(hit, t.c[i], -1)
        first = len(self) - len(words)
        if len(self) > self.columns.shape[1]:
            more = np.empty((5, 2 * len(self)), np.int64)
            more[:, :first] = self.columns[:, :first]
            self.columns = more
        self.columns[:, first : len(self)] = rows
        self.new = []

    def read(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            self._look_up()
        return self.columns[:, numbers]


class Model:
    """Parameters as one flat array: input vectors, distance scales, class vectors and biases,
    token vectors and biases."""

    def __init__(self, flat: np.ndarray, sizes: Sizes):
        shapes = self.shapes(sizes)
        ends = np.cumsum([math.prod(s) for s in shapes])[:-1]
        self.inputs, self.scale, self.classes, self.bias, self.tokens, self.within = (
            part.reshape(s) for part, s in zip(np.split(flat, ends), shapes, strict=True)
        )
        self.flat, self.sizes = flat, sizes

    @staticmethod
    def shapes(z: Sizes) -> tuple[tuple[int, ...], ...]:
        return (z.inputs, z.dims), (z.context, z.dims), (z.classes, z.dims), (z.classes,), (z.words, z.dims), (z.words,)

    @classmethod
    def fresh(cls, sizes: Sizes, frequency: np.ndarray, share: np.ndarray) -> Model:
        """``frequency`` of the classes, ``share`` of a token in its class."""
        rng = np.random.default_rng(1)
        model = cls(np.zeros(sum(math.prod(s) for s in cls.shapes(sizes)), np.float32), sizes)
        model.inputs[:] = rng.normal(0, 0.1, model.inputs.shape)
        model.classes[:] = rng.normal(0, 0.1, model.classes.shape)
        model.tokens[:] = rng.normal(0, 0.1, model.tokens.shape)
        model.bias[:] = np.log(frequency)
        model.within[:] = np.log(share)
        model.scale[:] = 1 / sizes.context
        return model

    def predicted(self, context: np.ndarray) -> np.ndarray:
        out = self.inputs[context[:, 0]] * self.scale[0]
        for k in range(1, self.sizes.context):
            out += self.inputs[context[:, k]] * self.scale[k]
        return out

    def log10(self, context: np.ndarray, target: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """log10 P(class | context), times P(token | class, context) where the token has vectors."""
        out, starts = np.empty(len(target)), self.sizes.starts
        for at in range(0, len(target), SLAB):
            part = slice(at, at + SLAB)
            predicted, aim, word, logs = self.predicted(context[part]), target[part], rank[part], out[part]
            for lo in range(0, len(aim), BATCH):
                logs[lo : lo + BATCH] = _log_softmax(predicted[lo : lo + BATCH], self.classes, self.bias, aim[lo : lo + BATCH])
            order = np.argsort(aim, kind="stable")
            order = order[word[order] >= 0]
            cuts = np.searchsorted(aim[order], np.arange(len(starts)))
            for k in np.flatnonzero((np.diff(cuts) > 0) & (np.diff(starts) > 1)):
                a, b = starts[k], starts[k + 1]
                for lo in range(cuts[k], cuts[k + 1], BATCH):
                    rows = order[lo : min(lo + BATCH, cuts[k + 1])]
                    logs[rows] += _log_softmax(predicted[rows], self.tokens[a:b], self.within[a:b], word[rows] - a)
        return out / math.log(10)


def _log_softmax(predicted: np.ndarray, vectors: np.ndarray, bias: np.ndarray, target: np.ndarray) -> np.ndarray:
    s = predicted @ vectors.T
    s += bias
    own = s[np.arange(len(s)), target].astype(np.float64)
    if s.max() > 60:  # else no sum of exponentials can overflow
        own -= (rows := s.max(axis=1))
        s -= rows[:, None]
    np.exp(s, out=s)
    return own - np.log(s.sum(axis=1))


def contexts(inputs: np.ndarray, sizes: Sizes) -> np.ndarray:
    """The inputs before each token, nearest first; the last input number stands before a text."""
    k = sizes.context
    padded = np.concatenate([np.full(k, sizes.inputs - 1), inputs])
    return np.column_stack([padded[k - 1 - i : k - 1 - i + len(inputs)] for i in range(k)])


def from_data(scores: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(-scores, -30, 30)))


class Trainer:
    """Stochastic NCE steps with per-parameter rates (AdaGrad); classes share the noise of a
    batch, every token has its own. A step touches only the rows of its tokens."""

    def __init__(self, model: Model, past: np.ndarray, frequency: np.ndarray):
        self.m, self.z, self.seen = model, model.sizes, 0
        self.past = Model(past, self.z)
        self.log_noise = np.log(NOISE * frequency).astype(np.float32)
        self.rng = np.random.default_rng(2)
        self.noise = self.rng.choice(self.z.classes, (1 << 12, NOISE), p=frequency / frequency.sum())
        self.width = np.append(np.diff(self.z.starts), np.zeros(GROUPS, np.int64))
        self.first = np.append(self.z.starts[:-1], np.zeros(GROUPS, np.int64))

    def _rows(self, ids: np.ndarray, *parts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        """Adds gradients, one for each id, to the rows of (values, past) they belong to."""
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        once = ids[first]
        for value, past, grad in parts:
            g = np.add.reduceat(grad[order], first, axis=0)
            squares = past[once] + g * g
            past[once] = squares
            value[once] += RATE * g / np.sqrt(squares)

    def step(self, context: np.ndarray, target: np.ndarray, rank: np.ndarray) -> None:
        m, past, n = self.m, self.past, len(target)
        noise = self.noise[(self.seen // BATCH) % len(self.noise)]
        self.seen += n
        predicted = m.predicted(context)
        aimed, others = m.classes[target], m.classes[noise]
        own = (1 - from_data(np.einsum("ij,ij->i", predicted, aimed) + m.bias[target] - self.log_noise[target]))
        false = from_data(predicted @ others.T + m.bias[noise] - self.log_noise[noise]) * np.float32(-1)
        back = own[:, None] * aimed
        back += false @ others
        # tokens against tokens of their class
        rows = np.flatnonzero((rank >= 0) & (self.width[target] > 1))
        if len(rows):
            p, k = predicted[rows], target[rows]
            width = self.width[k][:, None]
            drawn = self.first[k][:, None] + (self.rng.random((len(rows), WITHIN)) * width).astype(np.int64)
            ids = np.concatenate([rank[rows][:, None], drawn], axis=1)
            vectors = m.tokens[ids]
            grad = from_data(np.einsum("rd,rkd->rk", p, vectors) + m.within[ids] - np.log(WITHIN / width).astype(np.float32)) * np.float32(-1)
            grad[:, 0] += 1
            back[rows] += np.einsum("rk,rkd->rd", grad, vectors)
            each = (grad[:, :, None] * p[:, None, :]).reshape(-1, self.z.dims)
        self._rows(
            np.concatenate([target, noise]),
            (m.classes, past.classes, np.concatenate([own[:, None] * predicted, false.T @ predicted])),
            (m.bias, past.bias, np.concatenate([own, false.sum(axis=0)])),
        )
        scale = np.stack([np.einsum("ij,ij->j", back, m.inputs[context[:, k]]) for k in range(self.z.context)])
        self._rows(context.T.ravel(), (m.inputs, past.inputs, (m.scale[:, None, :] * back[None]).reshape(-1, self.z.dims)))
        past.scale += scale * scale
        m.scale += RATE * scale / np.sqrt(past.scale)
        if len(rows):
            self._rows(ids.ravel(), (m.tokens, past.tokens, each), (m.within, past.within, grad.ravel()))


def most_frequent(counts: DataFrame, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, count and group of the ``TABLE`` most frequent tokens, in order of frequency.

    Tokens met once are left out where not all can be listed. A range of counts is cut off
    first, so that no task sorts all tokens.
    """
    bound = counts.filter("c > 1").count() if kinds > TABLE else kinds
    listed = counts if bound >= TABLE or kinds <= TABLE else counts.filter("c > 1")
    if bound > TABLE:
        steps = listed.groupBy(F.floor(F.log2("c") * 8).alias("step")).count().orderBy(F.desc("step")).collect()
        upto, floor_at = 0, steps[-1]["step"]
        for s in steps:
            upto += s["count"]
            if upto >= TABLE:
                floor_at = s["step"]
                break
        listed = listed.filter(F.floor(F.log2("c") * 8) > floor_at)
    table = listed.toPandas().sort_values(["c", "h"], ascending=[False, True])
    return tuple(table[k].to_numpy(np.int64) for k in ("h", "c", "grp"))


def averaged(copies: DataFrame) -> bytes:
    """The mean of the shards' parameters, weighted by tokens, piece by piece."""

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, total = None, 0, None
        out = lambda: pa.record_batch(
            [pa.array([at], pa.int32()), pa.array([(total / n).astype(np.float16).tobytes()], pa.binary())], names=["piece", "raw"]
        )
        for batch in batches:
            for piece, k, raw in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                piece, k, part = piece.as_py(), k.as_py(), np.frombuffer(raw.as_py(), np.float16).astype(np.float64)
                if piece != at:
                    if n:
                        yield out()
                    at, n, total = piece, 0, 0
                n, total = n + k, total + k * part
        if n:
            yield out()

    dealt = copies.repartition("piece").sortWithinPartitions("piece", "shard").select("piece", "n", "raw")
    return b"".join(bytes(r["raw"]) for r in sorted(dealt.mapInArrow(mean, "piece int, raw binary").collect(), key=lambda r: r["piece"]))


def shard_of(draw: Column, shards: int) -> Column:
    """The shard of a row of a round. Whole division: as a double a quotient of this size is a
    multiple of 512, and all rows would meet in one of 2, 4, 8, … shards."""
    return F.pmod(F.call_function("div", draw, F.lit(ROUNDS)), F.lit(shards)).cast("long")


def language_model(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", of: int = 7, rest: int = 2,
    least: int = LEAST, dims: int = DIMS, context: int = CONTEXT,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Trained on all rows that are not held out (crc32 of the id modulo ``of`` is ``rest``; a
    null id is held out). A null or empty text is its end alone. ``base_score`` sums
    log10((c + 1) / (N + V + 1)), ``score`` is the model's log10 probability of the text. With
    no training rows counts are 0 and all classes are equally likely. Rows stay as they are.
    Tokens counted ``least`` times have vectors of ``dims`` numbers; ``context`` tokens predict.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), held_out(F.col(id_col), of, rest).alias("held_out"), low(F.col(text_col).cast("string")).alias("text")
    )
    train = rows.filter("not held_out")
    counts = train.select("text").mapInArrow(_counts, "h long, grp int, c long").groupBy("h").agg(F.sum("c").alias("c"), F.min("grp").alias("grp"))
    counts = scratch.keep(counts, "counts")
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    h, c, grp = most_frequent(counts, kinds)
    words = int(np.count_nonzero(c >= least))
    sizes = Sizes(c[:words], dims, context)
    own = sizes.own
    class_count, class_kinds = np.zeros(sizes.classes), np.zeros(sizes.classes)
    for g in counts.groupBy("grp").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():
        class_count[own + g["grp"]], class_kinds[own + g["grp"]] = g["c"], g["n"]
    class_count[:own] = np.bincount(sizes.class_of, c[:words], own) if words else 0
    class_kinds[:own] = np.diff(sizes.starts)
    class_count[own:] -= np.bincount(grp[:words], c[:words], GROUPS)
    class_kinds[own:] -= np.bincount(grp[:words], minlength=GROUPS)
    frequency = (class_count + 1) / (class_count + 1).sum()
    share = c[:words] / class_count[sizes.class_of]
    shared = spark.sparkContext.broadcast((h, c, sizes, frequency, share))

    def trainer(state: bytes | None) -> Trainer:
        if state is None:
            model = Model.fresh(sizes, *shared.value[3:])
            return Trainer(model, np.full_like(model.flat, START), frequency)
        flat, past = np.split(np.frombuffer(state, np.float16).astype(np.float32), 2)
        return Trainer(Model(flat, sizes), past * past, frequency)

    def learn(batches: Iterator[pa.RecordBatch], before) -> Iterator[pa.RecordBatch]:
        state = before.value if before else None
        reader, t, shard, held, have = Reader(Table(*shared.value[:3])), None, None, [], 0

        def step(at_least: int) -> None:
            nonlocal held, have
            if have < at_least or not have:
                return
            x, y, z = (np.concatenate(p) for p in zip(*held, strict=True))
            full = have - have % at_least
            for at in range(0, full, BATCH):
                t.step(x[at : min(at + BATCH, full)], y[at : min(at + BATCH, full)], z[at : min(at + BATCH, full)])
            held, have = [(x[full:], y[full:], z[full:])], have - full

        def pieces() -> Iterator[pa.RecordBatch]:
            step(1)
            flat = np.concatenate([t.m.flat, np.sqrt(t.past.flat).clip(max=60_000)]).astype(np.float16)
            cut = range(0, len(flat), PIECE)
            for lo in range(0, len(cut), 256):
                raw = [flat[a : a + PIECE].tobytes() for a in cut[lo : lo + 256]]
                at = pa.array(range(lo, lo + len(raw)), pa.int32())
                yield pa.record_batch([at, pa.array([t.seen] * len(raw)), pa.array(raw, pa.binary()), pa.array([shard] * len(raw))], names=["piece", "n", "raw", "shard"])

        for batch in batches:
            for s, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if s != shard:
                    if t:
                        yield from pieces()
                    t, shard, held, have = trainer(state), s, [], 0
                r = reader.read(tokens(text.as_py()))
                held.append((contexts(r[0], sizes), r[1], r[2]))
                have += r.shape[1]
                step(BATCH)
        if t:
            yield from pieces()

    # a row's round and shard follow from its id and text
    draw = F.xxhash64("doc_id", "text", F.lit("lm"))
    placed = train.select("text", draw.alias("draw"))
    shards = max(1, min(SHARDS, total // ROUNDS // max(SHARD_TOKENS, PER_VECTOR * words)))
    before = None
    for k in range(ROUNDS):
        part = placed.filter(F.pmod("draw", F.lit(ROUNDS)) == k)
        part = part.withColumn("shard", shard_of(F.col("draw"), shards))
        part = part.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "draw").select("shard", "text")
        copies = part.mapInArrow(lambda b, before=before: learn(b, before), "piece int, n long, raw binary, shard long")
        state = averaged(copies)
        before = spark.sparkContext.broadcast(state) if state else before
    base_of = math.log10(total + kinds + 1)
    within = np.log10(class_count + class_kinds + 1)
    within[:own] = 0

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, model = Reader(Table(*shared.value[:3])), trainer(before.value if before else None).m
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                read = [reader.read(tokens(t.as_py())) for t in batch.column(2)]
                size = np.array([r.shape[1] for r in read])
                first = np.append(0, size.cumsum()[:-1])
                r = np.concatenate(read, axis=1)
                logs = model.log10(np.concatenate([contexts(x[0], sizes) for x in read]), r[1], r[2])
                c = r[3]
                own = np.where(c >= 0, np.log10(np.maximum(c, 0) + 1), 0.0)
                logs = logs + np.where(r[2] < 0, own, 0.0) - within[r[1]]
                rare = []
                for x in read:
                    found = np.unique(x[4][x[3] < 0], return_counts=True)
                    rare.append([{"h": h, "n": n} for h, n in zip(*(f.tolist() for f in found), strict=True)])
                yield pa.record_batch(
                    [
                        batch.column(0), batch.column(1), pa.array(size, pa.int64()),
                        pa.array(np.add.reduceat((c > 0).astype(np.int64), first)),
                        pa.array(np.add.reduceat(own - base_of, first)), pa.array(np.add.reduceat(logs, first)),
                        pa.array(rare, pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int32())]))),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"],
                )

    id_kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(
        score, f"doc_id {id_kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<struct<h: long, n: int>>"
    )
    scored = scratch.keep(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.h", "r.n")
    more = rare.join(counts.select("h", "c"), "h").groupBy("row").agg(
        F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("logs")
    )
    out = scored.drop("rare").join(more, "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base_score") + logs).alias("base_score"), (F.col("score") + logs).alias("score"),
    )
