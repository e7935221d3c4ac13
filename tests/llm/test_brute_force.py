"""The learned scores against plain loops over the same rows."""

import json
import math
import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
WRAP = (1 << 64) - 1


@pytest.fixture(scope="module")
def tables(spark):
    return tuple(spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))


def training_rows(docs, labels, label, of, rest):
    """Texts and labels that may be learned from, in the order of the operators' marks."""
    marks = {r[0]: r[1] for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit(1))).distinct().collect()}
    known = {r["doc_id"]: r[label] for r in labels.collect() if r[label] is not None and crc32(str(r["doc_id"]).encode()) % of != rest}
    rows = [(marks[r.doc_id], r.text, int(known[r.doc_id])) for r in docs.collect() if r.doc_id in known and r.text is not None]
    rows.sort()
    return [r[1] for r in rows], [r[2] for r in rows]


def mix(x):
    x ^= x >> 31
    x = x * 0x9E3779B97F4A7C15 & WRAP
    x ^= x >> 29
    x = x * 0xD6E8FEB86659FD93 & WRAP
    return x ^ (x >> 32)


def sparse(text, q):
    """Weights of the hashed n-grams of a text as a dict, one n-gram at a time."""
    words = (text or "").encode().split()
    own = [xxhash.xxh64_intdigest(w, 5) for w in words]
    shapes = [xxhash.xxh64_intdigest(b"\0" + q.shape(w.decode()).encode(), 5) for w in words]
    grams = own + shapes
    for k, hashes in ((1, own), (2, shapes)):
        grams += [mix((a * 3 + b * 5 + k) & WRAP) for a, b in zip(hashes, hashes[1:])]
    out = defaultdict(float)
    for g in grams:
        out[g >> (64 - q.BITS)] += q.SCALE / len(grams)
    return out


def test_quality_against_ftrl_with_dicts(tables):
    from quillspark.llm import quality as q

    docs, labels = tables
    texts, wanted = training_rows(docs, labels, "quality", 4, 2)
    rows = [{**sparse(t, q), "bias": 1.0} for t in texts]
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= q.L1:
            return 0.0
        return -(z[i] - math.copysign(q.L1, z[i])) / ((q.BETA + math.sqrt(n[i])) / q.ALPHA + q.L2)

    sigmoid = lambda s: 1 / (1 + math.exp(-max(-30.0, min(30.0, s))))
    for epoch in range(q.EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            w = {i: weight(i) for i in rows[k]}
            error = sigmoid(sum(w[i] * x for i, x in rows[k].items())) - wanted[k]
            for i, x in rows[k].items():
                g = error * x
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / q.ALPHA * w[i]
                n[i] += g * g
    want = {r.doc_id: sigmoid(weight("bias") + sum(weight(i) * x for i, x in sparse(r.text, q).items())) for r in docs.collect()}
    got = {r.doc_id: r.score for r in q.quality(docs, labels).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[i] - want[i]) for i in want) < 1e-4


def test_toxicity_against_a_walk_of_the_trees(tables):
    from quillspark.llm import toxicity as x

    docs, labels = tables
    texts, wanted = training_rows(docs, labels, "toxic", 3, 1)
    model = json.loads(x.fit(texts, np.array(wanted)))
    at, rate = model["isotonic"]
    assert len(set(at)) == len(at)  # a margin has one rate

    def score(text):
        values = x.features(text, model["lexicon"], x.Plain())
        bins = [sum(e <= v for e in edges) for v, edges in zip(values, model["edges"], strict=True)]
        margin = model["base"]
        for tree in model["trees"]:
            node = 0
            for depth in range(x.DEPTH):
                feature, upto = tree["splits"][2**depth - 1 + node]
                node = 2 * node + (bins[feature] > upto)
            margin += tree["leaf"][node]
        if margin <= at[0]:
            return rate[0]
        for a, b, low, high in zip(at, at[1:], rate, rate[1:]):
            if a <= margin <= b:
                return high if b == a else low + (high - low) * (margin - a) / (b - a)
        return rate[-1]

    got = {r.doc_id: r.score for r in x.toxicity(docs, labels).collect()}
    want = {r.doc_id: score(r.text) for r in docs.collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[i] - want[i]) for i in want) < 1e-9


def test_boosting_against_loops(monkeypatch):
    from quillspark.llm import toxicity as x

    monkeypatch.setattr(x, "TREES", 5)
    rng = np.random.default_rng(4)
    data = rng.normal(size=(80, 4)).round(1)
    y = (data[:, 0] + data[:, 1] * data[:, 2] + rng.normal(0, 0.3, 80) > 0).astype(int)
    model = x.boost(data, y)
    bins = [[sum(e <= v for e in edges) for v, edges in zip(row, model["edges"], strict=True)] for row in data]
    margin = [math.log(y.mean() / (1 - y.mean()))] * len(y)
    for tree in model["trees"]:
        p = [1 / (1 + math.exp(-m)) for m in margin]
        members = {0: list(range(len(y)))}
        for depth in range(x.DEPTH):
            split = {}
            for node, rows in members.items():
                part = lambda some: sum(y[i] - p[i] for i in some) ** 2 / (sum(p[i] * (1 - p[i]) for i in some) + x.LAMBDA)
                heavy = lambda some: sum(p[i] * (1 - p[i]) for i in some) >= 1e-3

                def gain(j, k):
                    low, high = [i for i in rows if bins[i][j] <= k], [i for i in rows if bins[i][j] > k]
                    return part(low) + part(high) - part(rows) if heavy(low) and heavy(high) else 0.0

                j, k = tree["splits"][2**depth - 1 + node]
                best = max((gain(a, b) for a in range(4) for b in range(x.BINS)), default=0.0) if rows else 0.0
                assert abs((gain(j, k) if rows else 0.0) - max(best, 0.0)) < 1e-6
                for i in rows:
                    split.setdefault(2 * node + (bins[i][j] > k), []).append(i)
            members = split
        for node, rows in members.items():
            leaf = x.RATE * sum(y[i] - p[i] for i in rows) / (sum(p[i] * (1 - p[i]) for i in rows) + x.LAMBDA)
            assert abs(tree["leaf"][node] - leaf) < 1e-9
            for i in rows:
                margin[i] += leaf
    assert np.allclose(x.margins(model, data), margin)


def test_language_model_score_against_a_loop_over_tokens(spark):
    """Without training rows the model is the fresh one, so every probability is known."""
    from quillspark.llm import lm

    ids = [i for i in range(200) if crc32(str(i).encode()) % 7 == 2][:12]
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["a", "Bee", "see", "deed", "é"]) for _ in range(rng.randrange(0, 40)))) for i in ids]
    sizes = lm.Sizes(np.zeros(0, np.int64))
    model = lm.Model.fresh(sizes, np.full(lm.GROUPS, 1 / lm.GROUPS), np.zeros(0))
    group = lambda w: xxhash.xxh64_intdigest(w[-2:], 3) % lm.GROUPS
    want = {}
    for i, text in rows:
        past, total = [lm.GROUPS] * lm.CONTEXT, 0.0
        for word in [*text.translate({65 + k: 97 + k for k in range(26)}).encode().split(), lm.END]:
            predicted = sum(model.inputs[past[-1 - k]].astype(float) * model.scale[k] for k in range(lm.CONTEXT))
            scores = [float(predicted @ c) + float(b) for c, b in zip(model.classes.astype(float), model.bias, strict=True)]
            total += (scores[group(word)] - math.log(sum(map(math.exp, scores)))) / math.log(10)
            past.append(group(word))
        want[i] = total
    got = {r.doc_id: r for r in lm.language_model(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got.keys() == want.keys()
    assert all(r.held_out and r.train_tokens == 0 and abs(r.score - want[i]) < 1e-3 for i, r in got.items())
