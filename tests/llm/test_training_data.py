"""Small tables with nulls, empty texts, ties, repeated rows and clashing column names."""

import hashlib
import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASH = ["size", "n", "row", "line", "at", "key", "comp", "bands", "position", "copies", "words", "target", "score", "ids"]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def awkward():
    a, b = prose(1, 60), prose(2, 400)
    words = a.split()
    near = " ".join([*words[:30], "CHANGED", *words[31:]])
    texts = [a, a, near, a.upper(), None, "", " \n ", "one two", "one two", b, b + "\n" + a, "x" * 20_000, a + "\n" + prose(3, 9), prose(3, 9), "é ü  \t ß"]
    rows = [(i, t, "en", ["s1", "s2", None][i % 3], len(t) if t else None) for i, t in enumerate(texts)]
    rows += [(0, a, "en", "s1", 5), (None, a, None, None, None), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    out = spark.createDataFrame(awkward(), DOCS)
    for name in CLASH:
        out = out.withColumn(name, F.lit("clash"))
    return out


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def labels_of(spark, column):
    rows = [(i, i % 2) for i in range(15)] + [(3, 1), (None, 1), (4, None)]
    return spark.createDataFrame(rows, f"doc_id long, {column} int")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return [w.decode() for w in (text or "").encode().split()]


def shingles(text):
    w = words(low(text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components_by_loop(rows):
    sets = {i: shingles(t) for i, t in rows}
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                both = len(sets[i] & sets[j])
                if both and 100 * both >= 75 * len(sets[i] | sets[j]) and comp[j] < comp[i]:
                    comp[i], changed = comp[j], True
    return comp


def test_near_duplicates(spark, docs, none):
    from quillspark.llm.near_dup import near_duplicates

    got = near_duplicates(docs).collect()
    want = components_by_loop([(r[0], r[1]) for r in awkward() if r[0] is not None])
    assert len(got) == len(awkward())
    for r in got:
        assert r.component_id == want.get(r.doc_id) and r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    assert near_duplicates(none).count() == 0


def test_large_groups_of_near_copies(spark):
    from quillspark.llm.near_dup import near_duplicates

    rng, rows = random.Random(5), []
    base = prose(9, 80).split()
    for i in range(400):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            w[rng.randrange(80)] = prose(rng.random(), 1)
        rows.append((i, " ".join(w)))
    want = components_by_loop(rows)
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_bayes_thresholds_rise_and_hold():
    from quillspark.llm.near_dup import HASHES, agree, thresholds

    fewest = thresholds(0.75, 1e-6)
    assert fewest == sorted(fewest) and fewest[-1] < 0.75 * HASHES
    rng = np.random.default_rng(1)
    left = rng.integers(0, 1 << 16, (3000, HASHES)).astype(np.uint16)
    at = lambda s: np.where(rng.random(left.shape) < s, left, left + 1).astype(np.uint16)
    assert len(agree(left, at(0.75), fewest)) == 3000
    assert len(agree(left, at(0.4), fewest)) == 0


def edit_at_most_one(a, b):
    if a == b:
        return True
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_line_dedup(spark):
    from quillspark.llm.lines import dedup_lines

    rng = random.Random(3)
    base = [prose(k, n).split() for k, n in enumerate([3, 8, 8, 9, 12, 30])]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2])):
                k = rng.randrange(len(w))
                kind = rng.randrange(3)
                w[k : k + 1] = [[], ["new"], [w[k], f"w{rng.randrange(3)}"]][kind]
            lines.append(" ".join(w))
        rows.append((i, rng.choice(["\n", "\n\n"]).join(lines)))
    seen, want = [], {}
    for i, text in rows:
        kept = []
        for line in text.split("\n"):
            w = line.split()
            gone = w and any(w == s or (len(w) >= 8 and len(s) >= 8 and edit_at_most_one(w, s)) for s in seen)
            seen += [w] if w else []
            kept += [] if gone else [line]
        want[i] = "\n".join(kept)
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_line_dedup_awkward(docs, none):
    from quillspark.llm.lines import dedup_lines

    out = dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    got = out.collect()
    assert len(got) == len(awkward())
    text = {(r.doc_id, r.n_chars): r.text for r in got}
    assert text[(4, None)] is None and text[(5, None)] == "" and text[(6, 3)] == " \n "
    assert all(r.n_removed <= r.n_lines for r in got)
    assert dedup_lines(none).count() == 0


def vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=12)]) for i in range(230)]
    rows += [(230 + i, rows[i][1]) for i in range(30)]  # ties
    rows += [(300, None), (400, []), (500, [float("nan")] * 12), (600, [None] * 12), (700, [0.0] * 12), (None, rows[0][1]), rows[0], (800, [1.0, 2.0])]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("dim", F.lit(1))


def test_top_products(spark):
    from quillspark.llm.topk import best_products, top_products

    rows, table = vectors(spark)
    ints = {i: np.floor(64 * np.array(v)) for i, v in rows if v and i is not None and i not in (500, 600)}
    got = {}
    for r in top_products(table).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in [i for i in ints if i % 20 == 0]:
        all_of = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))[:20]
        want = [(k + 1, i, -s) for k, (s, i) in enumerate(all_of)]
        assert sorted(got.get(q, [])) == want
    assert top_products(table.limit(0)).count() == 0
    many = np.random.default_rng(1).integers(-60, 60, (5000, 64)).astype(float)
    ids = np.arange(5000)
    q, c, s = best_products(ids[:40], many[:40], ids, many, 20)
    want = many[:40] @ many.T
    want[ids[:40], ids[:40]] = -np.inf
    for k in range(40):
        assert (np.sort(s[q == k]) == np.sort(want[k])[-20:]).all()


def test_neighbours_recall(spark):
    from quillspark.llm.ann import neighbours

    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 32))
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    got = {}
    for r in neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert abs(r.score - math.sqrt(((x[r.query_id] - x[r.vec_id]) ** 2).sum())) < 1e-12
    hit = 0
    for q, ids in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hit += len(set(ids) & set(np.argsort(d)[:10].tolist()))
    assert len(got) == 30 and hit / 300 >= 0.9
    _, table = vectors(spark)
    assert {r.query_id for r in neighbours(table).collect()} == {0, 100, 200}
    assert neighbours(table.limit(0)).count() == 0


@pytest.mark.parametrize("module,name,label,mod,rest", [("quality", "quality", "quality", 4, 2), ("toxicity", "toxicity", "toxic", 3, 1)])
def test_classifiers_on_awkward_rows(spark, docs, none, module, name, label, mod, rest):
    import importlib

    fn = getattr(importlib.import_module(f"quillspark.llm.{module}"), name)
    got = fn(docs, labels_of(spark, label)).collect()
    assert len(got) == len(awkward())
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
        assert r.held_out == (r.doc_id is None or crc32(str(r.doc_id).encode()) % mod == rest)
    assert fn(none, labels_of(spark, label)).count() == 0
    assert {r.score for r in fn(docs, labels_of(spark, label).limit(0)).collect()} == {0.5}


def test_held_out_accuracy(spark):
    from quillspark.llm.quality import quality
    from quillspark.llm.toxicity import toxicity

    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    for fn, label, least in ((quality, "quality", 0.97), (toxicity, "toxic", 0.95)):
        rows = fn(docs, labels).filter("held_out").join(labels, "doc_id").select("predicted", label).collect()
        assert sum(r.predicted == r[label] for r in rows) / len(rows) >= least


def test_obfuscated_words_are_read():
    from quillspark.llm.toxicity import plain

    assert plain("Idiot!")[0] == plain("1d10t")[0] == plain("id.iot")[0] == plain("iiidiot")[0] == "idiot"
    assert plain("idiot")[1] is False and plain("1d10t")[1] is True


def test_isotonic_rises():
    from quillspark.llm.toxicity import isotonic

    rng = np.random.default_rng(0)
    x = rng.normal(size=500)
    at, rate = isotonic(x, (rng.random(500) < 1 / (1 + np.exp(-3 * x))).astype(int))
    assert at == sorted(at) and rate == sorted(rate) and 0 < rate[0] < 0.2 and 0.8 < rate[-1] < 1


def test_language_model(spark, docs, none):
    from quillspark.llm.lm import language_model

    got = language_model(docs).collect()
    counts = Counter()
    tokens = lambda t: [*words(low(t or "")), "\n"]
    rows = [(r[0], r[1]) for r in awkward()]
    held = lambda i: i is None or crc32(str(i).encode()) % 7 == 2
    for i, t in rows:
        if not held(i):
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (-1 if i is None else i, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 6))
        for i, t in rows
    )
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 for r in got)
    assert language_model(none).count() == 0


def test_token_probabilities_add_up():
    """Over all tokens that have vectors and all groups, for some context."""
    from quillspark.llm.lm import GROUPS, Model, Sizes

    counts = np.array([900, 500, 200, 90, 80, 70, 60, 50, 40, 30, 30, 30, 25, 24, 23, 22, 21, 20])
    z = Sizes(counts, dims=5, context=3)
    assert 1 < z.own < len(counts) and z.starts[-1] == len(counts) and (np.diff(z.starts) > 0).all()
    share = counts / np.bincount(z.class_of, counts)[z.class_of]
    model = Model.fresh(z, np.full(z.classes, 1 / z.classes), share)
    target = np.concatenate([z.class_of, z.own + np.arange(GROUPS)])
    rank = np.concatenate([np.arange(z.words), np.full(GROUPS, -1)])
    context = np.random.default_rng(0).integers(0, z.inputs, (1, 3))
    logs = model.log10(np.repeat(context, len(target), axis=0), target, rank)
    assert abs((10**logs).sum() - 1) < 1e-5


def test_language_model_learns_contexts_and_not_the_split(spark):
    """Words of one frequency that follow each other by rule: only their order tells them apart."""
    from quillspark.llm.lm import language_model

    names = [f"w{k:02d}x" for k in range(40)]
    rows = [(i, " ".join(names[(i * 7 + 3 * j) % 40] for j in range(400))) for i in range(1500)]
    few, many = (spark.createDataFrame(rows, "doc_id long, text string").repartition(n, "doc_id") for n in (1, 5))
    one = {r.doc_id: r for r in language_model(few).collect()}
    assert sum(r.score for r in one.values() if r.held_out) > 0.8 * sum(r.base_score for r in one.values() if r.held_out)
    assert all(abs(r.score - one[r.doc_id].score) < 1e-3 for r in language_model(many).collect())


def test_model_beats_counts_on_held_out_texts(spark):
    from quillspark.llm.lm import language_model

    rows = language_model(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_rare_words_by_join(spark, monkeypatch):
    from quillspark.llm import lm

    rows = [(i, prose(i % 7, 50) + " " + prose(100 + i, 5)) for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    keep = lambda df: sorted((r.doc_id, r.n_known, round(r.base_score, 6)) for r in df.collect())
    want = keep(lm.language_model(table))
    monkeypatch.setattr(lm, "TABLE", 100)
    assert keep(lm.language_model(table)) == want


def removed_by_loop(rows, window):
    seen = Counter()
    for _, t in rows:
        w = words(t)
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        out.append((-1 if i is None else i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def test_substring_dedup(spark, docs, none, monkeypatch):
    from quillspark.llm import substring

    show = lambda df: sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect())
    rows = [(r[0], r[1]) for r in awkward()]
    assert show(substring.remove_repeats(docs)) == removed_by_loop(rows, 35)
    rng = random.Random(8)
    passages = [prose(k, 50) for k in range(4)]
    rows = [
        (i, " ".join([prose(500 + i, rng.randrange(1, 60)), rng.choice(passages)[rng.randrange(60) :], prose(900 + i, 20), rng.choice(["", "la " * 90])]))
        for i in range(60)
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert show(substring.remove_repeats(table)) == removed_by_loop(rows, 35)
    monkeypatch.setattr(substring, "HOT", 3)  # windows dealt one by one
    assert show(substring.remove_repeats(table)) == removed_by_loop(rows, 35)
    assert substring.remove_repeats(none).count() == 0


def test_windows_of_hot_segments_do_not_meet_in_one_shard(spark, monkeypatch, tmp_path):
    from quillspark.llm import substring

    passage, show = prose(1, 40), lambda df: sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect())
    rows = [(i, " ".join([prose(500 + i, 40), passage, prose(900 + i, 40)])) for i in range(80)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    real, folder = substring._shard, str(tmp_path)

    def counted(window):
        fn = real(window)

        def out(t):
            with open(f"{folder}/{t.num_rows}", "w"):
                return fn(t)

        return out

    monkeypatch.setattr(substring, "_shard", counted)
    monkeypatch.setattr(substring, "SHARD_WORDS", 1000)
    monkeypatch.setattr(substring, "HOT", 5)
    assert show(substring.remove_repeats(table)) == removed_by_loop(rows, 35)
    assert max([int(p.name) for p in tmp_path.iterdir()], default=0) < 80


def test_fm_index_against_counting():
    from quillspark.llm.fm_index import repeated_windows

    rng = np.random.default_rng(0)
    for _ in range(60):
        window = int(rng.integers(2, 12))
        base = [rng.integers(1, rng.integers(3, 200), rng.integers(1, 60)) for _ in range(rng.integers(1, 12))]
        texts = [base[rng.integers(len(base))][: rng.integers(1, 60)].copy() for _ in range(20)]
        for t in texts[::2]:
            t[rng.integers(len(t))] = 300
        weight = rng.integers(1, 3, len(texts))
        seen = Counter()
        for t, k in zip(texts, weight, strict=True):
            for i in range(len(t) - window + 1):
                seen[tuple(t[i : i + window])] += k
        want = [[seen[tuple(t[i : i + window])] > 1 for i in range(len(t) - window + 1)] for t in texts]
        assert [x.tolist() for x in repeated_windows(texts, weight, window)] == want


def test_mixing(spark, docs, none):
    from quillspark.llm.mixing import mix, schedule

    got = mix(docs).collect()
    assert len(got) == len(awkward())
    total = sum(r["size"] for r in got)
    targets = {r.source: r.target for r in got}
    sizes = {r.source: r.source_size for r in got}
    assert abs(sum(targets.values()) - total) < 1e-6
    assert all(t <= 3 * sizes[s] + 1e-9 for s, t in targets.items())
    assert all(r.taken <= 3 * r["size"] for r in got)
    for s in targets:
        taken = sum(r.taken for r in got if r.source == s)
        largest = max(r["size"] for r in got if r.source == s)
        assert abs(taken - targets[s]) <= largest
    assert all(0 <= r.position <= 1 for r in got if r.taken) and all(r.position is None for r in got if not r.taken)
    assert schedule(mix(docs)).count() == sum(r.copies for r in got)
    assert mix(none).count() == 0


def test_mixture_is_what_op8_takes(spark, tmp_path):
    """Copies in the order of their schedules; ids may be null or repeated."""
    from quillspark.llm.mixing import mix, mixture
    from quillspark.llm.queries import op8

    rows = [(i % 40 if i % 9 else None, "w " * (i % 7), f"s{i % 5 % 4}" if i % 11 else None) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan, copies = mixture(docs)
    plan, copies = plan.collect(), copies.collect()
    assert [c.position for c in copies] == sorted(c.position for c in copies)
    assert Counter(c.row for c in copies) == {p.row: p.copies for p in plan if p.copies} and len(plan) == 200
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    cols = ["doc_id", "size", "source_size", "target", "taken", "position"]
    key = lambda r: [(v is None, v or 0) for v in r]
    want = sorted(map(tuple, mix(docs).select(cols).collect()), key=key)
    assert sorted(map(tuple, op8(spark, str(tmp_path)).collect()), key=key) == want
    assert sum(w[4] for w in want) == sum(c.size for c in copies)


def test_positions_invert_the_demand(spark):
    from quillspark.llm.mixing import position

    rows = spark.createDataFrame([(x / 20, t) for x in range(21) for t in (-0.5, 0.0, 0.5)], "share double, tilt double")
    for r in rows.select("*", position(F.col("share"), F.col("tilt")).alias("t")).collect():
        assert abs(r.t + r.tilt * (r.t * r.t - r.t) - r.share) < 1e-9


def test_water_level(spark):
    from quillspark.llm.mixing import source_targets

    rows = spark.createDataFrame([("a", 100), ("b", 1), ("c", 2), (None, 5)], "source string, source_size long")
    got = {r.source: r.target for r in source_targets(rows).collect()}
    assert got["b"] == 3 and got["c"] == 6 and got[None] == 15 and abs(got["a"] - 84) < 1e-9


def test_bpe_is_tiktoken(spark, docs, none):
    import tiktoken
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from quillspark.llm import bpe

    path, pattern = bpe.default_vocabulary()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})

    @settings(max_examples=200, deadline=None)
    @given(st.text(max_size=80))
    def same(text):
        ids = bpe.encode_text(text, path, pattern)
        assert ids == own.encode_ordinary(text) and bpe.decode_ids(ids, path, pattern) == text

    same()
    got = bpe.decode(bpe.encode(docs)).collect()
    assert len(got) == len(awkward())
    want = sorted((-1 if r[0] is None else r[0], np.array(own.encode_ordinary(r[1] or ""), "<u4").tobytes(), r[1] or "") for r in awkward())
    assert sorted((-1 if r.doc_id is None else r.doc_id, bytes(r.ids), r.decoded) for r in got) == want
    assert bpe.encode(none).count() == 0


def test_bpe_forgets_and_goes_on(monkeypatch):
    import tiktoken

    from quillspark.llm import bpe

    path, pattern = bpe.default_vocabulary()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    for name in ("STATES", "PIECES", "PAIRS"):
        monkeypatch.setattr(bpe, name, 20)
    text = prose(4, 300) + " 日本語 — " + "ab" * 500
    assert bpe.encode_text(text, path, pattern) == own.encode_ordinary(text)


def test_decoder_mends_ill_formed_bytes():
    from quillspark.llm.bpe import Decoder

    for raw in (b"a\xffb", b"\xe2\x82", b"\xe2\x82x", b"\xf0\x9f\x98\x80", b"\xc0\x80", b"\xed\xa0\x80"):
        decoder = Decoder({k: bytes([k]) for k in range(256)})
        assert decoder.feed(raw) + decoder.close() == raw.decode("utf-8", "replace")


def test_pipeline_stages_keep_what_they_should(spark, tmp_path):
    import corpus_pipeline as pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, folder)
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if name != "byte-level bpe":
            assert docs.columns == columns
        if name == "minhash near-dedup":
            rows = before.select("doc_id", "text").collect()
            comp = components_by_loop(rows)
            assert {r.doc_id for r in docs.collect()} == {i for i, c in comp.items() if i == c}
    texts = {r.doc_id: r.text for r in before.collect()}
    for r in docs.collect():
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_pipeline_stages_with_null_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline as pipeline
    from quillspark.llm import quality as q
    from quillspark.llm.mixing import mix

    folder = "/root/testdata/sf0.001"
    given = spark.read.parquet(f"{folder}/documents.parquet")
    columns = given.columns
    rows = lambda df: Counter(tuple(r) for r in df.select(columns).collect())
    ids = F.when(F.col("doc_id") % 3 == 0, F.lit(None)).when(F.col("doc_id") % 3 == 1, F.col("doc_id") % 10).otherwise(F.col("doc_id"))
    twice = given.filter("doc_id % 4 = 0")
    mess = given.union(twice).union(twice).withColumn("doc_id", ids.cast(given.schema["doc_id"].dataType)).select(columns)
    mess.write.parquet(str(tmp_path / "mess"))
    docs = spark.read.parquet(str(tmp_path / "mess"))

    # quality: a row goes by its own score, whatever its id
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    good = q.quality(docs, labels, keep=columns).filter("predicted = 1").select("kept.*")
    want, got = rows(good), rows(pipeline.good_documents(spark, docs, folder))
    assert got == want and 0 < sum(got.values()) < docs.count()
    assert any(r[0] is None for r in got) and any(r[0] is None for r in rows(docs) - got)

    # near-dedup: every row is a node, of a group the first by id stays
    some = docs.orderBy("doc_id", "text").limit(250).collect()
    table = spark.createDataFrame(some, docs.schema)
    comp = components_by_loop([(k, r["text"]) for k, r in enumerate(some)])
    groups = {}
    for k, c in comp.items():
        groups.setdefault(c, []).append(k)
    got = rows(pipeline.one_of_each_group(spark, table, folder))
    at = columns.index("doc_id")
    assert sum(got.values()) == len(groups)
    first = lambda members: min((some[k][at] is None, some[k][at] or 0) for k in members)
    assert Counter((r[at] is None, r[at] or 0) for r in got.elements()) == Counter(map(first, groups.values()))

    # mixing: as many rows as copies, at most three of a row
    mixed = rows(pipeline.mixed_sources(spark, docs, folder))
    before = rows(docs)
    assert sum(mixed.values()) == mix(docs).agg(F.sum("copies")).first()[0]
    assert all(n <= 3 * before[r] for r, n in mixed.items())

    # lines and tokens: a row for a row
    assert pipeline.without_repeated_lines(spark, docs, folder).count() == docs.count()
    assert pipeline.token_ids(spark, table, folder).count() == len(some)


def test_language_model_fills_all_shards(spark):
    """A round's rows fall evenly into any number of shards, powers of two among them."""
    from quillspark.llm import lm

    draw = F.xxhash64("id", F.lit("lm"))
    part = spark.range(12_000).select(draw.alias("draw")).filter(F.pmod("draw", F.lit(lm.ROUNDS)) == 1)
    for shards in (3, 6, 8, 64):
        sizes = [r["count"] for r in part.groupBy(lm.shard_of(F.col("draw"), shards).alias("s")).count().collect()]
        assert len(sizes) == shards and max(sizes) < 2 * sum(sizes) / shards
