import itertools
import json
import math
import pathlib
import random
from types import SimpleNamespace

import numpy as np
from pyspark.sql import functions as F

from quillspark.functions.hashing import coin, draw32
from quillspark.operators import attribution, constraints, edits, exemplars, greedy, labels, lexsub, metrics, mining, ner
from quillspark.operators import neighbours, sampling, trees, vocabulary
from quillspark.plans import report_queries


def rows(df, *by):
    return [tuple(r) for r in (df.orderBy(*by) if by else df).collect()]


# ---- entities --------------------------------------------------------------------------
def spans_of(spark, tokens, tags, **options):
    df = spark.createDataFrame([(tokens, tags)], "tokens array<string>, tags array<string>")
    r = ner.with_spans(df, "tokens", "tags", **options).first()
    return r["all_phrases"], r["ner_phrases"], r["ner_phrase_tags"]


def test_spans(spark):
    # adjacent entities merge and keep the last B-; a span at the end is not a phrase
    got = spans_of(spark, list("abcdef"), ["B-X", "B-Y", "O", "I-Z", "O", "B-W"])
    assert got == (["a b", "d", "f"], ["a b", "d"], ["B-Y", ""])
    fixed = spans_of(spark, list("abcdef"), ["B-X", "B-Y", "O", "I-Z", "O", "B-W"], split_on_b=True, flush_last=True)
    assert fixed == (["a", "b", "d", "f"], ["a", "b", "d", "f"], ["B-X", "B-Y", "", "B-W"])
    assert spans_of(spark, ["a"], ["O"]) == ([], [], [])
    # a type named O is still an entity
    assert spans_of(spark, ["a", "b"], ["B-O", "O"]) == (["a"], ["a"], ["B-O"])


def paint_by_hand(words, phrases, tags):
    out, low, lost = ["O"] * len(words), [w.lower() for w in words], []
    for phrase, tag in zip(phrases, tags):
        pw = phrase.lower().split()
        at = [i for i in range(len(words)) if low[i : i + len(pw)] == pw]
        for i in at:
            for o in range(len(pw)):
                out[i + o] = tag if o == 0 else "I-" + tag.split("-")[-1]
        if not at:
            lost.append(phrase)
    return out, lost


def test_paint_against_loop(spark):
    rng = random.Random(5)
    vocab = ["a", "b", "c", "New", "York"]
    data = []
    for i in range(30):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 30))]
        phrases = [" ".join(rng.choice(vocab).upper() for _ in range(rng.choice([1, 2, 3]))) for _ in range(4)]
        if len(words) > 14:
            phrases.append(" ".join(words[2:14]))  # longer than the words a place carries
        data.append((i, " ".join(words), phrases, [f"B-{k}" for k in range(len(phrases))]))
    df = spark.createDataFrame(data, "id int, text string, p array<string>, t array<string>")
    painted, missing = ner.paint(df, "id", "text", "p", "t")
    got = {r["id"]: r["tags"] for r in painted.collect()}
    lost = sorted((r["id"], r["phrase"]) for r in missing.collect())
    want = {i: paint_by_hand(text.split(), p, t) for i, text, p, t in data}
    assert got == {i: w[0] for i, w in want.items()}
    assert lost == sorted((i, ph) for i, w in want.items() for ph in w[1])


def test_paint_splits_punctuation(spark):
    df = spark.createDataFrame([(1, "In Rome, it rains.", ["rome"], ["B-LOC"])], "id int, text string, p array<string>, t array<string>")
    r = ner.paint(df, "id", "text", "p", "t")[0].first()
    assert r["words"] == ["In", "Rome", ",", "it", "rains", "."]
    assert r["tags"] == ["O", "B-LOC", "O", "O", "O", "O"]


def test_paint_odd_rows(spark):
    rows = [
        (1, "a\x0bb\x1cc\u2003d\u00a0\u200be.f", ["B C", "\u200bE", None, "", "b\tc", "zz"], ["B-X-Y", "B-E", "B-N", "B-0", None, "B-Z"]),
        (2, None, ["a"], ["B-A"]), (3, "a a a", None, None), (4, "", [], []), (5, "a a a", ["a a", "A"], ["B-1", "B-"]),
    ]
    df = spark.createDataFrame(rows, "id int, text string, p array<string>, t array<string>")
    out = ner.paint_rows(df, "id", "text", "p", "t")
    got = {r["id"]: r for r in out.collect()}
    assert got[1]["words"] == ["a", "b", "c", "d", "\u200be", ".", "f"]
    assert got[1]["tags"] == ["O", "O", "O", "O", "B-E", "O", "O"]  # the last of equal phrases paints, and has no tag
    assert [tuple(m) for m in got[1]["missing"]] == [(3, ""), (5, "zz")]  # a null phrase is none
    assert got[2]["words"] == got[2]["tags"] == [] and got[2]["missing"][0]["phrase"] == "a"
    assert got[3]["tags"] == ["O"] * 3 and got[4]["tags"] == got[4]["missing"] == []
    assert got[5]["tags"] == ["B-"] * 3
    assert all(len(r["words"]) == len(r["tags"]) for r in got.values())
    # without the words, no list of all words is split, sorted or met with a map in Spark
    plan = out.select("id", "tags", "missing")._jdf.queryExecution().optimizedPlan().toString()
    assert "map_zip_with" not in plan and "regexp_extract_all" not in plan


# ---- keyword walks -----------------------------------------------------------------------
def test_keyword_walk_against_loop(spark):
    rng = random.Random(3)
    words = ["ab", "bc", "cd", "de", "ef", "fg"]
    data = [(i, rng.sample(words, rng.randint(0, 6))) for i in range(60)]
    alts = [(i, w, rng.choice(words + ["zz"])) for i, ks in data for w in ks if rng.random() < 0.7]
    df = spark.createDataFrame(data, "id bigint, kws array<string>")
    al = spark.createDataFrame(alts, "id bigint, target string, alt string")
    flips = {
        (r["id"], r["pos"]): r["h"]
        for r in df.select("id", F.posexplode("kws").alias("pos", "w"))
        .select("id", "pos", coin("s", F.col("id"), F.col("pos")).alias("h")).collect()
    }
    table = {(i, w): a for i, w, a in alts}
    got = {r["id"]: (r["final"], r["pool"]) for r in constraints.apply_alternatives(df, al, "s").collect()}
    for i, ks in data:
        walk, pool = list(ks), []
        for p, w in enumerate(ks):
            alt = table.get((i, w))
            if alt is None:
                continue
            if flips[(i, p)]:
                walk[p] = f"{w} or {alt}"
            elif alt not in walk:
                pool.append(alt)
        assert got[i] == (walk, pool), i


def test_alternatives_inside_the_row(spark):
    # held in the row they give what a table of them gives, and no row leaves its task
    words = [[f"w{chr(97 + (i * j) % 7)}" for j in range(i)] for i in range(12)]
    kws = [sorted(set(w)) for w in words]
    data = [(i, kws[i], ["wa", "zz"], [f"p{i}"], [(w, r, x) for w in kws[i] for r, x in enumerate((f"{w}x", "zz")) if (i + len(w) + r) % 5]) for i in range(12)]
    schema = "id bigint, kws array<string>, other array<string>, phrases array<string>, ranked array<struct<k: string, rank: int, word: string>>"
    df = spark.createDataFrame(data, schema)
    flat = df.select("id", F.inline("ranked")).withColumnRenamed("k", "target")
    table = constraints.first_alternatives(flat)
    inside = df.withColumn("alts", constraints.alternatives_in_row(F.col("ranked")))
    nv = lambda d: d.withColumnRenamed("kws", "nv")
    for lists, shape in (
        (constraints.top_keyword_lists, lambda d: d), (constraints.entity_lists, lambda d: d), (constraints.word_class_lists, nv),
        (lambda r, a: constraints.word_class_lists(r, a, policy="both"), nv),
    ):
        got = lists(shape(inside), None)
        assert rows(got, "id") == rows(lists(shape(df), table), "id")
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_labels_are_not_dealt_by_label(spark):
    docs = spark.createDataFrame([(i, "negative") for i in range(5)], "id int, label string")
    out = labels.map_labels(docs, "label", labels.label_table(spark).filter(F.col("dataset") == "sst2"))
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
    assert rows(out, "id") == [(i, 0, "negative") for i in range(5)]


# ---- neighbours, exemplars, sampling ----------------------------------------------------------
def test_pruned_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    v = centres[rng.integers(0, 6, 240)] + 0.1 * rng.normal(size=(240, 8))
    v[10] = v[20] = v[30]  # equal similarities
    lab = ["hot" if i % 3 else "rare" for i in range(239)] + ["alone"]
    df = spark.createDataFrame([(i, [float(x) for x in v[i]], lab[i]) for i in range(240)], "id bigint, v array<double>, label string")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = np.round(u @ u.T, 10)
    for scope in ("same", "other", "any"):
        got = {(r["id"], r["rank"]): r["peer"] for r in neighbours.nearest_rows(df, "id", "v", "label", scope, block_rows=25, max_pivots=8).collect()}
        want = {}
        for i in range(240):
            ok = [j for j in range(240) if j != i and (scope == "any" or (lab[i] == lab[j]) == (scope == "same"))]
            for rank, j in enumerate(sorted(ok, key=lambda j: (-sims[i, j], j))[:2], 1):
                want[(i, rank)] = j
        assert got == want, scope


def test_rows_travel_once_per_tile_and_equal_brute_force(spark, monkeypatch):
    # without structure no block can be ruled out; small blocks must not mean a copy of a row per block
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 12))
    v[7] = v[8] = v[290]
    lab = ["hot" if i % 4 else f"l{i % 3}" for i in range(300)]
    df = spark.createDataFrame([(i, [float(x) for x in v[i]], lab[i]) for i in range(300)], "id bigint, v array<double>, label string")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = np.round(u @ u.T, 10)
    sent = []

    def tile_pass(queries, points, *rest, inner=neighbours._tile_pass):
        sent.append((queries.count(), points.count()))
        return inner(queries, points, *rest)

    monkeypatch.setattr(neighbours, "_tile_pass", tile_pass)
    for scope in ("same", "other", "any"):
        found = neighbours.nearest_rows(df, "id", "v", "label", scope, k=3, block_rows=4, tile_rows=100).collect()
        got = {(r["id"], r["rank"]): (r["peer"], r["sim"]) for r in found}
        for i in range(300):
            ok = [j for j in range(300) if j != i and (scope == "any" or (lab[i] == lab[j]) == (scope == "same"))]
            for rank, j in enumerate(sorted(ok, key=lambda j: (-sims[i, j], j))[:3], 1):
                assert got.pop((i, rank)) == (j, sims[i, j]), (scope, i, rank)
        assert not got
    assert all(q <= 300 * 4 and p <= 300 * 4 for q, p in sent), sent


def test_lone_rows_fall_back(spark):
    df = spark.createDataFrame([(1,), (2,)], "id bigint")
    near = spark.createDataFrame([(1, 1, 9)], "id bigint, rank int, peer bigint")
    assert rows(neighbours.with_fallback(df, "id", near), "id") == [(1, 9, 9), (2, 2, 2)]


def test_exemplars_hold_only_other_texts_of_the_label(spark):
    data = [(i, f"t{i % 40}", "x") for i in range(200)] + [(300 + i, "same", "y") for i in range(5)] + [(400, "solo", "z"), (401, "p", "w"), (402, "q", "w"), (403, "q", "w")]
    df = spark.createDataFrame(data, "id int, text string, label string")
    got = {r["id"]: r["exemplars"] for r in exemplars.random_exemplars(df, "label", "text").collect()}
    again = {r["id"]: r["exemplars"] for r in exemplars.random_exemplars(df.repartition(7), "label", "text").collect()}
    assert got == again and len(got) == len(data)
    for i, text, _ in data[:200]:
        three = got[i].split(",")
        assert len(three) == 3 and f'"{text}"' not in three
    assert got[300] == "" and got[400] == "" and got[402] == '"p"'
    assert got[401] == '"q","q"'  # a repeated text counts as often as it occurs


def test_exemplars_are_drawn_from_all_rows(spark):
    data = [(i, "copy" if i < 900 else f"t{i}", "x") for i in range(1000)]
    df = spark.createDataFrame(data, "id int, text string, label string")
    picks = [e for r in exemplars.random_exemplars(df, "label", "text").filter("id >= 900").collect() for e in r["exemplars"].split(",")]
    assert len(picks) == 300 and 0.8 < sum(p == '"copy"' for p in picks) / 300 < 0.98


def test_numbering_in_buckets(spark):
    data = [(i * 7 % 1000, "a" if i % 3 else "b") for i in range(1000)]
    df = spark.createDataFrame(data, "id bigint, label string")
    out = sampling.numbered(df, ["label"], "id", sampling.id_bucket("id", 50))
    for label in "ab":
        want = sorted(i for i, x in data if x == label)
        assert [r["id"] for r in out.filter(F.col("label") == label).orderBy("rn").collect()] == want


# ---- mining -------------------------------------------------------------------------------------
# Known values: MI and majority share of features with these class counts, totals 5419 / 5418.
GOLDEN = json.loads((pathlib.Path(__file__).parent / "known_values.json").read_text())


def test_information_of_known_counts(spark):
    counts = spark.createDataFrame(
        [(str(i), y, g["counts"][y]) for i, g in enumerate(GOLDEN) for y in (0, 1) if g["counts"][y]],
        "feature string, y int, c bigint",
    )
    totals = spark.createDataFrame([(0, 5419), (1, 5418)], "y int, n_y bigint")
    got = {int(r["feature"]): r for r in mining.mutual_information(counts, totals).collect()}
    for i, g in enumerate(GOLDEN):
        if sum(g["counts"]):
            assert math.isclose(got[i]["mi"], g["mi"], abs_tol=1e-12)
            assert math.isclose(got[i]["pct_majority"], g["pct"], abs_tol=1e-12)


def test_empty_groups_stay(spark):
    docs = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc int, y int")
    feats = spark.createDataFrame([(1, 0, "ka"), (2, 1, "kb"), (3, 1, "kb")], "doc int, y int, feature string")
    table = mining.feature_mi(feats.filter("feature = 'kb'"), docs)
    groups, _ = mining.merge_by_majority(feats, docs, table, F.substring("feature", 1, 1), [0, 1])
    assert [(r["cls"], r["count"]) for r in groups.orderBy("cls").collect()] == [(0, 0), (1, 2)]


def test_greedy_merge_by_hand(spark):
    # a1 and a2 mark class 1 in different documents, a3 marks class 0, b1 is alone in its key
    docs = [(d, int(d < 20)) for d in range(40)]
    has = {"a1": range(0, 10), "a2": range(10, 20), "a3": range(20, 28), "b1": range(5, 9)}
    feats = [(d, int(d < 20), f) for f, ds in has.items() for d in ds]
    dd = spark.createDataFrame(docs, "doc int, y int")
    ff = spark.createDataFrame(feats, "doc int, y int, feature string")
    table = mining.feature_mi(ff, dd).withColumn("key", F.substring("feature", 1, 1))
    got = {}
    for r in greedy.merge_greedily(ff, dd, table, 10).collect():
        got.setdefault((r["key"], r["grp"]), set()).add(r["feature"])
    # a3 would blur the group of class 1, so it opens its own
    assert got == {("a", 0): {"a1", "a2"}, ("a", 1): {"a3"}, ("b", 0): {"b1"}}


def test_greedy_merge_places_every_feature_once(spark):
    rng = random.Random(11)
    docs = [(d, d % 2) for d in range(60)]
    feats = [(d, y, f"{k}{j}") for d, y in docs for k in "pq" for j in range(5) if rng.random() < (0.5 if (y + j) % 2 else 0.2)]
    dd = spark.createDataFrame(docs, "doc int, y int")
    ff = spark.createDataFrame(feats, "doc int, y int, feature string")
    table = mining.feature_mi(ff, dd).withColumn("key", F.substring("feature", 1, 1))
    got = greedy.merge_greedily(ff, dd, table, 10)
    names = [r["feature"] for r in got.collect()]
    assert sorted(names) == sorted({f for _, _, f in feats}) and got.filter(F.substring("feature", 1, 1) != F.col("key")).count() == 0
    # the information kept with a group is that of documents with any member
    groups = ff.join(got.select("feature", F.concat_ws("-", "key", "grp").alias("g")), "feature").select("doc", "y", F.col("g").alias("feature")).distinct()
    want = {r["feature"]: round(r["mi"], 9) for r in mining.feature_mi(groups, dd).collect()}
    assert {f"{r['key']}-{r['grp']}": round(r["mi"], 9) for r in got.collect()} == want


def merged_by_loop(docs, feats, order):
    def info(having):
        t, out = len(docs) + 2 * len(classes), 0.0
        cells = [(1 + sum(ys[d] == y and (d in having) == z for d in ys), y, z) for y in classes for z in (True, False)]
        for c, y, z in cells:
            p_y, p_z = (sum(x for x, *at in cells if at[i] == v) / t for i, v in ((0, y), (1, z)))
            out += c / t * math.log(c / t / (p_y * p_z))
        return out

    ys = dict(docs)
    classes, has, keys = sorted(set(ys.values())), {}, {}
    for d, _, f in feats:
        has.setdefault(f, set()).add(d)
    for f in order:
        groups = keys.setdefault(f[0], [(set(), set(), 0.0)])
        offers = []
        for members, having, old in groups:
            new = info(having | has[f])
            offers.append(0.0 if abs(new - old) < 1e-12 else math.copysign(new, new - old))
        best = max(range(len(groups)), key=lambda g: (round(offers[g], 12), -g))
        if offers[best] < 0:
            groups.append((set(), set(), 0.0))
            best = len(groups) - 1
        members, having, _ = groups[best]
        groups[best] = (members | {f}, having | has[f], info(having | has[f]))
    return {(k, frozenset(m)) for k, groups in keys.items() for m, _, _ in groups if m}


def test_greedy_merge_against_brute_force_in_rounds(spark, monkeypatch):
    rng = random.Random(5)
    docs = [(d, d % 3) for d in range(90)]
    names = [f"{k}{j}" for k in "pq" for j in range(12)]
    lean = {f: [rng.choice([0.02, 0.1, 0.4]) for _ in range(3)] for f in names}
    feats = [(d, y, f) for d, y in docs for f in names if rng.random() < lean[f][y]]
    dd = spark.createDataFrame(docs, "doc int, y int")
    ff = spark.createDataFrame(feats, "doc int, y int, feature string")
    table = mining.feature_mi(ff, dd).withColumn("mi", F.round("mi", 8)).withColumn("key", F.substring("feature", 1, 1))
    order = [r["feature"] for r in table.orderBy(F.desc("mi"), "feature").collect()]
    want = merged_by_loop(docs, feats, order)
    assert max(sum(k == key for k, _ in want) for key in "pq") > 1
    for postings in (1 << 20, 60):  # in one round, and in many with hot features alone
        monkeypatch.setattr(greedy, "POSTINGS", postings)
        got = {}
        for r in greedy.merge_greedily(ff, dd, table).collect():
            got.setdefault((r["key"], r["grp"]), set()).add(r["feature"])
        assert {(k, frozenset(m)) for (k, _), m in got.items()} == want


def test_greedy_query_merges_the_whole_vocabulary(spark):
    from quillspark.plans import catalog
    from quillspark.plans.feature_queries import TOP_K, labelled, word_feats

    folder = "/root/testdata/sf0.001"
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    tables = type("Tables", (), {"labels": read("labels"), "documents": read("documents")})
    words = word_feats(labelled(tables).filter("split = 'train'")).select("feature").distinct().count()
    got = catalog.QUERIES["f9_greedy_groups"](spark, folder).select("feature")
    assert 40 < words <= TOP_K and got.count() == got.distinct().count() == words


# ---- trees ------------------------------------------------------------------------------------------
# fixed value: the documented example of a synchronous tree
PAIR_TREE = "(9 (1 (14 (82 a/a) (32 dog/cat)) (31 (61 is/is) (19 (50 playing/) (2 (16 (75 in/) (94 the/)) (47 park/outside))))) (67 ./.))"


def test_pair_tree(spark):
    df = spark.createDataFrame([(1, PAIR_TREE)], "doc int, tree string")
    nodes = {r["pos"]: r for r in trees.tree_rows(df, "tree", paired=True).collect()}
    spans = [nodes[i]["span"] for i in range(len(nodes))]
    assert spans[:3] == ["a/a", "dog/cat", "a dog/a cat"]
    assert spans[4] == "playing/ϵ" and spans[-1] == "a dog is playing in the park ./a cat is outside ."
    top = nodes[len(nodes) - 1]
    assert top["root"] == "9" and top["depth"] == 7 and top["production"] == "(1, 67)"


def test_tree_shapes(spark):
    texts = ["(S (A x_) (B y))", "(S x", "(S x) y", "", "()", "(S (A))", "word", None, "(S x y z)"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc int, tree string")
    out = trees.tree_rows(df, "tree").collect()
    got = {}
    for r in out:
        got.setdefault(r["doc"], []).append((r["template"], r["span"], r["production"]))
    assert got == {
        0: [("(A *)", "x", "('x_',)"), ("(B *)", "y", "('y',)"), ("(S (A *) (B *))", "x y", "(A, B)")],
        8: [("(S * * *)", "x y z", "('x', 'y', 'z')")],
    }


def test_tree_fields(spark):
    """Fields that are not named are not made; the others are as in a whole reading."""
    df = spark.createDataFrame([(1, PAIR_TREE), (2, "(S (A a_ _ b) (B (C c)))"), (3, "(S x")], "doc int, tree string")
    for paired in (True, False):
        whole = trees.tree_rows(df.filter(f"doc = 1 or {not paired}"), "tree", paired)
        for fields in (["root", "production"], ["span", "depth", "pos"], ["flat", "children", "subtree"], ["template"]):
            some = trees.tree_rows(df.filter(f"doc = 1 or {not paired}"), "tree", paired, fields=fields)
            assert some.columns == ["doc", *fields]
            assert sorted(some.collect()) == sorted(whole.select("doc", *fields).collect())
    flat = {(r["doc"], r["flat"]) for r in whole.filter("children > 1").collect()}
    assert (2, "(S (A a_ _ b) (B c))") in flat


# ---- substitutes --------------------------------------------------------------------------------------
def test_candidates_held_in_the_row(spark):
    """The same candidates stay as from rows, and they are not shuffled."""
    rng = random.Random(8)
    words = ["good", "Good", "GOOD", "ßa", "Ssa", "SSA", "the", "The", "!", ",", "bad", "Bad", "only", "Only", "", None]
    rows = [(i, t, [(rng.randint(0, 1), rng.choice(words)) if rng.random() < 0.9 else None for _ in range(rng.randint(0, 9))]) for i in range(40) for t in "ab"]
    df = spark.createDataFrame(rows, "id int, target string, cands array<struct<iter: int, word: string>>")
    stop = spark.createDataFrame([("the",)], "word string")
    ants = spark.createDataFrame([("a", "bad"), ("b", "good"), ("b", "only"), ("c", "only")], "target string, antonym string")
    flat = df.select("id", "target", F.explode("cands").alias("c")).filter("c is not null").select("id", "target", "c.*")
    want = lexsub.filter_candidates(flat, stop, ants).select("id", "target", "iter", "word").collect()
    out = lexsub.filter_held(df, F.col("cands"), stop, ants).select("id", "target", "iter", "word")
    assert want and sorted(map(str, out.collect())) == sorted(map(str, want))
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_candidates_by_shape(spark):
    """Shapes give what rows of candidates give; no function runs per candidate, and keys of draws are not dealt."""
    words = ["good", "Good", "GOOD", "ßa", "Ssa", "the", "The", "!", "bad", "漢", "only", "Only", "", None]
    rng = random.Random(9)
    data = [(i, t, rng.choice(words), rng.choice(words), rng.randint(0, 7)) for i in range(60) for t in "abc"] + [(None, None, "bad", "Bad", 7)]
    df = spark.createDataFrame(data, "id int, target string, u string, v string, m int")
    stop = spark.createDataFrame([("the",)], "word string")
    ants = spark.createDataFrame([("a", "bad"), ("b", "good"), ("b", "only"), ("d", "only"), ("a", None)], "target string, antonym string")
    shapes = [F.col("u"), F.col("v"), lexsub.capitalised(F.col("u")), F.lower("v")]
    there = lambda i, s: (F.col("m").bitwiseAND(F.shiftleft(F.lit(1), 1) + i + s) > 0, [(F.col("m") + i * 10 + s).alias("x")])
    held = [F.when(there(F.lit(i), F.lit(s))[0] & w.isNotNull(), F.struct(F.lit(i).alias("iter"), w.alias("word"), there(F.lit(i), F.lit(s))[1][0])) for i in (0, 1) for s, w in enumerate(shapes)]
    flat = df.select("id", "target", F.explode(F.array(*held)).alias("c")).filter("c is not null").select("id", "target", "c.*")
    want = sorted(str(tuple(r)) for r in lexsub.filter_candidates(flat, stop, ants.dropna()).select("id", "target", "iter", "word", "x").collect())
    out = lexsub.filter_held(df, ((0, 1), shapes, there), stop, ants).select("id", "target", "iter", "word", "x")
    assert len(want) > 50 and sorted(str(tuple(r)) for r in out.collect()) == want
    docs = spark.createDataFrame([(1, "one two three"), (2, None)], "doc_id long, text string")
    plan = report_queries.kept_candidates(SimpleNamespace(documents=docs, spark=spark))._jdf.queryExecution().executedPlan().toString()
    above, rows = plan.split("SortMergeJoin")[0], plan.split("SortMergeJoin")[1].split("Scan")[0]
    assert "lambda" not in above and "concat_ws" in above and "concat_ws" not in rows


def test_an_antonym_is_looked_up_in_a_short_list(spark):
    """However many antonyms a target has, a word can be in one short list only."""
    words = [f"w{i}" for i in range(3000)]
    ants = spark.createDataFrame([("t", w) for w in words] + [("u", "w1"), ("u", "w1"), ("v", None)], "target string, antonym string")
    lists = {r["target"]: r["_barred"] for r in lexsub._barred(ants).collect()}
    assert len(lists["t"]) == 3000 and max(map(len, lists["t"])) < 20 and sorted(sum(lists["t"], [])) == sorted(words)
    asked = spark.createDataFrame([("t", "w7"), ("t", "x"), ("u", "w1"), ("u", "w2"), ("v", "w1"), ("none", "w1")], "target string, w string")
    got = asked.join(lexsub._barred(ants), "target", "left").select("target", "w", lexsub._is_barred(F.col("w")).alias("b")).collect()
    assert {(r["target"], r["w"]) for r in got if r["b"]} == {("t", "w7"), ("u", "w1")} and all(r["b"] is not None for r in got)


def test_original_probability_is_drawn_once_per_round(spark):
    """Its draw stands below the explode of the shapes, and its key is the one of single draws."""
    docs = spark.createDataFrame([(1, "one two"), (2, None), (None, "three")], "doc_id long, text string")
    out = report_queries.candidates(SimpleNamespace(documents=docs))
    above = out._jdf.queryExecution().optimizedPlan().toString().split("Generate explode")[0]
    assert "concat_ws(|, p, " in above and "concat_ws(|, o, " not in above
    direct = draw32("o", F.col("id"), F.col("target"), F.col("iter")) % 1000 / F.lit(1001.0)
    got = out.select("id", "target", "orig_prob", direct.alias("want")).collect()
    assert {r["target"] for r in got} == {"one", "two", "three"} and all(r["orig_prob"] == r["want"] for r in got)


def test_candidate_filter(spark):
    words = ["good", "Good", "GOOD", "123", "the", "!", "bad", "Only"]
    cand = spark.createDataFrame([(1, "fine", 0, w) for w in words], "id int, target string, iter int, word string")
    stop = spark.createDataFrame([("the",)], "word string")
    ants = spark.createDataFrame([("fine", "bad")], "target string, antonym string")
    assert sorted(r["word"] for r in lexsub.filter_candidates(cand, stop, ants).collect()) == ["Only", "good"]


def test_closure_ends_on_cycles_and_honours_depth(spark):
    edges = spark.createDataFrame([("h", "a", "b"), ("h", "b", "c"), ("h", "c", "a"), ("k", "c", "d")], "kind string, word string, related string")
    full = {tuple(r) for r in lexsub.closure(edges).select("kind", "word", "related").collect()}
    assert full == {("h", x, y) for x, y in itertools.product("abc", repeat=2)} | {("k", "c", "d")}
    two = {tuple(r) for r in lexsub.closure(edges, 1).select("kind", "word", "related").collect()}
    assert len(two) == 4


def test_mean_over_present_rounds(spark):
    cand = spark.createDataFrame([(1, "t", 0, "a", 1.0), (1, "t", 1, "a", 3.0), (1, "t", 0, "b", 2.5), (1, "t", 0, "t", 9.0)], "id int, target string, iter int, word string, score double")
    assert [(r["word"], r["score"]) for r in lexsub.mean_over_rounds(cand).orderBy("rank").collect()] == [("b", 2.5), ("a", 2.0)]


# ---- vocabulary, scores, edits ----------------------------------------------------------------------------
def test_vocabulary_matches_public_trainer(spark):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers, trainers

    texts = ["The cat sat. The cat ran!", "A cat, a dog; the end.", "Dog? dog! rare Élan élan elan"]
    special = ["[PAD]", "[CLS]", "[SEP]", "[UNK]"]
    tok = Tokenizer(models.WordLevel(unk_token="[UNK]"))
    tok.normalizer, tok.pre_tokenizer = normalizers.BertNormalizer(lowercase=True), pre_tokenizers.BertPreTokenizer()
    tok.train_from_iterator(texts, trainers.WordLevelTrainer(special_tokens=special, vocab_size=9, min_frequency=2, show_progress=False))
    df = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "doc int, text string")
    vocab = vocabulary.vocabulary(df, "text", size=9, min_frequency=2)
    assert {r["token"]: r["id"] for r in vocab.collect()} == tok.get_vocab()
    got = {r["doc"]: r["input_ids"][1:-1] for r in vocabulary.encode(df, "doc", "text", vocab).collect()}
    assert got == {i: tok.encode(s).ids for i, s in enumerate(texts)}


def test_encode_shuffles_no_word(spark):
    vocab = spark.createDataFrame([("a", 7), ("b", 9), ("[UNK]", 3)], "token string, id int")
    rows = [(i, t) for i, t in enumerate(["a b zz a", "", None, "zz", *["b " * 5000] * 30])]
    out = vocabulary.encode(spark.createDataFrame(rows, "doc int, text string").repartition(3), "doc", "text", vocab)
    assert str(out._jdf.queryExecution().executedPlan()).count("Exchange") == 1  # the test's own
    got = {r["doc"]: (r["input_ids"], r["tokens"]) for r in out.collect()}
    assert got[0] == ([1, 7, 9, 3, 7, 2], ["a", "b", "[UNK]", "a"])
    assert got[1] == got[2] == ([1, 2], []) and got[3] == ([1, 3, 2], ["[UNK]"])
    assert all(got[i] == ([1] + [9] * 5000 + [2], ["b"] * 5000) for i in range(4, 34))


def test_argmax_ties_and_collapse(spark):
    df = spark.createDataFrame([([-1.0, -1.0, -3.0], 1, 1.0)], "log_probs array<double>, label int, loss double")
    r = metrics.with_prediction(df).first()
    assert (r["predicted"], r["acc"], r["score"]) == (0, 0, -1.0)
    c = metrics.collapse_classes(df).first()
    assert c["predicted"] == 1 and math.isclose(c["loss"], -math.log(math.exp(-1) + math.exp(-3)))


def test_edit_error_rate_and_orphans(spark):
    orig = spark.createDataFrame([("1", 1, 1), ("2", 0, 0), ("3", 1, 1)], "uid string, predicted int, label int")
    ed = spark.createDataFrame([("1", 0, 0), ("1", 0, 1), ("2", 0, 0), ("3", 0, 1), ("x", 0, 0)], "original_uid string, grp int, predicted int")
    assert rows(edits.edit_error_rate(ed, orig, 0)) == [(2, 0.5, 0.25)]


def test_unknown_label_fails_when_strict(spark):
    import pytest

    table = spark.createDataFrame([("a", 0)], "label_name string, label int")
    df = spark.createDataFrame([("a",), ("b",)], "label string")
    loose = labels.map_labels(df, "label", table, strict=False)
    assert sorted((r["label_name"], r["label"]) for r in loose.collect()) == [("a", 0), ("b", None)]
    with pytest.raises(Exception, match="unknown label"):
        labels.map_labels(df, "label", table).collect()


def test_pair_attribution_splits_at_second_mark(spark):
    df = spark.createDataFrame([(["[CLS]", "a", "[CLS]", "b"], [1, 2, 3, 4])], "t array<string>, g array<int>")
    a, b = attribution.split_pair(F.col("g"), F.col("t"))
    assert rows(df.select(a, b)) == [([1, 2], [3, 4])]
