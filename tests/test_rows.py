"""Indexes inside a row, rejected rows, nested metric files and the count cube against plain Python."""

import json
import random

from pyspark.sql import functions as F

from quillspark.functions import rowindex
from quillspark.operators import labels, mining, rejects
from quillspark.sources import readers


def test_row_index(spark):
    data = [(0, ["b", "a", "b", None, "a", "c"]), (1, []), (2, None)]
    df = spark.createDataFrame(data, "id int, xs array<string>")
    entries = F.transform("xs", lambda x, i: F.struct(x.alias("k"), i.alias("p")))
    got = {r["id"]: r for r in df.select("id", rowindex.grouped(entries).alias("g"), rowindex.greatest(entries).alias("m")).collect()}
    assert {k: [e["p"] for e in v] for k, v in got[0]["g"].items()} == {"a": [1, 4], "b": [0, 2], "c": [5]}
    assert {k: v["p"] for k, v in got[0]["m"].items()} == {"a": 4, "b": 2, "c": 5}
    assert got[1]["g"] == {} and got[2]["g"] is None
    both = F.map_from_arrays(F.array(F.lit("a"), F.lit("z")), F.array(F.lit(7), F.lit(8)))
    met = rowindex.met(rowindex.grouped(entries), both, lambda es, n: F.coalesce(F.size(es), F.lit(0)) * 10 + F.coalesce(n, F.lit(0)))
    assert sorted(df.filter("id = 0").select(met.alias("m")).first()["m"]) == [8, 10, 20, 27]


def test_nested_numbers(spark):
    texts = ['{"a": {"acc": 0.5, "n": [1, 2, {"x": 3}]}, "b": 7, "t": "text", "no": null, "yes": true}', "5", "[]", "{}", "no json", None]
    df = spark.createDataFrame(list(enumerate(texts)), "key int, pos string")  # names that the reader uses inside
    got = sorted((r["key"], r["path"], r["value"]) for r in readers.leaves(df.withColumnRenamed("pos", "_text").withColumnRenamed("key", "id"), "_text")
                 .select(F.col("id").alias("key"), "path", "value").collect())
    assert got == [(0, "a.acc", 0.5), (0, "a.n.0", 1.0), (0, "a.n.1", 2.0), (0, "a.n.2.x", 3.0), (0, "b", 7.0), (1, "", 5.0)]
    deep = json.dumps({"l1": {"l2": {"l3": 1}}, "top": 2})
    one = spark.createDataFrame([(deep,)], "_text string")
    assert [(r["path"], r["value"]) for r in readers.leaves(one, "_text", depth=2).collect()] == [("top", 2.0)]


def test_rejects_keep_every_row(spark):
    rows = [(1, "yes"), (2, "no"), (3, None), (4, "maybe"), (4, "maybe")]
    table = spark.createDataFrame([("yes", 1), ("no", 0), ("no", 5)], "label_name string, label int")
    accepted, rejected = rejects.part_labels(spark.createDataFrame(rows, "id int, label string"), "label", table)
    assert sorted(tuple(r) for r in accepted.select("id", "label", "label_name").collect()) == [(1, 1, "yes"), (2, 0, "no")]
    assert sorted((r["id"], r["reason"]) for r in rejected.collect()) == [(3, "unknown label: null"), (4, "unknown label: maybe"), (4, "unknown label: maybe")]

    lists = [(1, "['a', \"b's\"]", "['O', 'B-X']"), (2, "['a'", "['O']"), (3, "['a']", "['O', 'O']"), (4, None, "[]"), (5, "[]", "[]"), (6, "['a']", "nothing")]
    accepted, rejected = rejects.part_tagged(spark.createDataFrame(lists, "id int, tokens string, ner_tags string"))
    assert {r["id"]: (r["tokens"], r["ner_tags"]) for r in accepted.collect()} == {1: (["a", "b's"], ["O", "B-X"]), 5: ([], [])}
    assert {r["id"]: r["reason"] for r in rejected.collect()} == {
        2: "tokens are no list of strings", 3: "1 tokens, 2 tags", 4: "tokens are no list of strings", 6: "tags are no list of strings"}
    assert {r["id"]: r["tokens"] for r in rejected.collect()}[2] == "['a'"


def test_glosses_are_rejected_by_tag(spark):
    rows = [(1, ["Ann"], ["B-PER"]), (2, ["x", "y", "z"], ["B-UNK", "", "B-UNK"]), (3, [], []), (4, ["q"], [None])]
    df = spark.createDataFrame(rows, "id int, p array<string>, t array<string>")
    accepted, rejected = rejects.part_glosses(df, "p", "t", "conll2003")
    assert {r["id"]: r["ner_labels"] for r in accepted.collect()} == {1: "Ann is person", 3: ""}
    assert {r["id"]: r["reason"] for r in rejected.collect()} == {2: "no gloss: , B-UNK", 4: "no gloss: null"}


def test_count_cube(spark):
    rng = random.Random(2)
    docs = [(i, rng.choice([0, 1, 2]), rng.choice(["train", "dev"]), [rng.choice("abcd") for _ in range(rng.randint(0, 5))]) for i in range(80)]
    df = spark.createDataFrame(docs, "doc int, y int, split string, xs array<string>")
    cube = mining.CountCube(df, F.col("xs"))
    for split in (None, "train", "dev"):
        some = [d for d in docs if split is None or d[2] == split]
        want = {(f, y): sum(f in d[3] and d[1] == y for d in some) for f in "abcd" for y in (0, 1, 2)}
        assert {(r["feature"], r["y"]): r["c"] for r in cube.counts(split).collect()} == {k: c for k, c in want.items() if c}
        assert {r["y"]: r["n_y"] for r in cube.totals(split).collect()} == {y: sum(d[1] == y for d in some) for y in (0, 1, 2)}
        part = df if split is None else df.filter(F.col("split") == split)
        feats = mining.features_of(part, "doc", F.col("xs"), ("y",))
        dense = {r["feature"]: round(r["mi"], 9) for r in mining.feature_mi(feats, part).collect()}
        assert {r["feature"]: round(r["mi"], 9) for r in cube.information(split).collect()} == dense


def test_both_policy_against_a_walk(spark):
    from quillspark.operators.constraints import _replaceable

    rng = random.Random(4)
    words = ["ab", "bc", "cd", "de"]
    for _ in range(300):
        kws = [rng.choice(words) for _ in range(rng.randint(0, 6))]
        alts = [rng.choice([None, *words, "zz"]) for _ in kws]
        heads = [rng.random() < 0.5 for _ in kws]
        now, want = list(kws), []
        for p, (alt, toss) in enumerate(zip(alts, heads, strict=True)):
            free = alt is not None and alt not in now
            want.append(free)
            if free and toss:
                now[p] = f"{now[p]} or {alt}"
        assert _replaceable(alts, heads, kws) == want
    assert labels.label_names("sst2")
