import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillspark.functions import text as tx
from quillspark.operators import constraints as cs
from quillspark.operators import generate as gen
from quillspark.operators import labels as lb
from quillspark.plans import augment, extractor
from quillspark.plans.join_queries import tag_rule, word_vector
from quillspark.plans.variant_queries import substitutes
from quillspark.sources import readers as rd
from quillspark.sources import texts
from quillspark.sources import writers as wr

SMALL = "/root/testdata/sf0.001"
CHECKED = [
    "t1_clean_text", "t15_answer_text", "j3_nearest_same_label", "j10_random_subset", "j12_entity_spans",
    "f5_word_mi", "m9_contrast",
]


@pytest.mark.parametrize("key", CHECKED)
def test_query_equals_sql(spark, key):
    con = duckdb.connect()
    for name in ("documents", "labels", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    df = entry.queries()[key](spark, SMALL)
    cur = con.execute(entry.oracle_sql()[key])
    names = [d[0] for d in cur.description]
    show = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    want = sorted(tuple(show(v) for v in r) for r in cur.fetchall())
    got = sorted(tuple(show(r[n]) for n in names) for r in df.collect())
    assert got == want


def test_sql_only_for_known_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def table(spark):
    data = [
        (0, "The quick fox jumps over lazy dogs in town.", "Sports"), (1, "Big teams play hard games every week.", "Sports"),
        (2, "Players run far and score goals.", "Sports"), (3, "Doctors say that sleep helps people.", "Health"),
    ]
    df = spark.createDataFrame(data, "row_id bigint, text string, label string")
    return df.withColumn("tokens", tx.words(F.col("text"))).withColumn("ner_tags", tag_rule(F.col("tokens")))


def test_classification_flow(spark):
    df = table(spark)
    words = df.select(F.explode(tx.tokens(F.col("text"))).alias("word")).distinct()
    out = extractor.extract(
        df, "concepts", "yahoo",
        word_vectors=words.select("word", word_vector(F.col("word"), "w").alias("wv")),
        label_vectors=df.select("label").distinct().select("label", word_vector(F.col("label"), "l").alias("lv")),
        sentence_vectors=df.select("row_id", word_vector(F.col("text"), "s").alias("v")),
    )
    r = {x["row_id"]: x for x in out.collect()}
    assert len(r) == 4 and r[3]["mix_const_1"] == r[3]["final_const"]  # no peer: the row itself
    assert r[0]["min_words"] == 9 and "$abs$" in r[0]["mix_const_1"]
    yahoo = lb.label_table(spark).filter("dataset = 'yahoo'")
    parts = augment.classification(out, gen.echo_generator, yahoo).groupBy("part").count().collect()
    assert {p["part"]: p["count"] for p in parts} == {"original": 4, "solo": 12, "mix_1": 4, "mix_2": 4}


def test_substitutes_by_a_rule(spark):
    """A rule asked in the row gives what a table of the same substitutes gives."""
    df = table(spark)
    words = df.select(F.col("row_id").alias("id"), F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("target"))
    pairs = words.filter("char_length(target) > 2").select("id", "target", F.explode(F.array(F.lit(0), F.lit(1))).alias("rank"))
    ranked = pairs.withColumn("word", F.expr("if(rank = 0, left(target, length(target) - 1), 'zz')"))
    options = {
        "word_vectors": words.select(F.col("target").alias("word"), word_vector(F.col("target"), "w").alias("wv")).distinct(),
        "label_vectors": df.select("label").distinct().select("label", word_vector(F.col("label"), "l").alias("lv")),
        "sentence_vectors": df.select("row_id", word_vector(F.col("text"), "s").alias("v")),
    }
    shown = ["row_id", "inc_kws", "exc_kws", "final_const", "mix_const_1", "mix_const_2"]
    for name in ("concepts", "ner", "cross"):
        by_table, by_rule = (
            extractor.extract(df, name, "yahoo", alts=alts, glosses="conll2003", **options).select(*shown)
            for alts in (cs.first_alternatives(ranked), substitutes)
        )
        got = sorted(by_rule.collect())
        assert got == sorted(by_table.collect()) and any(" or " in r["inc_kws"] for r in got)


def test_prompts_are_written_after_the_last_shuffle(spark):
    """Finished prompts of a row are not dealt out; what it lends to others is."""
    df = table(spark)
    words = df.select(F.explode(tx.tokens(F.col("text"))).alias("word")).distinct()
    out = extractor.extract(
        df, "cross", "yahoo", alts=substitutes,
        word_vectors=words.select("word", word_vector(F.col("word"), "w").alias("wv")),
        label_vectors=df.select("label").distinct().select("label", word_vector(F.col("label"), "l").alias("lv")),
        sentence_vectors=df.select("row_id", word_vector(F.col("text"), "s").alias("v")),
    )
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join"):]
    assert "final_topic_const" not in below and "final_const" not in below and "mix_const_1" not in below


def test_entity_flow(spark):
    out = extractor.extract(table(spark), "ner", "conll2003").cache()
    one = out.filter("row_id = 0").first()
    # a run without B- has an empty tag, for which there is no gloss
    assert one["ner_phrases"] == ["The", "over"] and one["ner_labels"] == "The is person, over is ?"
    assert "The" in one["inc_kws"].split(",")
    painted, missing = augment.entity_tagging(out, lambda ts: ["say: the end, The fox" for _ in ts], 2)
    got = {tuple(r["id"]): r for r in painted.collect()}
    assert len(got) == 8
    assert got[(0, 1)]["tags"] == ["B-PER", "O", "O", "B-PER", "O"]


def test_question_and_pair_variants(spark):
    qa_rows = spark.createDataFrame(
        [(1, "First thing. It was in Rome then. Last", "x", "Where?", "Rome"), (2, "Nothing here", "x", "Who?", "Bob")],
        "row_id bigint, text string, label string, question string, answer string",
    )
    got = {r["row_id"]: r for r in extractor.extract(qa_rows, "qa").collect()}
    assert got[1]["inc_kws"].endswith('" It was in Rome then"') and "anwer the question: Where?" in got[1]["final_topic_const"]
    assert got[2]["inc_kws"] == "" and "keywords" not in got[2]["final_topic_const"]
    lists = "nouns{k} array<string>, verbs{k} array<string>, others{k} array<string>, pos_seq{k} string"
    schema = "row_id bigint, text1 string, text2 string, label string, " + lists.format(k=1) + ", " + lists.format(k=2)
    pairs = spark.createDataFrame(
        [(1, "A dog runs.", "A cat sits.", "not_equivalent", ["dog"], ["runs"], [], "DET NOUN VERB", ["cat"], ["sits"], [], "DET NOUN VERB")], schema
    )
    r = extractor.extract_pairs(pairs, {}).first()
    assert "should not be semantically similar to the sentence: A cat sits." in r["final_const1"]
    assert "similar to the sentence: A dog runs." in r["final_topic_const2"]
    assert r["inc_kws1"] in ("dog", "runs")


def test_files(spark, tmp_path):
    conll = tmp_path / "x.conll"
    conll.write_text("# id 1 domain=x\nIn\tO\nRome\tB-LOC\n\nHi\tO\n")
    got = [(r["tokens"], r["ner_tags"]) for r in rd.read_conll(spark, str(conll)).orderBy("row_id").collect()]
    assert got == [(["In", "Rome"], ["O", "B-LOC"]), (["Hi"], ["O"])]
    tsv = tmp_path / "x.tsv"
    tsv.write_text('0\t1\n"a ""q"" b"\tx\nc\ty\n')
    assert [(r["text"], r["label"]) for r in rd.read_labelled(spark, str(tsv)).orderBy("row_id").collect()] == [('a "q" b', "x"), ("c", "y")]
    assert rd.read_labelled(spark, str(tsv), debug=1).count() == 1
    pairs = tmp_path / "p.tsv"
    pairs.write_text("sentence1\tsentence2\tlabel\treview_id\na\tb\t1\tr9\n")
    p = rd.read_pairs(spark, str(pairs)).first()
    assert (p["text1"], p["uid"], p["details"]) == ("a", "0", {"original_uid": "r9"})
    both = rd.read_splits(spark, {"train": str(pairs), "test": str(tmp_path / "none.tsv")})
    assert both.count() == 1
    records = tmp_path / "r.json"
    records.write_text('[{"instruction": "i", "input": "", "output": "7"}, {"instruction": "j", "input": "in", "output": "o"}]')
    labels = gen.instructions(rd.read_instructions(spark, str(records), "array")).orderBy("prompt").collect()
    assert [r["label"] for r in labels] == ["7", "in"]
    run = tmp_path / "base" / "s7"
    run.mkdir(parents=True)
    (run / "metrics.json").write_text('{"acc": 0.5}')
    m = rd.read_metrics(spark, str(tmp_path / "base" / "s*" / "metrics.json"), "acc double").first()
    assert (m["method"], m["seed"], m["acc"]) == ("base", 7, 0.5)
    examples = tmp_path / "e.json"
    examples.write_text('[{"text": "<br />x", "label": "0"}, {"text": "  "}, {"uid": "u", "text": "y<br />"}]')
    from quillspark.operators.examples import tidy_examples

    e = tidy_examples(rd.read_examples(spark, str(examples), "array"), "row_id").orderBy("text").collect()
    assert [(r["uid"], r["text"]) for r in e] == [("0", "x"), ("u", "y<br />")]
    wr.write_by_label(spark.createDataFrame([("a", "x")], "f string, label string"), "label", str(tmp_path / "out"))
    assert (tmp_path / "out" / "label=x").is_dir()


def test_variants_offer_and_exclude_substitutes(spark):
    from pyspark.sql import functions as F

    from quillspark.plans import catalog

    for name in ("v_concepts", "v_ner"):
        out = catalog.QUERIES[name](spark, "/root/testdata/sf0.001").select("inc_kws", "exc_kws", "final_const")
        got = out.agg(
            F.count_if(F.col("exc_kws") != "").alias("excluded"), F.count_if(F.col("inc_kws").contains(" or ")).alias("offered"),
            F.count_if(F.col("inc_kws").rlike("(^|,)(the|and|der|la)(,|$)")).alias("stop"),
        ).first()
        assert got.excluded > 50 and got.offered > 50
        assert name == "v_ner" or got.stop == 0  # an entity's phrase may be a stop word


def test_conll_sentences_over_splits(spark, tmp_path):
    """Sentences that straddle one or many splits, blank lines of white space at the cuts and CRLF."""
    rng, folder = random.Random(5), tmp_path / "conll"
    folder.mkdir()
    want = []
    for name, blanks, end in (("a", ["", " \t"], "\n"), ("b", ["", "\u2003"], "\r\n"), ("c", [""], "\n")):
        lines = []
        for n in [0, 3, 1, 60, 2, *(rng.randint(1, 9) for _ in range(40))]:
            rows = [f"w{rng.randint(0, 99)}\tO" for _ in range(n)]
            want.append(tuple(r.split("\t")[0] for r in rows))
            lines += rows + [rng.choice(blanks) for _ in range(rng.randint(1, 3))]
        (folder / name).write_bytes(end.join(lines).encode())
    want = [w for w in want if w]
    for size in (16, 40, 64, 1 << 20):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        try:
            out = rd.read_conll(spark, str(folder))
            got = out.collect()
            plan = out._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert sorted(tuple(r["tokens"]) for r in got) == sorted(want)
        assert len({r["row_id"] for r in got}) == len(got)
        assert "Exchange rangepartitioning" not in plan


def test_texts_by_reference(spark):
    """Short and long texts come back, in the order of the entries; without a folder that Python can open likewise."""
    said = {i: "é" * i + f"{i}" for i in (0, 1, 5, 3000)} | {7: "".join(chr(33 + (i * i * 31 + i // 7) % 900) for i in range(9000)), 8: None}
    df = spark.createDataFrame([(i, t) for i, t in said.items()], "id int, text string").repartition(3)
    got = []
    for local in (True, False):
        store = texts.Texts(spark, "texts")
        if not local:
            store.folder = None
        held = {r["id"]: r["ref"] for r in store.put(df, "text", "ref").collect()}
        assert held[8] is None and (not local or all(isinstance(x, int) for i, x in held.items() if i != 8))
        rows = [
            (0, [(2, held[7]), (0, held[3000]), (1, held[0])], [[(0, held[1])], [], None]), (1, [], []), (2, None, None),
            (3, [(0, held[5]), (0, held[1])], [[(1, held[1]), (0, held[7])]]),
        ]
        entry_type = f"array<struct<_pos: int, _text: {'bigint' if local else 'string'}>>"
        shown = store.joined(spark.createDataFrame(rows * 70, f"id int, one {entry_type}, more array<{entry_type}>"), "one", "more")
        got.append({r["id"]: (r["one"], r["more"]) for r in shown.collect()})
        q = lambda *ids: ",".join(f'"{said[i]}"' for i in ids)
        assert got[-1] == {0: (q(3000, 0, 7), [q(1), "", None]), 1: ("", []), 2: (None, None), 3: (q(1, 5), [q(7, 1)])}


@pytest.mark.parametrize("name", ["exemplars_plain", "cross", "ner"])
def test_shown_texts_are_not_dealt(spark, name):
    """Exchanges of a variant that shows exemplars carry at most one text: the row's own."""
    out = entry.queries()[f"v_{name}"](spark, SMALL)
    plan = out._jdf.queryExecution().executedPlan().toString()
    below = plan.split("MapInArrow")[1]
    assert "Exchange" in below and "Exchange" not in plan.split("MapInArrow")[0]
    assert sum(x.count("text#") for x in below.splitlines() if "FileScan" in x) <= 2  # its output and its location's one scan
    first = out.filter("length(exemplars) > 0").first()
    assert first["exemplars"] in first["final_const" if name != "cross" else "final_topic_const"]


def test_a_repeated_id_lends_its_greatest_prompt(spark):
    """As when whole prompts were lent: two rows of one id, of which the greater prompt counts."""
    df = table(spark)
    df = df.unionByName(df.filter("row_id = 1").withColumn("text", F.lit("Zebras win the cup, zebras lose the cup.")))
    vectors = df.groupBy("row_id").agg(F.max("text").alias("t")).select("row_id", word_vector(F.col("t"), "s").alias("v"))
    out = extractor.extract(df, "ner", "conll2003", sentence_vectors=vectors).collect()
    prompts = {}
    for r in out:
        prompts[r["row_id"]] = max(prompts.get(r["row_id"], ""), r["final_const"])
    assert len(out) > len(prompts) == 4
    for r in out:
        assert [r["mix_const_1"], r["mix_const_2"]] == [prompts[r["mix_const_idx_1"]], prompts[r["mix_const_idx_2"]]]
