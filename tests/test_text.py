from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators import prompts as pr
from quillspark.operators import qa


def values(spark, texts, col):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, text string")
    return [r[0] for r in df.orderBy("i").select(col).collect()]


def test_clean_keeps_brackets_and_drops_symbols(spark):
    got = values(spark, ["It's (a) [b] #1\n\tx  y\u00a0z é", "a   b"], tx.clean(F.col("text")))
    # the odd range A-z keeps square brackets; double blanks shrink once
    assert got == ["It a [b] 1 x y\u00a0z ", "a  b"]


def test_answer_part_cases(spark):
    cases = ["no colon", "a: b", "a: b: c", "a:\n\n  \n\nsecond\n\nthird", "a: \n\n ", ""]
    assert values(spark, cases, tx.answer_part(F.col("text"), True)) == [None, " b", " b", "second", None, None]
    assert values(spark, cases, tx.answer_part(F.col("text"), False)) == ["no colon", " b", " b", "second", None, None]


def test_literal_lists_are_parsed_not_evaluated(spark):
    got = values(spark, ["['a', \"it's\", 'x']", "['\\'', 'b']"], tx.literal_list(F.col("text")))
    assert got == [["a", "it's", "x"], ["'", "b"]]


def test_length_bands(spark):
    n = F.size(tx.words(F.col("text")))
    texts = ["", "one two three", " ".join("w" * 21)]
    assert values(spark, texts, tx.min_words(n)) == [5, 5, 21]
    assert values(spark, texts, tx.min_words(n, True)) == [5, 5, 10]
    assert values(spark, texts, tx.max_words(n)) == [10, 10, 31]


def test_content_tokens(spark):
    stop = F.array(F.lit("the"))
    got = values(spark, ["the dog's dog 's a '' dog bark"], tx.content_tokens(tx.tokens(F.col("text")), stop))
    assert got == [["dog", "bark"]]


def test_ngrams_shorter_than_n(spark):
    got = values(spark, ["a b c", "a", ""], F.transform(tx.ngrams_upto(tx.words(F.col("text")), 2), lambda g: F.array_join(g, " ")))
    assert got == [["a", "b", "c", "a b", "b c"], ["a"], []]


def test_vocabulary_tokens_match_public_tokenizer(spark):
    from tokenizers import normalizers, pre_tokenizers

    texts = ["Élan vital, naïve-ish!", "C++ costs $5 (ça va?)", "plain words_here"]
    norm, pre = normalizers.BertNormalizer(lowercase=True), pre_tokenizers.BertPreTokenizer()
    want = [[w for w, _ in pre.pre_tokenize_str(norm.normalize_str(s))] for s in texts]
    assert values(spark, texts, tx.vocabulary_tokens(F.col("text"))) == want


def test_answer_sentence_quotes_the_answer(spark):
    df = spark.createDataFrame(
        [("One. It cost $5 (net) then. Two", "$5 (net)"), ("a*b? c+d!", "c+d"), ("none here", "zzz"), (r"x \E y. z", r"\E")],
        "c string, a string",
    )
    got = [r[0] for r in df.select(qa.answer_sentence(F.col("c"), F.col("a"))).collect()]
    assert got == [" It cost $5 (net) then", " c+d", None, r"x \E y"]


def test_slots_are_filled_once(spark):
    col = pr.fill("a {x} b {y} $abs$", {"x": F.col("text"), "y": F.lit("{x}")})
    assert values(spark, ["{y}"], col) == ["a {y} b {x} $abs$"]


def test_template_quirks():
    assert pr.FAMILIES["pos"].text("none", "solo").splitlines()[-1].startswith("2. ")
    assert "documentshould" in pr.FAMILIES["ner_exemplars_pos"].text("both", "abs")
    assert pr.FAMILIES["ner"].text("none", "solo").splitlines()[1] == "1. {ner_labels}. "


def test_concept_numbers(spark):
    start = pr.concept_start("exemplars_pos", "solo", F.lit("a"), F.lit("b"))
    compat = pr.concept_start("exemplars_pos", "solo", F.lit("a"), F.lit("b"), (4, 3, 1))
    # four items: the next number is 5; upstream repeats 4
    assert values(spark, ["x"], start) == [5] and values(spark, ["x"], compat) == [4]
    lines = pr.append_concepts(F.col("text"), F.array(F.lit("p"), F.lit("q")), start)
    assert values(spark, ["x"], lines) == ["x\n5. p\n6. q"]


def test_clean_keeps_the_same_characters(spark):
    # every code point of the basic plane and one beyond, against the one class that states the rule
    points = [c for c in range(0x10000) if not 0xD800 <= c < 0xE000] + [0x1F600]
    texts = ["a" + chr(c) + "b" for c in points] + ["", "ä ö#x", "\u3000\u00e9\U0001F600z"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, s string")
    assert "[^" + tx.KEPT not in str(tx.clean(F.col("s")))
    rule = df.select("s", F.regexp_replace("s", f"[^{tx.KEPT}{tx.SPACE}]", "").alias("want"), F.regexp_replace(F.regexp_replace("s", f"[{tx.DROPPED}]", ""), tx.BEYOND, "").alias("got"))
    assert rule.filter("want <> got").count() == 0


def test_counted_ngrams(spark):
    """Grams of every length are counted as strings; no array is made for one."""
    df = spark.createDataFrame([(["a", "b", "a", "b"],), (["a"],), ([],), (None,), (["a", "b", "a"],)], "ws array<string>")
    out = tx.counted_ngrams(df, "ws", 3)
    assert {r["gram"]: r["n"] for r in out.collect()} == {"a": 5, "b": 3, "a b": 3, "b a": 2, "a b a": 2, "b a b": 1}
    plan = tx.counted_ngrams(spark.createDataFrame([("x  y",)], "text string").select(tx.words(F.col("text")).alias("ws")), "ws", 3)
    assert {r["gram"] for r in plan.collect()} == {"x", "y", "x y"}
    assert "array_join" not in plan._jdf.queryExecution().optimizedPlan().toString()
