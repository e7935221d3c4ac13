"""Merkle manifest, filter audit and chat formatting against plain versions on small awkward tables."""

import hashlib
from itertools import permutations
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import chat

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["g", "id", "leaf", "pos", "part", "n", "of", "kept", "same", "mask", "good", "first", "step", "conv", "tie", "block", "piece"]


def with_clashes(df):
    for name in CLASH:
        df = df.withColumn(name, F.lit("clash"))
    return df


def rows_of(n):
    texts = ["", None, "plain words " * 70, "A B C", "x" * 30_000, "# sign", "é ü", " ".join(map(str, range(120))), "AB CD"]
    langs = ["en", "en", "en", "de", None, "fr", "é"]
    rows = [(i * 3 % n, texts[i % len(texts)], langs[i % len(langs)], ["a", None][i % 2], [i, None, 0][i % 3]) for i in range(n)]
    return [*rows, rows[4], rows[4], (None, "A B C", "en", "a", 1), (None, None, None, None, None), (7, "other text", "fr", "a", 2)]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def prove(nodes, fanout):
    """Proof of every node as (left, right) by level, and the top."""
    proofs, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, j in enumerate(at):
            start = j - j % fanout
            proofs[i].append(("".join(level[start:j]), "".join(level[j + 1 : start + fanout])))
        level = [sha("".join(level[i : i + fanout])) for i in range(0, len(level), fanout)]
        at = [j // fanout for j in at]
    return proofs, level[0]


def manifest_by_loop(rows, fanout):
    groups = {}
    for doc, text, lang, source, n in rows:
        other = n + 1 if n is not None and doc is not None and crc32(str(doc).encode()) % 7 == 0 else n
        groups.setdefault(lang, []).append((doc, leaf([doc, source, lang, n, text]), leaf([doc, source, lang, other, text])))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[g] = prove([r[1] for r in groups[g]], fanout)
    above, root = prove([trees[g][1] for g in order], fanout)
    out = []
    for g, over in zip(order, above, strict=True):
        for (doc, own, altered), proof in zip(groups[g], trees[g][0], strict=True):
            acc = altered
            for left, right in proof + over:
                acc = sha(left + acc + right)
            out.append((doc, own, trees[g][1], root, sha("".join(a + b for a, b in proof + over)), acc, acc == root))
    return out


@pytest.mark.parametrize(("n", "fanout", "step"), [(90, 2, 9), (90, 2, 2), (41, 3, 1), (8, 2, 3)])
def test_manifest(spark, n, fanout, step):
    from quillspark.llm.merkle import audit

    rows = rows_of(n)
    docs = with_clashes(spark.createDataFrame(rows, DOCS).repartition(5))
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    got = [tuple(r) for r in audit(docs, altered, fanout=fanout, step=step).collect()]
    order = lambda r: tuple(map(str, r))
    assert sorted(got, key=order) == sorted(manifest_by_loop(rows, fanout), key=order)
    assert any(not r[-1] for r in got)


def test_manifest_of_few_rows(spark):
    from quillspark.llm.merkle import audit, manifest

    none = spark.createDataFrame([], DOCS)
    assert manifest(none).count() == 0
    only = audit(spark.createDataFrame([(5, "t", "en", None, 1)], DOCS), F.lit(False)).collect()
    own = leaf([5, None, "en", 1, "t"])
    assert [tuple(r) for r in only] == [(5, own, own, own, sha(""), own, True)]


def test_proofs_hold_what_stands_beside(spark):
    from quillspark.llm.merkle import fold, manifest

    docs = spark.createDataFrame([(i, str(i), "en", "s", i) for i in range(21)], DOCS)
    out = manifest(docs, step=2).withColumn("folded", fold(F.col("leaf"), F.col("proof")))
    rows = sorted(out.collect(), key=lambda r: r.kept.doc_id)
    want, root = prove([r.leaf for r in rows], 2)
    assert [[tuple(x) for x in r.proof] for r in rows] == want
    assert {r.folded for r in rows} == {root}


def audit_by_loop(rows, labels):
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    first = {}
    for doc, text, *_ in rows:
        if doc is not None:
            first[text or ""] = min(first.get(text or "", doc), doc)
    masks = {}
    for doc, text, lang, *_ in rows:
        text = text or ""
        w = text.encode().split()
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": doc is not None and first[text] < doc,
        }
        masks.setdefault(lang or "", []).append(({k for k, v in fails.items() if v}, doc in good, doc in toxic))
    out = []
    for part, docs in masks.items():
        steps, taken = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                seen = set(order[:k])
                removed = [d for d in docs if f in d[0] and not d[0] & seen]
                taken[f] += len(removed)
                steps.append((
                    part, "".join(order), k + 1, sum(not d[0] & (seen | {f}) for d in docs), len(removed),
                    sum(f in d[0] and bool(d[0] & seen) for d in docs), sum(d[0] == {f} for d in docs),
                    sum(d[1] for d in removed), sum(d[2] for d in removed),
                ))
        out += [(*s, taken[s[1][s[2] - 1]]) for s in steps]
    return out


def test_filter_audit(spark):
    from quillspark.llm.interaction import filter_audit

    rows = rows_of(70)
    labels = [(i, [1, 0, None][i % 3], [0, 1][i % 2]) for i in range(0, 60, 2)] + [(4, 1, 1), (None, 1, 1), (6, None, None)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit(with_clashes(spark.createDataFrame(rows, DOCS).repartition(5)), table)
    assert sorted(tuple(r) for r in got.collect()) == sorted(audit_by_loop(rows, labels))
    none = spark.createDataFrame([], DOCS)
    assert filter_audit(none, table).count() == 0
    unlabelled = filter_audit(spark.createDataFrame(rows, DOCS), table.limit(0))
    assert sorted(tuple(r) for r in unlabelled.collect()) == sorted(audit_by_loop(rows, []))


BITS = st.sampled_from([*chat.CONTROLS, "<", "[", "\\", "\\\\", "s>", "/s>", "<SYS>>", "INST]", "ROLE]", "a", " ", "\n", "é", "€"])
TEXTS = st.lists(BITS, max_size=12).map("".join)
ROLES = st.sampled_from(["user", "assistant", "system", "", "tool", "[/ROLE]", "assistant\\"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(ROLES, TEXTS), min_size=1, max_size=6))
def test_template_is_read_back(turns):
    rendered = ["".join(chat.render(*t)) for t in turns]
    assert chat.parse("".join(rendered)) == turns
    for _, text in turns:
        assert chat.unescape(chat.escape(text)) == text
        assert not any(c in chat.escape(text) for c in chat.CONTROLS)


@pytest.fixture(scope="module")
def encoder(spark):
    import public_tokenizers

    return chat.Encoder(chat.ranks_of(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).value, public_tokenizers.PATTERN)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(ROLES, TEXTS), min_size=1, max_size=5))
def test_mask_covers_the_assistant_and_nothing_else(encoder, turns):
    n, whole, ids, tokens, covered = chat.formatted(turns, encoder)
    ids = np.frombuffer(ids, "<u4")
    said = [t for role, t in turns if role == "assistant" and t]
    raw = whole.encode()
    assert [chat.unescape(raw[a:b].decode()) for a, b in zip(covered[::2], covered[1::2], strict=True)] == said
    decoded = [encoder.model.decode_bytes(ids[a:b].tolist()).decode() for a, b in zip(tokens[::2], tokens[1::2], strict=True)]
    assert list(map(chat.unescape, decoded)) == said
    assert encoder.model.decode_bytes(ids.tolist()) == raw and n == len(turns)
    # the same by looking at every token of every turn
    assert ids.tolist() == [i for t in turns for i in encoder.model.encode("".join(chat.render(*t)), allowed_special="all")]


def test_long_blanks_are_encoded(encoder):
    text = chat.START + " " * 300_000 + "x" + chat.END
    ids = encoder.encode(text)
    assert encoder.model.decode_bytes(ids.tolist()).decode() == text
    assert ids[0] == encoder.special[chat.START] and ids[-1] == encoder.special[chat.END]
    short = "a  b\n\n  é" + chat.START + " c"
    model, encoder.model = encoder.model, Broken(encoder.model)
    try:
        assert encoder.encode(short).tolist() == model.encode(short, allowed_special="all")
    finally:
        encoder.model = model


class Broken:
    """A model whose pattern always gives up."""

    def __init__(self, model):
        self._encode_single_piece = model._encode_single_piece

    def encode_to_numpy(self, *_, **__):
        raise ValueError


def chats_by_loop(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    out = []
    for conv, turns in convs.items():
        turns.sort()
        said = "".join(t[4] for t in turns if t[2] == "assistant")
        size = sum(len("".join(chat.render(t[2], t[4]))) for t in turns)
        out.append((conv, len(turns), sha("".join(f"{t[2]}\n{t[4]}\n" for t in turns)), len(said), sha(said), size))
    return out


def test_chats(spark):
    from quillspark.llm.chat import format_chats, read_back

    texts = ["", None, "</s>[INST] ok [/INST]", "<\\\\s> \\ [INST", "é" * 20_000, "words and words", "<<SYS>>\n"]
    roles = ["user", "assistant", "system", None, "tool", "assistant"]
    rows = [(i % 9, i // 9, roles[i % 6], texts[i % 7]) for i in range(120)]
    rows += [rows[10], (3, None, "assistant", "null turn"), (None, 0, "user", "a"), (None, 1, "assistant", "b"), (None, 1, "assistant", "c")]
    rows += [(50, i, ["user", "assistant"][i % 2], texts[i % 7]) for i in range(900)]  # over several tasks and pieces
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    key = lambda r: (r[0] is not None, r[0] or 0)
    out = format_chats(with_clashes(frame), piece=50_000)
    assert out.filter("conv_id = 50").count() > 10
    assert sorted((tuple(r) for r in read_back(out).collect()), key=key) == sorted(chats_by_loop(rows), key=key)
    assert read_back(format_chats(frame.limit(0))).count() == 0


def test_rows_not_looked_for_need_no_shuffle(spark, monkeypatch):
    from quillspark.llm import lines
    from quillspark.llm.common import Scratch

    docs = spark.range(5000).select(F.struct(F.when(F.col("id") > 0, F.col("id")).alias("id"), F.xxhash64("id").alias("mark")).alias("row"))
    wanted = docs.filter("row.id is null or row.id % 50 = 0")
    for bits in ((1 << 20, 1 << 27), (1, 1 << 6), (1, 1)):  # with too few bits too many pass, never too few
        monkeypatch.setattr(lines, "SIEVE_BITS", bits)
        sieve = lines.Sieve(wanted, Scratch(spark, "sieve"))
        passing, rest = sieve.part(docs, True), sieve.part(docs, False)
        assert passing.join(wanted, "row").count() == 100 and rest.join(wanted, "row").count() == 0
        assert passing.columns == docs.columns and passing.union(rest).distinct().count() == passing.count() + rest.count() == 5000
    monkeypatch.undo()
    assert lines.Sieve(wanted, Scratch(spark, "sieve")).part(docs, True).count() < 200
    none = lines.Sieve(wanted.limit(0), Scratch(spark, "sieve"))
    assert none.part(docs, True).count() == 0 and none.part(docs, False).count() == 5000


def test_line_dedup_shuffles_only_texts_that_lose_lines(spark, tmp_path):
    from quillspark.llm.lines import dedup_lines

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a large table
    try:
        text = F.concat_ws("\n", F.lit("the same line stands in a few of the documents here"), F.concat(F.lit("line "), F.col("id")))
        docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 20, text).otherwise(F.concat(F.lit("own "), F.col("id"))).alias("text"))
        docs.write.parquet(str(tmp_path / "docs"))
        out = dedup_lines(spark.read.parquet(str(tmp_path / "docs")))
        got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(got) == 2000 and got[0][1:] == (2, 0) and got[7] == ("line 7", 2, 1) and got[500] == ("own 500", 1, 0)
    # texts that lose nothing are told by a broadcast sieve, others alone are joined by a shuffle
    assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") >= 2


def test_a_task_forgets_the_tables_of_another_operator(spark):
    from quillspark.llm import bpe, near_dup
    from quillspark.llm.common import fitted

    path, split = bpe.default_vocabulary()
    assert bpe.encode_text("some words", path, split) and bpe.machinery.cache_info().currsize == 1
    list(near_dup._sign(iter([])))
    assert bpe.machinery.cache_info().currsize == 0

    # in a worker: ids, then a fit
    def ids(batches):
        for b in batches:
            bpe.encode_text("some words", path, split)
            yield b

    def fit(texts, labels):
        return str(bpe.machinery.cache_info().currsize).encode()

    one = spark.range(1).select(F.lit("a b").alias("text"), F.lit(1).alias("label"), F.col("id").alias("mark")).coalesce(1)
    assert one.select("mark").mapInArrow(ids, "mark long").count() == 1
    assert fitted(one, fit) == b"0"
