"""Feature mining over labelled documents: a word is a feature, quality the class."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.functions.hashing import draw32
from quillspark.operators import concepts as cc
from quillspark.operators import examples as xm
from quillspark.operators import greedy as gr
from quillspark.operators import mining as mi
from quillspark.operators import sampling as sm
from quillspark.operators import trees as tr
from quillspark.operators import vocabulary as vo
from quillspark.plans import sql as q
from quillspark.plans.registry import query
from quillspark.session import materialise

CLASSES = [0, 1]
TOP_K = 100_000  # features that may be merged


def labelled(t):
    """(doc, y, text, split): documents with a quality label; half of them are train."""
    split = F.when(draw32("split", F.col("doc_id")) % 2 == 0, "train").otherwise("dev")
    return t.labels.select("doc_id", F.col("quality").alias("y")).join(
        t.documents.select("doc_id", "text"), "doc_id"
    ).select(F.col("doc_id").alias("doc"), "y", "text", split.alias("split"))


def word_cube(docs):
    return mi.CountCube(docs, tx.letter_runs(F.col("text")))


def word_feats(docs, keep=("y",)):
    return mi.features_of(docs, "doc", tx.letter_runs(F.col("text")), keep)


LABELLED = f"""docs AS (SELECT d.doc_id AS doc, quality AS y, text,
        CASE WHEN {q.h32('split', 'd.doc_id')} % 2 = 0 THEN 'train' ELSE 'dev' END AS split
        FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
      feats AS (SELECT doc, y, split, unnest({q.lower_words('text')}) AS feature FROM docs)"""


def mi_sql(feats: str, docs: str, by: str = "feature") -> str:
    """MI by the dense definition: every feature with every class, present and absent."""
    return f"""SELECT {by}, sum(p1 * (ln(p1) - ln(z1) - ln(py)) + p0 * (ln(p0) - ln(z0) - ln(py))) AS mi,
        sum(c)::BIGINT AS count, arg_max(y, c * 1000 - y) AS majority, max(c) AS max_c, (max(c) + 1.0::DOUBLE) / (sum(c) + count(*)) AS pct_majority
      FROM (SELECT *, sum(p1) OVER w AS z1, sum(p0) OVER w AS z0, p1 + p0 AS py FROM
        (SELECT {by}, y, c, (c + 1.0::DOUBLE) / total AS p1, (n_y - c + 1.0::DOUBLE) / total AS p0 FROM
          (SELECT f.*, k.y, n_y, coalesce(c, 0) AS c, (SELECT sum(n_y) + 2 * count(*) FROM (SELECT count(*) AS n_y FROM {docs} GROUP BY y)) AS total
           FROM (SELECT DISTINCT {by} FROM {feats}) f CROSS JOIN (SELECT y, count(*) AS n_y FROM {docs} GROUP BY y) k
           LEFT JOIN (SELECT {by}, y, count(*) AS c FROM {feats} GROUP BY ALL) g USING ({by}, y)))
        WINDOW w AS (PARTITION BY {by})) GROUP BY {by}"""


@query("f3_word_features", f"WITH {LABELLED} SELECT doc, y, feature FROM feats")
def _(t):
    return word_feats(labelled(t))


@query(
    "f4_seen_features",
    f"""WITH {LABELLED} SELECT doc, feature FROM feats WHERE split = 'dev'
      AND feature IN (SELECT feature FROM feats WHERE split = 'train')""",
)
def _(t):
    feats = word_feats(labelled(t), ("split",))
    train = feats.filter("split = 'train'")
    return mi.seen_only(feats.filter("split = 'dev'"), train).select("doc", "feature")


@query(
    "f5_word_mi",
    f"WITH {LABELLED} SELECT feature, round(mi, 8) AS mi, count, majority FROM ({mi_sql('feats', 'docs')})",
)
def _(t):
    out = word_cube(labelled(t)).information()
    return out.select("feature", F.round("mi", 8).alias("mi"), "count", "majority")


@query(
    "f5_word_mi_by_lang",
    f"""WITH docs AS (SELECT doc_id AS doc, list_position(['de', 'en', 'es', 'fr'], lang) AS y, text FROM documents),
      feats AS (SELECT doc, y, unnest({q.lower_words('text')}) AS feature FROM docs)
      SELECT feature, round(mi, 8) AS mi, count, majority FROM ({mi_sql('feats', 'docs')})""",
)
def _(t):
    langs = F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")])
    docs = t.documents.select(
        F.col("doc_id").alias("doc"), F.array_position(langs, F.col("lang")).cast("int").alias("y"), "text", F.lit("all").alias("split")
    )
    out = word_cube(docs).information()
    return out.select("feature", F.round("mi", 8).alias("mi"), "count", "majority")


@query(
    "f6_ranked_features",
    f"""WITH {LABELLED}, m AS (SELECT feature, round(mi, 8) AS mi FROM ({mi_sql('feats', 'docs')}))
      SELECT feature, mi, row_number() OVER (ORDER BY mi DESC, feature) AS place FROM m""",
)
def _(t):
    table = word_cube(labelled(t)).information().select("feature", F.round("mi", 8).alias("mi"))
    # places by ranges of mi, so that no task sorts all features
    bucket = F.floor(-F.col("mi") * 1000).cast("bigint")
    numbered = sm.numbered(table.withColumn("o", F.struct(-F.col("mi"), F.col("feature"))), [], "o", bucket, "place")
    return numbered.select("feature", "mi", "place")


@query(
    "f7_feature_table",
    f"""WITH {LABELLED}, c AS (SELECT feature, count(*) FILTER (y = 0) AS count_0, count(*) FILTER (y = 1) AS count_1
        FROM feats GROUP BY feature)
      SELECT feature, left(feature, 1) AS root, round(mi, 8) AS mi, count, count_0, count_1, majority,
        round(pct_majority, 8) AS pct_majority FROM ({mi_sql('feats', 'docs')}) JOIN c USING (feature)""",
)
def _(t):
    out = word_cube(labelled(t)).information(keep=mi.per_class_counts(CLASSES))
    return out.select(
        "feature", F.substring("feature", 1, 1).alias("root"), F.round("mi", 8).alias("mi"), "count", "count_0",
        "count_1", "majority", F.round("pct_majority", 8).alias("pct_majority"),
    )


_TOP = f"""m AS (SELECT feature, round(mi, 8) AS mi, majority FROM ({mi_sql('tf', 'td')})),
      top AS (SELECT feature, left(feature, 1) AS key, majority AS cls, mi FROM m ORDER BY mi DESC, feature LIMIT 100000)"""
_TRAIN = f"{LABELLED}, tf AS (SELECT * FROM feats WHERE split = 'train'), td AS (SELECT * FROM docs WHERE split = 'train')"
_MERGED = f"""{_TRAIN}, {_TOP},
      g AS (SELECT DISTINCT doc, y, key, cls FROM tf JOIN top USING (feature)),
      n AS (SELECT y, count(*) AS n_y FROM td GROUP BY y),
      every AS (SELECT key, cls, y, n_y FROM (SELECT DISTINCT key FROM top) CROSS JOIN (SELECT unnest([0, 1]) AS cls) CROSS JOIN n),
      cnt AS (SELECT e.*, coalesce(c, 0) AS c, (SELECT sum(n_y) + 4 FROM n) AS total FROM every e
        LEFT JOIN (SELECT key, cls, y, count(*) AS c FROM g GROUP BY ALL) USING (key, cls, y)),
      p AS (SELECT *, (c + 1.0::DOUBLE) / total AS p1, (n_y - c + 1.0::DOUBLE) / total AS p0 FROM cnt),
      z AS (SELECT *, sum(p1) OVER w AS z1, sum(p0) OVER w AS z0 FROM p WINDOW w AS (PARTITION BY key, cls)),
      merged AS (SELECT key, cls, round(sum(p1 * ln(p1 / (z1 * (p1 + p0))) + p0 * ln(p0 / (z0 * (p1 + p0)))), 8) AS mi,
        sum(c)::BIGINT AS count, max(c) FILTER (y = 0) AS count_0, max(c) FILTER (y = 1) AS count_1,
        arg_max(y, c * 1000 - y) AS majority, max(c) AS max_c FROM z GROUP BY key, cls)"""


def merged(t):
    docs = labelled(t)
    train = docs.filter("split = 'train'")
    cube = word_cube(docs)
    table = cube.information("train").withColumn("mi", F.round("mi", 8))
    chosen = materialise(mi.top_features(table, TOP_K), "chosen")
    groups, members = mi.merge_by_majority(
        word_feats(train), train, chosen, F.substring("feature", 1, 1), CLASSES, totals=cube.totals("train")
    )
    return docs, groups, members


@query(
    "f8_merged_groups",
    f"WITH {_MERGED} SELECT key, cls, mi, count, count_0, count_1, majority FROM merged",
)
def _(t):
    _, groups, _ = merged(t)
    return groups.select("key", "cls", F.round("mi", 8).alias("mi"), "count", "count_0", "count_1", "majority")


@query("f9_greedy_groups")
def _(t):
    train = labelled(t).filter("split = 'train'")
    feats = word_feats(train)
    table = word_cube(train).information().withColumn("mi", F.round("mi", 8))
    chosen = mi.top_features(table, TOP_K).withColumn("key", F.substring("feature", 1, 1))
    return gr.merge_greedily(feats, train, chosen, TOP_K)


@query(
    "f10_merged_table",
    f"""WITH {_MERGED}, ex AS (SELECT key, cls, string_agg(feature, ', ' ORDER BY rn) AS examples FROM
        (SELECT *, row_number() OVER (PARTITION BY key, cls ORDER BY mi DESC, feature) AS rn FROM top) WHERE rn <= 8 GROUP BY key, cls)
      SELECT key, cls, coalesce(examples, '') AS examples, mi, count, majority, round((max_c + 1.0) / (count + 2), 8) AS pct_majority,
        max_c AS support_count, count - max_c AS counter_count FROM merged LEFT JOIN ex USING (key, cls)""",
)
def _(t):
    _, groups, members = merged(t)
    return groups.join(mi.group_examples(members), ["key", "cls"], "left").select(
        "key", "cls", F.coalesce("examples", F.lit("")).alias("examples"), F.round("mi", 8).alias("mi"), "count",
        "majority", F.round("pct_majority", 8).alias("pct_majority"), "support_count", "counter_count",
    )


FLIP = f"CASE WHEN {q.h32('model', 'doc')} % 5 = 0 THEN 1 - y ELSE y END"


def with_model(docs):
    flip = draw32("model", F.col("doc")) % 5 == 0
    preds = docs.select(F.col("doc").alias("uid"), F.when(flip, 1 - F.col("y")).otherwise(F.col("y")).alias("predicted"))
    return mi.attach_predictions(docs, preds)


@query(
    "j20_attach_predictions",
    f"WITH {LABELLED} SELECT doc, y, {FLIP} AS predicted, ({FLIP} = y)::INT AS acc FROM docs",
)
def _(t):
    return with_model(labelled(t).select("doc", "y"))


@query(
    "f11_support_counter",
    f"""WITH {_TRAIN}, m AS (SELECT feature, arg_max(y, c * 1000 - y) AS majority FROM
        (SELECT feature, y, count(*) AS c FROM tf GROUP BY ALL) GROUP BY feature),
      d AS (SELECT *, ({FLIP} = y)::INT AS acc FROM feats WHERE split = 'dev')
      SELECT feature, count(*) FILTER (y = majority) AS support_n, round(avg(acc) FILTER (y = majority), 8) AS support_acc,
        count(*) FILTER (y <> majority) AS counter_n, round(avg(acc) FILTER (y <> majority), 8) AS counter_acc
      FROM d JOIN m USING (feature) GROUP BY feature""",
)
def _(t):
    docs = labelled(t)
    table = word_cube(docs).information("train")
    dev = with_model(docs.filter("split = 'dev'"))
    out = mi.support_counter_accuracy(word_feats(dev, ("y", "acc")), table)
    return out.select(
        "feature", "support_n", F.round("support_acc", 8).alias("support_acc"), "counter_n",
        F.round("counter_acc", 8).alias("counter_acc"),
    )


@query(
    "f12_ngrams",
    f"""SELECT gram, count(*) AS n FROM (SELECT unnest([array_to_string(ws[i:i + k - 1], ' ') FOR i IN range(1, len(ws) - k + 2)]) AS gram
      FROM (SELECT {q.words('text')} AS ws, k FROM documents, (VALUES (1), (2), (3)) AS v(k)) WHERE len(ws) >= k) GROUP BY gram""",
)
def _(t):
    return tx.counted_ngrams(t.documents.select(tx.words(F.col("text")).alias("ws")), "ws", 3)


# Lists of n-gram pairs made of the most frequent words of the left and right halves.
_PATTERN_ROWS = [(0, 0, "the", "of"), (0, 1, "and the", "in"), (1, 0, "ϵ", "is"), (1, 1, "zzz", "ϵ"), (2, 0, "la", "ϵ"), (3, 0, "der", "die")]
_PATTERNS = ", ".join(f"({a}, {b}, '{u}', '{v}')" for a, b, u, v in _PATTERN_ROWS)
_HALVES = f"""h AS (SELECT doc_id, ws[1:len(ws) // 2] AS a, ws[len(ws) // 2 + 1:] AS b FROM (SELECT doc_id, {q.words('lower(text)')} AS ws FROM documents)),
      hay AS (SELECT doc_id, ' ' || array_to_string(a, ' ') || ' ' AS a, ' ' || array_to_string(b, ' ') || ' ' AS b FROM h),
      pat(list_id, pair_no, u, v) AS (VALUES {_PATTERNS})"""


def _halves(t):
    ws = t.documents.select("doc_id", tx.words(F.lower("text")).alias("ws"))
    half = F.floor(F.size("ws") / 2).cast("int")
    return ws.select("doc_id", F.slice("ws", F.lit(1), half).alias("a"), F.slice("ws", half + 1, F.size("ws")).alias("b"))


def _patterns(t):
    return t.spark.createDataFrame(_PATTERN_ROWS, "list_id int, pair_no int, u string, v string")


@query(
    "f13_ngram_pairs",
    f"""WITH {_HALVES} SELECT DISTINCT doc_id AS doc, list_id FROM hay, pat WHERE CASE WHEN u = 'ϵ' THEN contains(b, ' ' || v || ' ')
      WHEN v = 'ϵ' THEN contains(a, ' ' || u || ' ') ELSE contains(a, ' ' || u || ' ') AND contains(b, ' ' || v || ' ') END""",
)
def _(t):
    return vo.ngram_pair_features(_halves(t), "doc_id", "a", "b", _patterns(t))


@query(
    "f14_right_ngrams",
    f"WITH {_HALVES} SELECT DISTINCT doc_id AS doc, list_id FROM hay, pat WHERE contains(b, ' ' || v || ' ')",
)
def _(t):
    return vo.right_ngram_features(_halves(t), "doc_id", "b", _patterns(t))


@query(
    "f15_user_features",
    f"""WITH docs AS (SELECT d.doc_id AS doc, quality AS y, text FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
      feats AS (SELECT DISTINCT doc, y, length(w) AS feature FROM (SELECT doc, y, unnest({q.words('text')}) AS w FROM docs))
      SELECT feature::VARCHAR AS feature, round(mi, 8) AS mi, count FROM ({mi_sql('feats', 'docs')})""",
)
def _(t):
    docs = labelled(t).select("doc", "y", "text")
    lengths = lambda d: d.select(
        "doc", F.explode(F.array_distinct(F.transform(tx.words(F.col("text")), lambda w: F.char_length(w).cast("string")))).alias("feature")
    )
    return mi.add_features(docs, lengths, sort=False).select("feature", F.round("mi", 8).alias("mi"), "count")


_VTOK = f"regexp_extract_all(lower(strip_accents(text)), {q.quoted(rf'[^\p{{P}}$+<=>^`|~{tx.SPACE}]+|[\p{{P}}$+<=>^`|~]')})"
_VOCAB = f"""tok AS (SELECT doc_id, unnest(ts) AS token, generate_subscripts(ts, 1) AS pos FROM (SELECT doc_id, {_VTOK} AS ts FROM documents)),
      voc AS (SELECT token, 3 + row_number() OVER (ORDER BY freq DESC, token) AS id, freq FROM
        (SELECT token, count(*) AS freq FROM tok GROUP BY token HAVING count(*) >= 3 ORDER BY freq DESC, token LIMIT 19996)),
      vocab AS (SELECT * FROM voc UNION ALL VALUES ('[PAD]', 0, 0), ('[CLS]', 1, 0), ('[SEP]', 2, 0), ('[UNK]', 3, 0))"""


@query("f16_vocabulary", f"WITH {_VOCAB} SELECT token, id, freq FROM vocab")
def _(t):
    out = vo.vocabulary(t.documents, "text", size=20000)
    return out.select("token", F.col("id").cast("bigint"), "freq")


@query(
    "f17_encode",
    f"""WITH {_VOCAB}, e AS (SELECT doc_id, string_agg(coalesce(id, 3)::VARCHAR, ' ' ORDER BY pos) AS ids FROM tok LEFT JOIN vocab USING (token) GROUP BY doc_id)
      SELECT doc_id AS doc, '1 ' || coalesce(ids || ' ', '') || '2' AS ids FROM documents LEFT JOIN e USING (doc_id)""",
)
def _(t):
    vocab = vo.vocabulary(t.documents, "text", size=20000)
    out = vo.encode(t.documents, "doc_id", "text", vocab)
    return out.select("doc", F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("ids"))


@query(
    "f17_decode",
    f"""WITH {_VOCAB}, d AS (SELECT conv_id, turn, unnest([length(text) % 50, turn, 3, length(role)]) AS id, unnest([1, 2, 3, 4]) AS pos FROM conversations)
      SELECT conv_id * 1000 + turn AS doc, string_agg(token, ' ' ORDER BY pos) AS tokens FROM d JOIN vocab USING (id) GROUP BY ALL""",
)
def _(t):
    vocab = vo.vocabulary(t.documents, "text", size=20000)
    rows = t.conversations.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("doc"),
        F.array(F.char_length("text") % 50, F.col("turn").cast("int"), F.lit(3), F.char_length("role")).alias("ids"),
    )
    return vo.decode(rows, "doc", "ids", vocab).select("doc", F.array_join("tokens", " ").alias("tokens"))


@query(
    "f18_smoothed_majority",
    """SELECT source, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es,
      count(*) FILTER (lang = 'fr') AS fr, round((greatest(de, en, es, fr) + 1.0::DOUBLE) / (count(*) + 4), 8) AS pct_majority FROM documents GROUP BY source""",
)
def _(t):
    n = lambda lang: F.count(F.when(F.col("lang") == lang, 1)).alias(lang)
    langs = ["de", "en", "es", "fr"]
    counts = t.documents.groupBy("source").agg(*map(n, langs))
    return counts.withColumn("pct_majority", F.round(mi.smoothed_majority([F.col(x) for x in langs]), 8))


# Trees by rule: one per sentence; words in pairs under nodes named by a length.
def tree_text(ws):
    pairs = F.transform(
        F.filter(F.transform(ws, lambda w, i: F.when(i % 2 == 0, F.struct(w.alias("a"), F.get(ws, i + 1).alias("b")))), lambda p: p.isNotNull()),
        lambda p: F.concat(
            F.lit("("), (F.char_length(p["a"]) % 5).cast("string"), F.lit(" "), p["a"],
            F.coalesce(F.concat(F.lit(" "), p["b"]), F.lit("")), F.lit(")"),
        ),
    )
    return F.concat(F.lit("("), (F.size(ws) % 7).cast("string"), F.lit(" "), F.array_join(pairs, " "), F.lit(")"))


def sentence_trees(t):
    from quillspark.functions.binding import let

    clean = F.regexp_replace(F.col("text"), r"[()_]", "")
    sents = t.documents.select("doc_id", F.posexplode(F.split(clean, r"[.]")).alias("no", "s"))
    words = sents.select("doc_id", "no", tx.words(F.col("s")).alias("ws"))
    return words.select("doc_id", "no", let(F.col("ws"), tree_text).alias("tree"), "ws")


_TREES = f"""sent AS (SELECT doc_id, no - 1 AS no, {q.words('s')} AS ws FROM (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS no
        FROM (SELECT doc_id, string_split(regexp_replace(text, '[()_]', '', 'g'), '.') AS ss FROM documents))),
      pair AS (SELECT doc_id, no, i // 2 AS pos, ws[i + 1] AS a, ws[i + 2] AS b FROM (SELECT *, unnest(range(0, len(ws), 2)) AS i FROM sent)),
      node AS (SELECT doc_id, no, pos, (length(a) % 5)::VARCHAR AS root, '(' || length(a) % 5 || ' *' || CASE WHEN b IS NULL THEN ')' ELSE ' *)' END AS template,
        a || coalesce(' ' || b, '') AS span, 1 AS depth FROM pair),
      tops AS (SELECT s.doc_id, s.no, (len(ws) + 1) // 2 AS pos, (len(ws) % 7)::VARCHAR AS root, t.template, array_to_string(ws, ' ') AS span, 2 AS depth
        FROM sent s JOIN (SELECT doc_id, no, string_agg(template, ' ' ORDER BY pos) AS template FROM node GROUP BY ALL) t USING (doc_id, no)),
      nodes AS (SELECT * FROM node UNION ALL SELECT doc_id, no, pos, root, '(' || root || ' ' || template || ')', span, depth FROM tops)"""


@query("f1_tree_nodes", f"WITH {_TREES} SELECT doc_id, no, pos, root, template, span, depth FROM nodes")
def _(t):
    out = tr.tree_rows(sentence_trees(t), "tree", keep=["doc_id", "no"], fields=["pos", "root", "template", "span", "depth"])
    return out.select("doc_id", "no", "pos", "root", "template", "span", "depth")


@query(
    "f1_subtree_features",
    f"WITH {_TREES} SELECT DISTINCT doc_id AS doc, root, template, span FROM nodes WHERE depth <= 2",
)
def _(t):
    nodes = tr.tree_rows(sentence_trees(t), "tree", keep=["doc_id"], fields=["root", "template", "span", "depth"])
    return tr.subtree_features(nodes, "doc_id", 2)


@query(
    "f2_productions",
    f"""WITH {_TREES} SELECT DISTINCT doc_id AS doc, root AS lhs, '(' || string_agg(child, ', ' ORDER BY pos) || CASE WHEN count(*) = 1 THEN ',)' ELSE ')' END AS rhs
      FROM (SELECT s.doc_id, s.no, (len(ws) % 7)::VARCHAR AS root, n.pos, n.root AS child FROM sent s JOIN node n USING (doc_id, no)) GROUP BY doc_id, no, root
      UNION SELECT doc_id, (length(a) % 5)::VARCHAR, '(''' || a || ''',' || coalesce(' ''' || b || '''', '') || ')' FROM pair""",
)
def _(t):
    nodes = tr.tree_rows(sentence_trees(t), "tree", keep=["doc_id"], fields=["root", "production"])
    return tr.production_features(nodes, "doc_id")


@query("f2_production_trees")
def _(t):
    nodes = tr.tree_rows(sentence_trees(t), "tree", keep=["doc_id"], fields=["root", "production", "flat", "children"])
    return tr.production_tree_features(nodes, "doc_id")


@query(
    "j21_reviews",
    """WITH r AS (SELECT conv_id AS review_id, arg_min(role, turn) AS label FROM conversations GROUP BY conv_id)
      SELECT review_id, turn AS pos, text AS sentence, label FROM conversations JOIN r ON conv_id = review_id
      WHERE conv_id IN (SELECT doc_id FROM labels WHERE toxic = 0)""",
)
def _(t):
    rows = t.conversations.select(
        F.col("conv_id").alias("review_id"), F.col("turn").alias("pos"), F.col("text").alias("sentence"),
        F.lit("").alias("tree"), F.col("role").alias("label"), F.col("role").alias("label_name"),
    )
    reviews = t.labels.filter("toxic = 0").select(F.col("doc_id").alias("uid"))
    return xm.sentences_to_reviews(rows, reviews).select("review_id", "pos", "sentence", "label")


_KW = f"""{_MERGED}, ex AS (SELECT key, cls, string_agg(feature, ', ' ORDER BY rn) AS examples FROM
        (SELECT *, row_number() OVER (PARTITION BY key, cls ORDER BY mi DESC, feature) AS rn FROM top) WHERE rn <= 8 GROUP BY key, cls),
      tab AS (SELECT CASE majority WHEN 0 THEN 'low' ELSE 'high' END AS label, coalesce(examples, '') AS examples, mi FROM merged LEFT JOIN ex USING (key, cls)),
      grp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY mi DESC, examples) AS grp FROM tab) WHERE grp <= 6),
      kws AS (SELECT label, grp, unnest(list_filter(ks, lambda k: k <> '')) AS kw, generate_subscripts(list_filter(ks, lambda k: k <> ''), 1) - 1 AS kw_no
        FROM (SELECT label, grp, list_transform(string_split(examples, ','), lambda k: trim(k)) AS ks FROM grp))"""


def _groups(t):
    _, groups, members = merged(t)
    table = groups.join(mi.group_examples(members), ["key", "cls"], "left").select(
        F.when(F.col("majority") == 0, "Low").otherwise("High").alias("label"),
        F.coalesce("examples", F.lit("")).alias("examples"), F.round("mi", 8).alias("mi"),
    )
    return cc.keyword_groups(table, 3)


@query("j18_keyword_groups", f"WITH {_KW} SELECT label, grp, kw_no, kw FROM kws")
def _(t):
    return _groups(t)


@query(
    "j19_concept_prompts",
    f"""WITH {_KW}, rws AS (SELECT doc AS row_id, CASE y WHEN 0 THEN 'low' ELSE 'high' END AS label, text AS sentence FROM docs),
      hit AS (SELECT k.label, grp, kw_no, kw, arg_min(sentence, row_id) AS sentence FROM kws k JOIN rws r ON r.label = k.label AND contains(sentence, kw) GROUP BY ALL),
      one AS (SELECT label, grp, kw, min(kw_no) AS kw_no, arg_min(sentence, kw_no) AS sentence FROM hit GROUP BY label, grp, kw),
      num AS (SELECT *, row_number() OVER (PARTITION BY label, grp ORDER BY kw_no) AS n, count(*) OVER (PARTITION BY label, grp) AS total FROM one),
      pr AS (SELECT label, grp, string_agg('{{sentence: ' || sentence || ', keyword: ' || kw || '}}' || chr(10), '' ORDER BY n) AS lines FROM num WHERE total > 1 AND n <= 3 GROUP BY ALL),
      rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY grp) AS n FROM pr)
      SELECT label, n, {q.quoted(cc.fx.CONCEPT_REQUEST)} || lines AS instruction FROM rk WHERE n <= 3""",
)
def _(t):
    rows = labelled(t).select(
        F.col("doc").alias("row_id"), F.when(F.col("y") == 0, "Low").otherwise("High").alias("label_name"),
        F.col("text").alias("sentence"),
    )
    return cc.concept_prompts(cc.keyword_sentences(_groups(t), rows), 3)
