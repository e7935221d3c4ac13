"""Scalar text operators over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import fixed as fx
from quillspark.functions import pos as ps
from quillspark.functions import text as tx
from quillspark.operators import generate as gen
from quillspark.operators import labels as lb
from quillspark.operators import prompts as pr
from quillspark.plans import sql as q
from quillspark.plans.registry import query

S = lambda: F.array(*[F.lit(w) for w in q.STOP])


def response():
    """The same rule as q.response, as a column."""
    t = F.col("text")
    return (
        F.when(F.col("conv_id") % 4 == 0, t)
        .when(F.col("conv_id") % 4 == 1, F.concat(F.lit("Sure:"), F.replace(t, F.lit("\n"), F.lit("\n\n"))))
        .when(F.col("conv_id") % 4 == 2, F.concat(F.lit("Title: \n\n"), t, F.lit(" Note: more")))
        .otherwise("Nothing: ")
    )


@query("t1_clean_text", f"SELECT doc_id, {q.clean('text')} AS cleaned FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.clean(F.col("text")).alias("cleaned"))


@query(
    "t2_length_band",
    f"""SELECT doc_id, n AS n_words, greatest(n, 5) AS min_words, greatest(n // 2, 5) AS min_words_half,
      greatest(3 * n // 2, 10) AS max_words FROM (SELECT doc_id, len({q.words('text')}) AS n FROM documents)""",
)
def _(t):
    n = F.col("n_words")
    return t.documents.select("doc_id", tx.word_count(F.col("text")).cast("bigint").alias("n_words")).select(
        "doc_id", "n_words",
        tx.min_words(n).cast("bigint").alias("min_words"),
        tx.min_words(n, halved=True).cast("bigint").alias("min_words_half"),
        tx.max_words(n).cast("bigint").alias("max_words"),
    )


@query(
    "t3_sentence_count",
    f"""SELECT doc_id, n AS num_sents, CASE WHEN n = 1 THEN 'sentence' ELSE 'sentences' END AS sent_key
      FROM (SELECT doc_id, len({q.sentences('text')}) AS n FROM documents)""",
)
def _(t):
    n = F.size(tx.sentences(F.col("text"))).cast("bigint")
    return t.documents.select("doc_id", n.alias("num_sents")).withColumn("sent_key", tx.sentence_key(F.col("num_sents")))


@query(
    "t4_content_tokens",
    f"""SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct({q.tokens('text')}),
      lambda w: w NOT IN ('''''', '''s') AND NOT list_contains({q.STOP_SQL}, w) AND length(w) >= 2
      AND trim(w) <> '')), ' ') AS kept FROM documents""",
)
def _(t):
    kept = tx.content_tokens(tx.tokens(F.col("text")), S())
    return t.documents.select("doc_id", F.array_join(F.sort_array(kept), " ").alias("kept"))


@query(
    "t5_alphabetic_words",
    f"""SELECT doc_id, len(list_filter(ws, lambda w: regexp_full_match(w, '[A-Za-z]+'))) AS alphabetic,
      len(list_filter(ws, lambda w: regexp_full_match(w, '[A-Za-z]+') AND NOT list_contains({q.STOP_SQL}, w))) AS usable
      FROM (SELECT doc_id, {q.words('text')} AS ws FROM documents)""",
)
def _(t):
    ws = tx.words(F.col("text"))
    alpha = F.filter(ws, tx.is_alphabetic)
    usable = F.filter(alpha, lambda w: ~F.array_contains(S(), w))
    return t.documents.select(
        "doc_id", F.size(alpha).cast("bigint").alias("alphabetic"), F.size(usable).cast("bigint").alias("usable")
    )


@query(
    "t6_lower_keywords",
    f"SELECT doc_id, array_to_string(list_transform({q.tokens('text')}, lambda w: lower(w)), ' ') AS lowered FROM documents",
)
def _(t):
    return t.documents.select("doc_id", F.array_join(tx.lower_all(tx.tokens(F.col("text"))), " ").alias("lowered"))


@query(
    "t7_abstract_request",
    "SELECT doc_id, 'Write an abstract of the following document in a few words:' || chr(10) || text AS for_document, "
    "'Write an abstract of the following sentence in a few words:' || chr(10) || text AS for_sentence FROM documents",
)
def _(t):
    return t.documents.select(
        "doc_id",
        pr.abstract_request(F.col("text")).alias("for_document"),
        pr.abstract_request(F.col("text"), "sentence").alias("for_sentence"),
    )


def _template_case(family: str) -> str:
    """The expected prompts of one family written out in SQL."""
    fam = pr.FAMILIES[family]
    values = {
        "topic": "'The document should be on the topic of ' || lang", "exemplars": "'\"' || source || '\"'",
        "min_words": "n_chars", "max_words": "2 * n_chars", "inc_kws": "inc", "exc_kws": "exc",
        "pos_seq": "lang", "topic_kw": "'topic'", "start": "'sentences'", "num_sent": "doc_id",
        "label": "'be'", "sent2": "text", "ner_labels": "source", "question": "text",
    }

    def sql_text(template: str) -> str:
        import re

        parts = []
        for piece in re.split(r"(\{\w+\})", template):
            if piece:
                key = piece[1:-1]
                parts.append(f"({values[key]})::VARCHAR" if piece[0] == "{" and key in values else q.quoted(piece))
        return " || ".join(parts)

    cols = []
    for kind in pr.KINDS:
        both, some, none = (sql_text(fam.text(c, kind)) for c in pr.CASES)
        cols.append(f"CASE WHEN inc <> '' AND exc <> '' THEN {both} WHEN inc <> '' THEN {some} ELSE {none} END AS prompt_{kind}")
    return (
        f"SELECT '{family}' AS family, doc_id, {', '.join(cols)} FROM (SELECT *, CASE WHEN doc_id % 3 < 2 THEN "
        "source ELSE '' END AS inc, CASE WHEN doc_id % 3 = 0 THEN lang ELSE '' END AS exc FROM documents)"
    )


@query("t8_render_prompts", " UNION ALL ".join(_template_case(f) for f in pr.FAMILIES))
def _(t):
    rows = t.documents.withColumn("inc", F.when(F.col("doc_id") % 3 < 2, F.col("source")).otherwise("")).withColumn(
        "exc", F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise("")
    )
    c = F.col
    values = {
        "topic": F.concat(F.lit("The document should be on the topic of "), c("lang")),
        "exemplars": F.concat(F.lit('"'), c("source"), F.lit('"')),
        "min_words": c("n_chars"), "max_words": 2 * c("n_chars"), "pos_seq": c("lang"),
        "topic_kw": F.lit("topic"), "start": F.lit("sentences"), "num_sent": c("doc_id"), "label": F.lit("be"),
        "sent2": c("text"), "ner_labels": c("source"), "question": c("text"),
    }
    # one pass over the documents: all families of a row at once, then unnested
    families = F.array(*[
        F.struct(
            F.lit(f).alias("family"),
            pr.render(f, "abs", values, c("inc"), c("exc")).alias("prompt_abs"),
            pr.render(f, "solo", values, c("inc"), c("exc")).alias("prompt_solo"),
        )
        for f in pr.FAMILIES
    ])
    return rows.select("doc_id", F.explode(families).alias("p")).select("p.family", "doc_id", "p.prompt_abs", "p.prompt_solo")


@query(
    "t9_topic_phrase",
    "SELECT doc_id, 'The document''s terms of service should be ' || lang AS ots, "
    "'The document should be on the topic of ' || lang AS yahoo, 'sentiment: sentiment' AS sst2 FROM documents",
)
def _(t):
    kw, topic = fx.TOPIC_PAIRS_SENTENCES["sst2"]
    return t.documents.select(
        "doc_id", pr.topic_sentence("ots", F.col("lang")).alias("ots"),
        pr.topic_sentence("yahoo", F.col("lang")).alias("yahoo"), F.lit(f"{kw}: {topic}").alias("sst2"),
    )


POS_RULE = "CASE WHEN length({w}) % 3 = 0 THEN 'NOUN' WHEN length({w}) % 3 = 1 THEN 'VERB' ELSE 'ADJ' END"


def pos_rule(w):
    n = F.char_length(w) % 3
    return F.when(n == 0, "NOUN").when(n == 1, "VERB").otherwise("ADJ")


def _class_sql(tag: str) -> str:
    return (
        f"array_to_string(list_sort(list_distinct(list_filter(ws, lambda w: length(w) >= 2 AND NOT "
        f"list_contains({q.STOP_SQL}, w) AND w NOT IN ('''''', '''s') AND ({POS_RULE.format(w='w')}) = '{tag}'))), ' ')"
    )


@query(
    "t10_pos_lists",
    f"""SELECT doc_id, array_to_string(list_transform(ws, lambda w: {POS_RULE.format(w='w')}), ' ') AS pos_seq,
      {_class_sql('NOUN')} AS nouns, {_class_sql('VERB')} AS verbs, {_class_sql('ADJ')} AS others
      FROM (SELECT doc_id, {q.words('text')} AS ws FROM documents)""",
)
def _(t):
    tagged = t.documents.select("doc_id", tx.words(F.col("text")).alias("ws")).withColumn("tags", F.transform("ws", pos_rule))
    out = ps.word_lists(tagged, "ws", "tags", S())
    line = lambda c: F.array_join(F.sort_array(F.col(c)), " ").alias(c)
    return out.select("doc_id", "pos_seq", line("nouns"), line("verbs"), line("others"))


@query(
    "t14_paste_abstract",
    f"""WITH m AS (SELECT conv_id, turn, text, {q.answer(q.response(), True)} AS a FROM conversations)
      SELECT conv_id, turn, k, replace('First of ' || k || ': $abs$ / ' || text, '$abs$', a) AS instruction
      FROM m, (VALUES (1), (2)) AS v(k) WHERE length(a) > 0""",
)
def _(t):
    rows = t.conversations.withColumn("row_id", F.struct("conv_id", "turn"))
    mix = lambda k: F.concat(F.lit(f"First of {k}: $abs$ / "), F.col("text"))
    prompts = rows.select("row_id", mix(1).alias("mix_const_1"), mix(2).alias("mix_const_2"), F.col("role").alias("label"))
    answers = rows.select("row_id", response().alias("predict"))
    return gen.paste_abstract(prompts, "row_id", answers).select("row_id.conv_id", "row_id.turn", "k", "instruction")


@query(
    "t15_answer_text",
    f"""SELECT conv_id, turn, {q.answer(q.response(), True)} AS strict_answer,
      {q.answer(q.response(), False)} AS lenient_answer FROM conversations""",
)
def _(t):
    r = response()
    return t.conversations.select(
        "conv_id", "turn", tx.answer_part(r, True).alias("strict_answer"), tx.answer_part(r, False).alias("lenient_answer")
    )


@query(
    "t16_tidy_answer",
    f"""SELECT conv_id, turn, {q.tidy("' \"' || text || '\" '")} AS tidied, trim('"' || text || '"', '"') AS unquoted
      FROM conversations""",
)
def _(t):
    wrapped = F.concat(F.lit(' "'), F.col("text"), F.lit('" '))
    bare = F.concat(F.lit('"'), F.col("text"), F.lit('"'))
    return t.conversations.select(
        "conv_id", "turn", tx.tidy_answer(wrapped).alias("tidied"), tx.tidy_answer(bare, True).alias("unquoted")
    )


@query("t17_ascii_only", r"SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', '', 'g') AS ascii FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.ascii_only(F.col("text")).alias("ascii"))


_HEAD = q.quoted(fx.CHAT_OPEN + fx.CHAT_PREFIX.replace("{system}", fx.CHAT_SYSTEM))


@query(
    "t18_chat_wrapper",
    f"SELECT conv_id, turn, {_HEAD} || text || ' [/INST]' AS wrapped, ' reply to ' || role AS response FROM conversations",
)
def _(t):
    wrapped = gen.wrap_chat(F.col("text"))
    return t.conversations.select(
        "conv_id", "turn", wrapped.alias("wrapped"),
        gen.chat_response(F.concat(wrapped, F.lit(" reply to "), F.col("role"))).alias("response"),
    )


@query(
    "t19_concept_sentences",
    f"""SELECT role AS label, conv_id * 1000 + turn AS ord, 'The sentences should not include the abstract concept ' ||
      lower({q.strip("translate(text, '#.', '')")}) || '.' AS sentence FROM conversations""",
)
def _(t):
    rows = t.conversations.withColumn("ord", F.col("conv_id") * 1000 + F.col("turn"))
    return pr.concept_sentences(rows, "role", "ord", "text", "The sentences")


@query(
    "t20_concept_lines",
    """WITH l AS (SELECT lang, list('Avoid ' || source ORDER BY source) AS cs FROM (SELECT DISTINCT lang, source FROM documents) GROUP BY lang)
      SELECT doc_id, text || chr(10) || array_to_string(list_transform(cs, lambda x, i: (i + 3) || '. ' || x), chr(10)) AS prompt
      FROM documents JOIN l USING (lang)""",
)
def _(t):
    docs = t.documents
    sentences = docs.select(
        F.col("lang").alias("label"), F.col("source").alias("ord"), F.concat(F.lit("Avoid "), "source").alias("sentence")
    ).distinct()
    lists = pr.concept_lists(sentences)
    start = pr.concept_start("cross", "solo", F.lit("a"), F.lit("b"))
    return docs.join(lists, F.col("lang") == F.col("label")).select(
        "doc_id", pr.append_concepts(F.col("text"), F.col("concepts"), start).alias("prompt")
    )


_LABEL_ROWS = ", ".join(
    f"('{d}', {q.quoted(n)}, {i})" for d, ns in fx.LABELS.items() for i, n in enumerate(ns)
)


@query(
    "t21_label_ids",
    f"""WITH l(dataset, name, id) AS (VALUES {_LABEL_ROWS}), d AS (SELECT doc_id, text AS sentence,
      ['negative', 'positive'][1 + doc_id % 2] AS label_name FROM documents)
      SELECT doc_id, sentence, id AS label, label_name FROM d JOIN l ON l.dataset = 'sst2' AND l.name = d.label_name""",
)
def _(t):
    docs = t.documents.select(
        "doc_id", F.col("text").alias("sentence"),
        F.when(F.col("doc_id") % 2 == 0, "negative").otherwise("positive").alias("label"),
    )
    table = lb.label_table(t.spark).filter(F.col("dataset") == "sst2")
    return lb.map_labels(docs, "label", table).select("doc_id", "sentence", "label", "label_name")


@query(
    "t22_label_dictionary",
    """SELECT source AS label, row_number() OVER (ORDER BY f) - 1 AS id FROM
      (SELECT source, min(doc_id) AS f FROM documents GROUP BY source)""",
)
def _(t):
    return lb.label_dictionary(t.documents, "source", "doc_id").select(F.col("source").alias("label"), F.col("id").cast("bigint"))


@query(
    "t23_tag_words",
    f"""SELECT doc_id, array_to_string(regexp_extract_all(text, '[,.]|[^,.{tx.SPACE}]+'), '|') AS words FROM documents""",
)
def _(t):
    return t.documents.select("doc_id", F.array_join(tx.label_words(F.col("text")), "|").alias("words"))


_PUNCT = q.quoted(tx.PUNCTUATION)


@query(
    "t29_substitution_tokens",
    f"""SELECT doc_id, array_to_string(list_transform({q.tokens("replace(text, '-', ' ')")},
      lambda w: CASE WHEN contains({_PUNCT}, w) THEN w ELSE translate(w, {_PUNCT}, '') END), ' ') AS toks FROM documents""",
)
def _(t):
    return t.documents.select("doc_id", F.array_join(tx.subst_tokens(F.col("text")), " ").alias("toks"))


@query(
    "t32_marker_clean",
    r"""SELECT doc_id, replace('Ġ' || replace(text, ' ', 'Ġ'), 'Ġ', '_') AS marked,
      regexp_replace(replace(replace(text, ' ', ' _ '), '_', ''), '\s+', ' ', 'g') AS span FROM documents""",
)
def _(t):
    g = F.concat(F.lit("Ġ"), F.replace(F.col("text"), F.lit(" "), F.lit("Ġ")))
    return t.documents.select(
        "doc_id", tx.marker_clean(g).alias("marked"),
        tx.span_clean(F.replace(F.col("text"), F.lit(" "), F.lit(" _ "))).alias("span"),
    )
