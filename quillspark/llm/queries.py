"""Named queries of the training-data operators and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
WORDS_SQL = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def query(key: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return add


OP1_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {WORDS_SQL.format(f"translate(coalesce(text, ''), {AZ})")} AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, len(s.s) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN c USING (doc_id)
"""


@query("op1_near_duplicates", OP1_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    from quillspark.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, folder, "documents"))


@query("op9_bpe")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    from quillspark.llm.bpe import round_trip

    out = round_trip(table(spark, folder, "documents"))
    return out.select(
        "doc_id", F.expr("cast(coalesce(length(ids), 0) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


OP8_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len({WORDS_SQL.format("coalesce(text, '')")})::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '')) AS mark FROM documents),
g AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS no,
    no % 3 + 1 AS weight,
    (sum(source_size) OVER ())::BIGINT AS total FROM g),
step AS (  -- every round fixes the sources whose share is above their cap
  SELECT 0 AS k, (SELECT max(total) FROM w)::DOUBLE AS words, (SELECT sum(weight) FROM w)::DOUBLE AS open
  UNION ALL
  SELECT k + 1, (SELECT max(total) - coalesce(sum(3 * source_size) FILTER (WHERE 3 * source_size < step.words / step.open * weight), 0) FROM w)::DOUBLE,
    (SELECT sum(weight) FILTER (WHERE NOT 3 * source_size < step.words / step.open * weight) FROM w)::DOUBLE
  FROM step WHERE k < 40),
t AS (
  SELECT source, source_size, least(3.0 * source_size, (SELECT words / open FROM step WHERE k = 40) * weight)::DOUBLE AS target,
    (no % 3 - 1) * 0.5::DOUBLE AS tilt FROM w),
o AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, t.tilt,
    (sum(d.size) OVER (PARTITION BY d.source ORDER BY mark, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size)::DOUBLE AS ahead,
    CASE WHEN t.source_size > 0 THEN least(floor(t.target / t.source_size), 3) ELSE 0 END::BIGINT AS passes
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (CASE WHEN size = 0 THEN 0 WHEN passes < 3 AND ahead + size / 2.0 <= target - passes * source_size THEN passes + 1
    ELSE passes END * size)::BIGINT AS taken,
  CASE WHEN taken = 0 THEN NULL WHEN tilt = 0 THEN least(ahead / greatest(target, 1), 1)
    ELSE (sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * least(ahead / greatest(target, 1), 1)) - (1 - tilt)) / (2 * tilt)
    END AS position
FROM o
"""


@query("op8_mixing", OP8_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """What the mix takes of every document is read off its copies, as they are scheduled for training."""
    from quillspark.llm.mixing import mixture

    plan, copies = mixture(table(spark, folder, "documents"))
    seen = copies.groupBy("row").agg(F.sum("size").alias("taken"), F.min("position").alias("position"))
    out = plan.select("row", "doc_id", "size", "source_size", "target").join(seen, "row", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "position")


@query("op5_quality")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    from quillspark.llm.quality import quality

    return quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op10_toxicity")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    from quillspark.llm.toxicity import toxicity

    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""


@query("op3_top_products", OP3_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    from quillspark.llm.topk import top_products

    return top_products(table(spark, folder, "embeddings"))


@query("op4_neighbours")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    from quillspark.llm.ann import neighbours

    return neighbours(table(spark, folder, "embeddings"))


def lines_sql(documents: str = "documents", columns: str = "doc_id") -> str:
    """Line dedup in SQL: lines of a document id order, one word edit, half keys as block keys."""
    words = WORDS_SQL.format("body")
    return f"""
l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line
  FROM {documents} WHERE text IS NOT NULL),
lw AS (SELECT *, {words} AS w FROM l),
f AS (SELECT w, min((doc_id, line)) AS pos FROM lw WHERE len(w) > 0 GROUP BY w),
k AS (
  SELECT w, pos, unnest([row('f', s, list_slice(w, 1, s)), row('f', t, list_slice(w, 1, t)),
    row('l', s, list_slice(w, n - s + 1, n)), row('l', t, list_slice(w, n - t + 1, n))]) AS half
  FROM (SELECT w, pos, len(w) AS n, (len(w) - 1) // 2 AS s, len(w) // 2 AS t FROM f) WHERE n >= 8),
p AS (
  SELECT DISTINCT a.pos AS pos, a.w AS a, b.w AS b FROM k a JOIN k b ON a.half = b.half AND b.pos < a.pos
  AND abs(len(a.w) - len(b.w)) <= 1),
e AS (
  SELECT DISTINCT pos FROM p
  WHERE coalesce(list_position(list_transform(list_zip(a, b), lambda z: z[1] IS NOT DISTINCT FROM z[2]), false) - 1, len(a))
    + coalesce(list_position(list_transform(list_zip(list_reverse(a), list_reverse(b)), lambda z: z[1] IS NOT DISTINCT FROM z[2]), false) - 1, len(a))
    >= greatest(len(a), len(b)) - 1),
g AS (
  SELECT lw.doc_id, lw.line, lw.body, len(w) > 0 AND ((lw.doc_id, lw.line) > f.pos OR e.pos IS NOT NULL) AS gone
  FROM lw LEFT JOIN f USING (w) LEFT JOIN e ON e.pos = (lw.doc_id, lw.line)),
ded AS (
  SELECT doc_id, string_agg(body, chr(10) ORDER BY line) FILTER (WHERE NOT coalesce(gone, false)) AS text,
    count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed FROM g GROUP BY doc_id)"""


OP2_SQL = f"""
WITH {lines_sql()}
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
  CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(ded.text, '')) END AS kept_sha256
FROM documents d LEFT JOIN ded USING (doc_id)
"""


@query("op2_line_dedup", OP2_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    from quillspark.llm.lines import dedup_lines

    out = dedup_lines(table(spark, folder, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY array_to_string(w[i:i + 34], ' ')) AS n FROM p),
g AS (SELECT doc_id, list(DISTINCT k) AS gone FROM (
  SELECT doc_id, unnest(range(i, i + 35)) AS k FROM h WHERE n > 1) GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w
    ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: NOT list_contains(gone, z[2])), lambda z: z[1]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN g ON w.doc_id = g.doc_id
"""


@query("op7_substring_dedup", OP7_SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    from quillspark.llm.substring import remove_repeats

    out = remove_repeats(table(spark, folder, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op6_language_model")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    from quillspark.llm.lm import language_model

    return language_model(table(spark, folder, "documents"))


#: crc32 of a decimal number: the bytes of its digits folded into the register, bit by bit.
CRC32_SQL = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], list_transform(range(8), lambda z: z::BIGINT)),
      lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""


def leaf_sql(n_chars: str) -> str:
    parts = ["doc_id::VARCHAR", "source", "lang", f"({n_chars})::VARCHAR", "text"]
    return f"sha256({' || '.join(f"coalesce(strlen({p})::VARCHAR || ':' || {p}, '-')" for p in parts)})"


OP11_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {leaf_sql("n_chars")} AS leaf, {CRC32_SQL} % 7 = 0 AS altered,
    CASE WHEN altered THEN {leaf_sql("n_chars + 1")} ELSE leaf END AS given FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos FROM d),
t AS (  -- the levels of the tree of every lang
  SELECT lang, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM p GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], '')))
  FROM t WHERE len(nodes) > 1),
s AS (
  SELECT lang, max(level) AS height, max(nodes[1]) FILTER (WHERE len(nodes) = 1) AS subroot,
    row_number() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS pos FROM t GROUP BY lang),
u AS (  -- the levels of the tree of subroots
  SELECT 0 AS level, list(subroot ORDER BY pos) AS nodes FROM s
  UNION ALL
  SELECT level + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], '')))
  FROM u WHERE len(nodes) > 1),
b AS (  -- siblings, level by level; an even place has its sibling on the right
  SELECT p.doc_id, t.level, (p.pos >> t.level) % 2 = 0 AS ahead,
    coalesce(t.nodes[xor(p.pos >> t.level, 1) + 1], '') AS other
  FROM p JOIN t ON p.lang IS NOT DISTINCT FROM t.lang AND len(t.nodes) > 1
  UNION ALL
  SELECT p.doc_id, s.height + u.level, (s.pos >> u.level) % 2 = 0, coalesce(u.nodes[xor(s.pos >> u.level, 1) + 1], '')
  FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang JOIN u ON len(u.nodes) > 1),
c AS (SELECT doc_id, list({{'ahead': ahead, 'other': other}} ORDER BY level) AS proof FROM b GROUP BY doc_id),
r AS (SELECT max(nodes[1]) AS root FROM u WHERE len(nodes) = 1),
f AS (
  SELECT doc_id, 0 AS level, given AS acc FROM p
  UNION ALL
  SELECT f.doc_id, f.level + 1, sha256(CASE WHEN c.proof[f.level + 1].ahead THEN acc || c.proof[f.level + 1].other ELSE c.proof[f.level + 1].other || acc END)
  FROM f JOIN c USING (doc_id) WHERE f.level < len(c.proof)),
g AS (SELECT doc_id, arg_max(acc, level) AS folded_root FROM f GROUP BY doc_id)
SELECT p.doc_id, p.leaf, s.subroot, r.root,
  sha256(coalesce(array_to_string(list_transform(c.proof, lambda x: x.other), ''), '')) AS proof_sha256, g.folded_root, g.folded_root = r.root AS verified
FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang JOIN g ON g.doc_id = p.doc_id LEFT JOIN c ON c.doc_id = p.doc_id, r
"""


@query("op11_merkle_manifest", OP11_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    from quillspark.llm.merkle import audit

    return audit(table(spark, folder, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)


OP12_SQL = f"""
WITH x AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {WORDS_SQL.format("coalesce(text, '')")} AS w FROM documents),
d AS (
  SELECT part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
    100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(x.doc_id > min(x.doc_id) OVER (PARTITION BY text), false) AS e,
    coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic
  FROM x LEFT JOIN labels l ON l.doc_id = x.doc_id),
m AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n,
    count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM d GROUP BY 1, 2),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
  SELECT f1.letter || f2.letter || f3.letter || f4.letter || f5.letter AS filter_order, [f1.bit, f2.bit, f3.bit, f4.bit, f5.bit] AS bits
  FROM f f1, f f2, f f3, f f4, f f5
  WHERE (f1.bit | f2.bit | f3.bit | f4.bit | f5.bit) = 31),
t AS (
  SELECT filter_order, step, bits[step] AS this, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS seen
  FROM o, (SELECT unnest(range(1, 6)) AS step)),
k AS (
  SELECT part, filter_order, step, this,
    coalesce(sum(n) FILTER (WHERE mask & (seen | this) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (WHERE mask & this <> 0 AND mask & seen = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE mask & this <> 0 AND mask & seen <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (WHERE mask = this), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE mask & this <> 0 AND mask & seen = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE mask & this <> 0 AND mask & seen = 0), 0)::BIGINT AS toxic_lost
  FROM m, t GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, this))::BIGINT AS shapley
FROM k
"""


@query("op12_filter_interaction", OP12_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    from quillspark.llm.interaction import filter_audit

    return filter_audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


#: A control string's first character, backslashes and the rest of it.
CONTROL_SQL = r"""'(<)(\\*)(s>|/s>|<SYS>>|</SYS>>)|(\[)(\\*)(INST\]|/INST\]|ROLE\]|/ROLE\])'"""


def escaped_sql(text: str) -> str:
    return rf"regexp_replace({text}, {CONTROL_SQL}, '\1\4\\\2\5\3\6', 'g')"


OP13_SQL = rf"""
WITH a AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
b AS (
  SELECT *, md5(text) AS tie, length({escaped_sql("text")}) + CASE role WHEN 'user' THEN 16 WHEN 'system' THEN 18
    WHEN 'assistant' THEN 7 ELSE 20 + length({escaped_sql("role")}) END AS chars FROM a)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, tie)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, tie) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM b GROUP BY conv_id
"""


@query("op13_chat_format", OP13_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and conversation -1, whose texts hold control strings."""
    from quillspark.llm.chat import format_chats, read_back

    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said)
    return read_back(format_chats(given.union(own)))
