"""SQL fragments shared by the checks."""

from __future__ import annotations

from quillspark.functions import text as tx

STOP = ["the", "and", "of", "for", "that", "with", "by", "this", "in", "on", "is", "as", "at", "to", "it", "are", "was", "be", "la", "de", "un", "der", "die"]
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def h(seed: str, *keys: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(keys)}))"


def h32(seed: str, *keys: str) -> str:
    return f"('0x' || substr({h(seed, *keys)}, 1, 8))::BIGINT"


def size_of_sample(seed: str, n: str, *keys: str) -> str:
    high = f"greatest(1, floor(0.3::DOUBLE * ({n}))::BIGINT)"
    return f"(CASE WHEN ({n}) > 0 THEN 1 + {h32(seed, *keys)} % {high} ELSE 0 END)"


def shuffle_of(seed: str, xs: str, *keys: str) -> str:
    return (
        f"list_transform(list_sort(list_transform({xs}, lambda x: {h(seed, *keys, 'x')} || x)), "
        "lambda s: substr(s, 33))"
    )


def sample_of(seed: str, xs: str, *keys: str) -> str:
    """Random subset of distinct strings."""
    return f"({shuffle_of(seed, xs, *keys)})[1:{size_of_sample(seed + 'k', f'len({xs})', *keys)}]"


def pick_of(seed: str, xs: str, key: str) -> str:
    """Random subset by position."""
    mixed = (
        f"list_transform(list_sort(list_transform({xs}, lambda x, i: {h(seed, key, 'i')} || x)), "
        "lambda s: substr(s, 33))"
    )
    return f"({mixed})[1:{size_of_sample(seed + 'k', f'len({xs})', key)}]"


def words(t: str) -> str:
    return f"list_filter(regexp_split_to_array({t}, '[{tx.SPACE}]+'), lambda w: w <> '')"


def tokens(t: str) -> str:
    return f"regexp_extract_all({t}, {quoted(tx.TOKEN)})"


def lower_words(t: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({t}), '{tx.WORD}'))"


def clean(t: str) -> str:
    pattern = quoted(f"[^{tx.KEPT}{tx.SPACE}]")
    out = f"regexp_replace({t}, {pattern}, '', 'g')"
    for old, new in (("chr(10)", "' '"), ("chr(9)", "' '"), ("'  '", "' '"), ("'''s'", "''"), (r"'\n'", "' '"), (r"'\t'", "' '")):
        out = f"replace({out}, {old}, {new})"
    return out


def strip(t: str) -> str:
    return f"regexp_replace({t}, '^[{tx.SPACE}]+|[{tx.SPACE}]+$', '', 'g')"


def sentences(t: str) -> str:
    return (
        f"list_filter(string_split(regexp_replace({t}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), "
        "lambda s: trim(s) <> '')"
    )


def answer(t: str, strict: bool) -> str:
    pieces = f"string_split({t}, ':')"
    found = (
        f"(list_filter(string_split({pieces}[2], chr(10) || chr(10)), lambda p: {strip('p')} <> ''))[1]"
    )
    plain = "NULL" if strict else f"nullif({t}, '')"
    return f"(CASE WHEN len({pieces}) > 1 THEN {found} ELSE {plain} END)"


def tidy(t: str) -> str:
    return strip(f"replace(replace({t}, '\"', ''), chr(10), '')")


def response(t: str = "text", key: str = "conv_id") -> str:
    """A generator-like answer made of a conversation turn."""
    return (
        f"(CASE {key} % 4 WHEN 0 THEN {t} WHEN 1 THEN 'Sure:' || replace({t}, chr(10), chr(10) || chr(10)) "
        f"WHEN 2 THEN 'Title: ' || chr(10) || chr(10) || {t} || ' Note: more' ELSE 'Nothing: ' END)"
    )
