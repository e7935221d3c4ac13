"""Chat formatting: conversations as text, token ids and a loss mask over the assistant's words.

A turn is ``<s>``, its role's opening, its text and its closing:

    user       <s>[INST]text[/INST]
    system     <s><<SYS>>text<</SYS>>
    assistant  <s>text</s>
    any other  <s>[ROLE]role[/ROLE]text</s>

These strings are control strings, each a single token beyond the vocabulary. Inside a text (or
a role) a control string gets a backslash after its first character, and so does one that already
has backslashes there; reading back takes one away. So the formatted text parses in one way only.

A conversation is rendered as a whole and encoded once. Token spans are running sums of the
tokens' byte lengths; turn spans are sorted byte spans of the texts; a binary search of token
spans among turn spans gives each token its turn, and with it the mask.

Rows are dealt by range of (conversation, ``TURNS`` turns), so a conversation is a run of rows in
one task or, if it has more turns, in several. A run over ``piece`` characters is cut between turns;
since every turn starts with a control string, the ids of the pieces are those of the whole.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Sequence
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

START, END = "<s>", "</s>"
USER, USER_END = "[INST]", "[/INST]"
SYSTEM, SYSTEM_END = "<<SYS>>", "<</SYS>>"
ROLE, ROLE_END = "[ROLE]", "[/ROLE]"
CONTROLS = (START, END, USER, USER_END, SYSTEM, SYSTEM_END, ROLE, ROLE_END)

#: Turn numbers of a conversation that are dealt to one task.
TURNS = 256
#: Characters of a piece, not counting its last turn.
PIECE = 1 << 20
#: Characters that one result batch holds, about.
BATCH = 1 << 21

_RAW = re.compile("|".join(rf"({re.escape(c[0])})(\\*)({re.escape(c[1:])})" for c in CONTROLS))
_CUT = re.compile("|".join(rf"{re.escape(c[0])}\\+{re.escape(c[1:])}" for c in CONTROLS))


def escape(text: str) -> str:
    return _RAW.sub(lambda m: m[0][0] + "\\" + m[0][1:], text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _CUT.sub(lambda m: m[0][0] + m[0][2:], text) if "\\" in text else text


def render(role: str, text: str) -> tuple[str, str, str]:
    """What stands before the text of a turn, the text escaped, and what stands after it."""
    text = escape(text)
    if role == "user":
        return START + USER, text, USER_END
    if role == "system":
        return START + SYSTEM, text, SYSTEM_END
    if role == "assistant":
        return START, text, END
    return START + ROLE + escape(role) + ROLE_END, text, END


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn at {at}")
        at += len(START)
        role, end = "assistant", END
        if formatted.startswith(USER, at):
            role, end, at = "user", USER_END, at + len(USER)
        elif formatted.startswith(SYSTEM, at):
            role, end, at = "system", SYSTEM_END, at + len(SYSTEM)
        elif formatted.startswith(ROLE, at):
            upto = formatted.index(ROLE_END, at)
            role, at = unescape(formatted[at + len(ROLE) : upto]), upto + len(ROLE_END)
        upto = formatted.index(end, at)
        turns.append((role, unescape(formatted[at:upto])))
        at = upto + len(end)
    return turns


class Encoder:
    """Ids and byte lengths of tokens, control strings being tokens of their own."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        top = max(ranks.values()) + 1
        special = {c: top + i for i, c in enumerate(CONTROLS)}
        self.pieces, self.special = regex.compile(pattern), special
        self.split = re.compile("(" + "|".join(map(re.escape, CONTROLS)) + ")")
        self.model = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.lengths = np.zeros(top + len(special), np.int64)
        for token, rank in [*ranks.items(), *((c.encode(), i) for c, i in special.items())]:
            self.lengths[rank] = len(token)

    def encode(self, text: str) -> np.ndarray:
        try:
            return np.asarray(self.model.encode_to_numpy(text, allowed_special="all"), np.uint32)
        except ValueError:  # its regular expression gives up on very long runs of blanks; same pieces, cut by another engine
            ids: list[int] = []
            for i, part in enumerate(self.split.split(text)):
                if i % 2:
                    ids.append(self.special[part])
                    continue
                for m in self.pieces.finditer(part):
                    ids.extend(self.model._encode_single_piece(m[0]))
            return np.array(ids, np.uint32)


def token_turns(lengths: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte span of every token and the turn whose text span it lies in, -1 for none.

    ``starts`` and ``ends`` are the sorted byte spans of the turns' texts.
    """
    end = np.cumsum(lengths)
    start = end - lengths
    turn = np.searchsorted(starts, start, side="right") - 1
    inside = (turn >= 0) & (end <= np.append(ends, 0)[turn])
    return start, end, np.where(inside, turn, -1)


#: Arrow types of what ``format_chats`` gives beside the conversation.
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32())]


def ordered(rows: DataFrame) -> DataFrame:
    """``rows`` (conv, turn, role, text) with part, so that rows of a conversation are neighbours, in order."""
    rows = rows.withColumn("block", F.floor(F.col("turn") / TURNS)).withColumn("tie", F.md5(F.col("text").cast("binary")))
    conv = F.col("conv").asc_nulls_first()
    dealt = rows.repartitionByRange(conv, F.col("block").asc_nulls_first())
    dealt = dealt.sortWithinPartitions(conv, F.col("turn").asc_nulls_first(), "role", "tie")
    return dealt.select("conv", "role", "text", F.spark_partition_id().alias("part"))


def format_chats(
    conversations: DataFrame, tokens_file: str | None = None, pattern: str | None = None,
    id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    piece: int = PIECE,
) -> DataFrame:
    """conv_id, piece, n_turns, formatted, ids, loss_tokens, loss_bytes: a row per conversation.

    Turns stand by number (null first), then role, then md5 of the text; equal rows are turns of
    their own. A null text or role is empty; rows without conversation id are one conversation,
    with a null id. ``ids`` are little-endian unsigned 32-bit integers by the ranks in
    ``tokens_file``, control strings following the vocabulary. ``loss_tokens`` are runs of tokens
    under the mask, first and end in turn, and ``loss_bytes`` the bytes of ``formatted`` that
    these runs cover; both hold the assistant's texts and nothing else, in order, and an empty
    text has no run. A conversation of more than ``piece`` characters or dealt over tasks has a row for each
    piece, in the order of ``piece``, whose texts and ids follow each other. Other columns are
    not looked at. An empty table has no rows.
    """
    if tokens_file is None or pattern is None:
        import public_tokenizers

        tokens_file = tokens_file or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
        pattern = pattern or public_tokenizers.PATTERN
    spark = conversations.sparkSession
    shared = ranks_of(spark, tokens_file)
    rows = conversations.select(
        F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches := iter(batches), None)
        if first is None:
            return
        encoder, kind = Encoder(shared.value, pattern), first.column(0).type
        held: list[tuple] = []
        weight = 0
        for part, seq, conv, turns in pieces(chain([first], batches), piece):
            held.append((conv, part, seq, *formatted(turns, encoder)))
            weight += sum(len(text) for _, text in turns)
            if weight > BATCH:
                yield batch_of(held, [kind, *KINDS], names)
                held, weight = [], 0
        if held:
            yield batch_of(held, [kind, *KINDS], names)

    ddl = "part long, seq long, n_turns long, formatted string, ids binary, loss_tokens array<int>, loss_bytes array<int>"
    schema = StructType([StructField("conv_id", conversations.schema[id_col].dataType), *StructType.fromDDL(ddl).fields])
    names = schema.names
    out = ordered(rows).mapInArrow(fn, schema)
    return out.select("conv_id", F.struct("part", "seq").alias("piece"), *names[3:])


def ranks_of(spark: SparkSession, tokens_file: str):
    with open(tokens_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return spark.sparkContext.broadcast(ranks)


def pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, int, object, list[tuple[str, str]]]]:
    """(part, number, conversation, turns) of runs of rows of one conversation, cut beyond ``most`` characters."""
    now, turns, size, seq, part = None, [], 0, 0, 0
    for b in batches:
        for conv, role, text, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if turns and (conv != now or size > most):
                yield part, seq, now, turns
                turns, size, seq = [], 0, seq + 1
            now = conv
            turns.append((role, text))
            size += len(text)
    if turns:
        yield part, seq, now, turns


def formatted(turns: Sequence[tuple[str, str]], encoder: Encoder) -> tuple:
    """n_turns, formatted, ids, loss_tokens and loss_bytes of the turns of a piece."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        lead, body, tail = render(role, text)
        parts += [lead, body, tail]
        first = at + len(lead.encode())
        last = first + len(body.encode())
        spans.append((first, last, role == "assistant"))
        at = last + len(tail.encode())
    whole = "".join(parts)
    ids = encoder.encode(whole)
    starts, ends, wanted = (np.array(x) for x in zip(*spans, strict=True))
    start, end, turn = token_turns(encoder.lengths[ids], starts, ends)
    mask = (turn >= 0) & wanted[turn]
    # runs of tokens of one turn
    edge = np.flatnonzero(np.diff(np.where(mask, turn, -1), prepend=-1, append=-1))
    first = edge[np.append(mask, False)[edge]]
    last = edge[np.insert(mask, 0, False)[edge]]
    tokens = np.stack([first, last], 1).ravel().astype(np.int32)
    covered = np.stack([start[first], end[last - 1]], 1).ravel().astype(np.int32)
    return len(turns), whole, ids.astype("<u4").tobytes(), tokens, covered


def batch_of(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the formatted output alone.

    Turns are parsed out of ``formatted``; the text under the mask is cut out by ``loss_bytes``
    and unescaped run by run. Pieces are read in parallel; then their bytes go to the running
    digests of their conversation, in order, a batch at a time.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            turns, losses, sizes, counts = [], [], [], []
            for text, spans in zip(b.column("formatted").to_pylist(), b.column("loss_bytes").to_pylist(), strict=True):
                raw = text.encode()
                said = parse(text)
                counts.append(len(said))
                turns.append("".join(f"{role}\n{body}\n" for role, body in said))
                losses.append("".join(unescape(raw[i:j].decode()) for i, j in zip(spans[::2], spans[1::2], strict=True)))
                sizes.append(len(text))
            columns = [b.column("conv_id"), b.column("piece"), pa.array(counts, pa.int64()), pa.array(turns, pa.string()), pa.array(losses, pa.string()), pa.array(sizes, pa.int64())]
            yield pa.record_batch(columns, names=["conv_id", "piece", "n_turns", "turns", "loss", "chars"])

    ident, piece = chats.schema["conv_id"], chats.schema["piece"]
    said = StructType([ident, piece, *StructType.fromDDL("n_turns long, turns string, loss string, chars long").fields])
    read = chats.select("conv_id", "piece", "formatted", "loss_bytes").mapInArrow(unpack, said)
    dealt = read.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "piece")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, now = None, None
        for b in batches:
            kinds = [b.column("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            done = []
            values = (b.column(c).to_pylist() for c in ("conv_id", "n_turns", "turns", "loss", "chars"))
            for conv, n, turns, loss, chars in zip(*values, strict=True):
                if state is not None and conv != now:
                    done.append(closed(now, state))
                    state = None
                if state is None:
                    state, now = [0, sha256(), 0, sha256(), 0], conv
                state[0] += n
                state[1].update(turns.encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += chars
            if done:
                yield batch_of(done, kinds, out.names)
        if state is not None:
            yield batch_of([closed(now, state)], kinds, out.names)

    digests = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    out = StructType([ident, *StructType.fromDDL(digests).fields])
    return dealt.mapInArrow(digest, out)


def closed(conv, state: list) -> tuple:
    n, turns, chars, loss, size = state
    return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size
