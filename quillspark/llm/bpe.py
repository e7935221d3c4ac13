"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

Encoding. Two tokens are *compatible* if merging the bytes of both, lowest rank first, ends
in just these two. Every prefix of a piece then has one last token: the longest that is
compatible with the last token of what precedes it. A step reads a byte. Only positions from
which a vocabulary token may still reach beyond the bytes read can matter later; a state is
the token written last and, for each of these positions, the tokens that lead to it. Tokens
on which all of them agree are written, so the lookahead is at most the longest token. States and steps are made when first met, kept, and
forgotten together when there are too many.

Decoding walks a UTF-8 state machine whose states are the bytes of an unfinished character
(at most three) and whose steps read whole tokens; ill-formed bytes become U+FFFD.
"""

from __future__ import annotations

import base64
import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import kept_by_worker

#: Bounds on what a worker remembers.
STATES, PIECES, PAIRS = 150_000, 200_000, 300_000
_END = (((), 0),)
MARKED = object()


class State(dict):
    """Steps by byte: tokens written and the next state.

    ``live``: for every position that a token may still start from and reach beyond what was
    read, the tokens up to it that are not written yet and the trie node of the bytes since;
    the last is the end."""

    __slots__ = ("prev", "live")

    def __init__(self, prev: int, live: tuple):
        self.prev, self.live = prev, live


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.start = max(self.tokens) + 1  # stands before the first token of a piece
        self.trie: dict[int, int] = {}
        self.ends, self.more = [-1], bytearray(1)
        for token, i in ranks.items():
            node = 0
            for byte in token:
                self.more[node] = 1
                child = self.trie.get(node << 8 | byte)
                if child is None:
                    child = self.trie[node << 8 | byte] = len(self.ends)
                    self.ends.append(-1)
                    self.more.append(0)
                node = child
            self.ends[node] = i
        self.pairs: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, State] = {}
        self.root = self._state(self.start, (((), 0),))

    def merged(self, piece: bytes) -> list[int]:
        """Merges of a short piece, always the lowest-ranked neighbours first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))  # noqa: B905
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            whole = [right] if left == self.start else [left, right]
            known = self.pairs[key] = self.merged(b"".join(self.tokens[t] for t in whole)) == whole
        return known

    def _state(self, prev: int, live: tuple) -> State:
        found = self.states.get((prev, live))
        if found is None:
            found = self.states[prev, live] = State(prev, live)
        return found

    def _step(self, prev: int, live: tuple, byte: int) -> tuple[tuple[int, ...], int, tuple]:
        """What a byte writes, and the token written last and the open starts after it."""
        child_of, ends, more, known = self.trie.get, self.ends, self.more, self.pairs.get
        after, end = [], None
        for chain, node in live:
            child = child_of(node << 8 | byte)
            if child is None:
                continue
            if end is None:
                token = ends[child]
                if token >= 0:
                    left = chain[-1] if chain else prev
                    ok = known(left << 32 | token)
                    if ok or ok is None and self.compatible(left, token):
                        end = (*chain, token)
            if more[child]:
                after.append((chain, child))
        if not after:
            return end, end[-1], _END
        sure = 0
        if after[0][0]:  # the earliest start has the shortest path
            sure = len(after[0][0])
            for chain, _ in (*after, (end, 0)):
                while chain[:sure] != end[:sure]:
                    sure -= 1
        after.append((end, 0))
        if not sure:
            return (), prev, tuple(after)
        return end[:sure], end[sure - 1], tuple([(chain[sure:], node) for chain, node in after])

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """A step met for the first time is only marked, and the rest of the piece is read without
        states; met again it becomes a state. So states are the beginnings that pieces share."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        if len(self.states) > STATES:
            for state in self.states.values():
                state.clear()  # states refer to each other
            self.reset()
        state, out = self.root, []
        for at, byte in enumerate(piece):
            step = state.get(byte, MARKED)
            if step is MARKED:
                state[byte] = None
                prev, live = state.prev, state.live
                for rest in piece[at:]:
                    done, prev, live = self._step(prev, live, rest)
                    if done:
                        out += done
                return (*out, *live[-1][0])
            if step is None:
                done, prev, live = self._step(state.prev, state.live, byte)
                step = state[byte] = done, self._state(prev, live)
            done, state = step
            if done:
                out += done
        return (*out, *state.live[-1][0])


class Pieces(dict):
    """Ids of pieces met before, in two generations: what is met again outlives the older one."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer, self.older = transducer, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        out = self.older.get(piece)
        if out is None:
            out = self.transducer.encode(piece.encode())
        if len(piece) <= 64:
            if len(self) >= PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = out
        return out


def _next(state: tuple, byte: int):
    """UTF-8: ranges that the next bytes of a character must lie in; None where ill-formed."""
    if state:
        return state[1:] if state[0][0] <= byte <= state[0][1] else None
    more = (0x80, 0xBF)
    if byte < 0x80:
        return ()
    if 0xC2 <= byte <= 0xDF:
        return (more,)
    if 0xE0 <= byte <= 0xEF:
        return ({0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F)}.get(byte, more), more)
    if 0xF0 <= byte <= 0xF4:
        return ({0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(byte, more), more, more)
    return None


class Decoder:
    """Incremental: ``feed`` ids as they come, ``close`` at the end."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens, self.tables, self.start = tokens, {}, None
        self.start = self.table = self._table(b"")

    def _table(self, pending: bytes):
        if pending not in self.tables:
            self.tables[pending] = _Table(self, pending)
        return self.tables[pending]

    def step(self, pending: bytes, read: bytes) -> tuple[str, bytes]:
        out, begun, state = [], b"", ()
        for byte in pending + read:
            step = _next(state, byte)
            if step is None:
                if begun:
                    out.append("�")
                    begun, step = b"", _next((), byte)
                if step is None:
                    out.append("�")
                    begun, state = b"", ()
                    continue
            begun += bytes((byte,))
            state = step
            if not state:
                out.append(begun.decode())
                begun = b""
        return "".join(out), begun

    def feed(self, ids: Iterable[int]) -> str:
        table, out = self.table, []
        for i in ids:
            text, table = table[i]
            out.append(text)
        self.table = table
        return "".join(out)

    def close(self) -> str:
        left, self.table = self.table.pending, self.start
        return "�" if left else ""


class _Table(dict):
    def __init__(self, decoder: Decoder, pending: bytes):
        super().__init__()
        self.decoder, self.pending = decoder, pending

    def __missing__(self, token: int):
        text, pending = self.decoder.step(self.pending, self.decoder.tokens[token])
        self[token] = out = (text, self.decoder._table(pending))
        return out


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@kept_by_worker
def machinery(path: str, pattern: str):
    transducer = Transducer(load_ranks(path))
    return regex.compile(pattern).findall, Pieces(transducer), Decoder(transducer.tokens)


def encode_text(text: str, path: str, pattern: str) -> list[int]:
    pieces, known, _ = machinery(path, pattern)
    out: list[int] = []
    for piece in pieces(text):
        out += known[piece]
    return out


def decode_ids(ids: Iterable[int], path: str, pattern: str) -> str:
    decoder = machinery(path, pattern)[2]
    return decoder.feed(ids) + decoder.close()


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str | None = None
) -> DataFrame:
    """Token ids of every whole text: doc_id, ids.

    ``ids`` is binary: ids as little-endian unsigned 32-bit integers, one after the other. A
    null text counts as empty and has none. Every row is encoded by itself, so null ids and
    repeated rows stay as they are, and other columns are not looked at. ``ranks`` is a rank
    file every worker can open; special tokens are ordinary text.
    """
    path, split = default_vocabulary()
    path, split = ranks or path, pattern or split

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ident, ids in _encoded(batches, path, split):
            yield pa.record_batch([ident, _packed(ids)], names=["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        fn, f"doc_id {kind}, ids binary"
    )


def _encoded(batches: Iterator[pa.RecordBatch], path: str, split: str) -> Iterator[tuple[pa.Array, list[list[int]]]]:
    """(first column, ids) of slices of (id, text)."""
    gc.disable()  # the many small objects kept hold no cycles but those of states
    try:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield part.column(0), [encode_text(t.as_py() or "", path, split) for t in part.column(1)]
    finally:
        gc.enable()  # the worker goes on to other tasks


def _packed(ids: list[list[int]]) -> pa.Array:
    return pa.array([np.array(x, "<u4").tobytes() for x in ids], pa.binary())


def round_trip(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str | None = None
) -> DataFrame:
    """doc_id, ids, decoded: ``encode`` and ``decode`` in one worker, for one copy of the vocabulary."""
    path, split = default_vocabulary()
    path, split = ranks or path, pattern or split

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ident, ids in _encoded(batches, path, split):
            texts = pa.array([decode_ids(x, path, split) for x in ids], pa.string())
            yield pa.record_batch([ident, _packed(ids), texts], names=["doc_id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        fn, f"doc_id {kind}, ids binary, decoded string"
    )


def decode(encoded: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """Texts of packed ids: doc_id, ids, decoded. Null ids count as none."""
    path, split = default_vocabulary()
    path, split = ranks or path, pattern or split

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [decode_ids(np.frombuffer(x.as_py() or b"", "<u4").tolist(), path, split) for x in part.column(1)]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(fn, f"doc_id {kind}, ids binary, decoded string")
