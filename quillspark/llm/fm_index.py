"""FM-index over word sequences: bounded suffix order, wavelet matrix, backward search."""

from __future__ import annotations

import numpy as np


#: The lowest k bits set.
_LOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class Bits:
    """A bit vector with rank: packed words and the ones before each."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        packed = np.append(packed, np.zeros(8 + -len(packed) % 8, np.uint8))
        self.words = packed.view(np.uint64)
        self.before = np.append(0, np.bitwise_count(self.words).astype(np.int64).cumsum()[:-1])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        return self.before.take(word) + np.bitwise_count(self.words.take(word) & _LOW.take(at & 63))


class Wavelet:
    """Wavelet matrix over integers below 2**levels."""

    def __init__(self, x: np.ndarray, levels: int):
        self.rows = []
        for level in range(levels - 1, -1, -1):
            bit = (x >> level) & 1
            self.rows.append((level, Bits(bit.astype(np.uint8)), int((bit == 0).sum())))
            x = np.concatenate([x[bit == 0], x[bit == 1]])

    def place(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Start of c's run in the last level plus its occurrences before each place."""
        for level, bits, zeros in self.rows:
            one = bits.ones(at)
            at = np.where(c & (1 << level), one + zeros, at - one)
        return at


class FmIndex:
    """Index of texts joined by separators 0; matches of up to ``depth`` words are exact.

    ``weight`` of a text says how often it stands in the collection.
    """

    def __init__(self, text: np.ndarray, weight: np.ndarray, depth: int):
        n = len(text)
        rank = text.astype(np.int64)
        have = 1
        while have < depth:
            by = min(have, depth - have)
            after = np.zeros(n, np.int64)
            after[: n - by] = rank[by:]
            _, rank = np.unique(rank * (int(rank.max()) + 2) + after + 1, return_inverse=True)
            have += by
        order = np.argsort(rank, kind="stable")
        self.total = np.append(0, weight[order].cumsum())
        last = text[order - 1]
        size = int(text.max()) + 1
        self.wavelet = Wavelet(last, max(1, size.bit_length()))
        symbols = np.arange(size)
        starts = np.append(0, np.bincount(text, minlength=size).cumsum()[:-1])
        self.shift = starts - self.wavelet.place(symbols, np.zeros(size, np.int64))
        self.n = n

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of matches with one more word in front."""
        k = len(c)
        both = self.wavelet.place(np.concatenate([c, c]), np.concatenate([lo, hi]))
        return self.shift[c] + both[:k], self.shift[c] + both[k:]

    def weight(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return self.total[hi] - self.total[lo]


PROBE = 7


def repeated_windows(
    texts: list[np.ndarray], weight: np.ndarray, window: int, searched: np.ndarray | None = None
) -> list[np.ndarray]:
    """For every text, which of its windows stand at least twice in the weighted collection.

    Texts that are not to be ``searched`` are known to be repeated as a whole.

    Texts (arrays of positive integers) are streamed through backward search. From an end e
    a match grows leftwards while it stands at least twice; where it stops, at p, all windows
    inside the match are repeated and none that holds both p and e is. The search goes on
    from the last end that a window starting at p can have. As a stop is mostly due to the
    word at p, a short probe from a little behind p is tried first; if it stops at p too,
    all windows over p and the probe are out at once.
    """
    length = np.array([len(t) for t in texts], np.int64)
    start = np.append(0, (length + 1).cumsum()[:-1])
    flat = np.zeros(int((length + 1).sum()), np.int64)
    for t, s in zip(texts, start, strict=True):
        flat[s : s + len(t)] = t
    index = FmIndex(flat, np.repeat(weight, length + 1), int(length.max()) + 1)
    marks = np.zeros(len(flat) + 1, np.int64)  # +1 where a run of repeated windows begins, -1 behind it

    def mark(seg, first, last):
        ok = first <= last
        np.add.at(marks, start[seg[ok]] + first[ok], 1)
        np.add.at(marks, start[seg[ok]] + last[ok] + 1, -1)

    whole = (length >= window) & ~(np.ones(len(length), bool) if searched is None else searched)
    known = np.flatnonzero(whole)
    mark(known, np.zeros(len(known), np.int64), length[known] - window)
    seg = np.flatnonzero((length >= window) & ~whole)
    end = length[seg] - 1
    at, limit, saved, stop = end.copy(), end - window + 1, end.copy(), np.full(len(seg), -1)
    probing = np.zeros(len(seg), bool)
    lo, hi = np.zeros(len(seg), np.int64), np.full(len(seg), index.n)
    while len(seg):
        lo2, hi2 = index.extend(flat[start[seg] + at], lo, hi)
        ok = index.weight(lo2, hi2) >= 2
        lo, hi, at = np.where(ok, lo2, lo), np.where(ok, hi2, hi), at - ok
        # a probe that passes the stop says nothing: search in full
        passed = ok & probing & (at < stop)
        done = ok & ~probing & (at < 0)
        mark(seg[done], np.zeros(int(done.sum()), np.int64), np.minimum(limit, end - window + 1)[done])
        failed = ~ok
        mark(seg[failed], at[failed] + 1, np.minimum(limit, end - window + 1)[failed])
        limit = np.where(failed, np.minimum(limit, at), limit)
        follow = np.minimum(end - 1, limit + window - 1)
        probe = failed & ~probing & (at + PROBE < follow) & (at != stop)
        new = np.where(passed, saved, np.where(probe, at + PROBE, follow))
        stop = np.where(probe, at, stop)
        saved = np.where(probe, follow, saved)
        probing = np.where(failed, probe, probing & ~passed)
        again = failed | passed
        end = np.where(again, new, end)
        at = np.where(again, end, at)
        lo, hi = np.where(again, 0, lo), np.where(again, index.n, hi)
        limit = np.where(again & ~probing, np.minimum(limit, end - window + 1), limit)
        live = ~done & ((end >= window - 1) | probing)
        seg, end, at, limit, saved, stop, probing, lo, hi = (x[live] for x in (seg, end, at, limit, saved, stop, probing, lo, hi))
    depth = marks.cumsum()
    return [depth[s : s + max(0, n - window + 1)] > 0 for s, n in zip(start, length, strict=True)]
