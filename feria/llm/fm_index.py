"""A compressed FM-index over short word sequences: a wavelet matrix with packed bits for backward search.

The order of the suffixes is needed to build the matrix and is not kept: of each suffix one bit stays, whether its sequence
stands for more than one. All searches advance together: a step takes one symbol further to the left in each of many
patterns.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes in the order of their first `depth` symbols (a power of two or more), by doubling."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    k = 1
    while k < depth and n > 1:
        after = np.zeros(n, np.int64)
        after[: max(n - k, 0)] = rank[k:] + 1
        pair = rank * (n + 1) + after
        order = np.argsort(pair, kind="stable")
        ordered = pair[order]
        new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            break
        k *= 2
    return order


class Bits:
    """A bit vector of 64-bit words with the ones counted before each word."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(np.append(bits, np.zeros(-len(bits) % 64 + 64, bool)), bitorder="little")
        self.words = packed.view("<u8").astype(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.int32)

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class FMIndex:
    """Index of a text of symbols 0 to size - 1, with a mark (a boolean) at each place or none. Patterns up to `depth` symbols
    are found exactly."""

    def __init__(self, text: np.ndarray, size: int, depth: int = 64, marks: np.ndarray | None = None) -> None:
        order = suffix_order(text, depth)
        self.marks = Bits(marks[order]) if marks is not None else None
        last = text[order - 1]  # the symbol before each suffix, cyclic
        del order
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))]).astype(np.int64)
        self.levels, self.shifts = [], range(max(1, int(size - 1).bit_length()) - 1, -1, -1)
        symbols = np.arange(size)
        first = np.zeros(size, np.int64)
        for shift in self.shifts:
            ones = ((last >> shift) & 1).astype(bool)
            bits, zeros = Bits(ones), int(len(last) - ones.sum())
            self.levels.append((bits, zeros))
            first = self._down(bits, zeros, first, (symbols >> shift) & 1)
            last = np.concatenate([last[~ones], last[ones]])
        self.shift_of = self.starts[:-1] - first

    @staticmethod
    def _down(bits: Bits, zeros: int, at: np.ndarray, one: np.ndarray) -> np.ndarray:
        ones = bits.ones(at)
        return np.where(one == 1, zeros + ones, at - ones)

    def single(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of one-symbol patterns."""
        return self.starts[c], self.starts[c + 1]

    def extend(self, lo: np.ndarray, hi: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with a symbol put before them."""
        n = len(lo)
        at, cc = np.concatenate([lo, hi]), np.concatenate([c, c])
        for (bits, zeros), shift in zip(self.levels, self.shifts):
            at = self._down(bits, zeros, at, (cc >> shift) & 1)
        at = at + self.shift_of[cc]
        return at[:n], at[n:]


def repeated_ends(index: FMIndex, text: np.ndarray, begin: np.ndarray, windows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each sequence text[begin : begin + windows + width - 1], the first and the last of its windows of `width`
    symbols that occur at least twice in the text or once in a sequence that the index has marked (-1, -1: none).

    This is what matching statistics say where they reach `width`: a window is read from its right end; where the part read
    so far occurs once only, every window that holds this part is out, so the search for the first goes on behind the part's
    start, and that for the last one window to the left.
    """
    n = len(begin)
    first, last = np.full(n, -1), np.full(n, -1)

    def twice(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        count = hi - lo
        ok = count >= 2
        one = np.flatnonzero(count == 1)
        ok[one] = index.marks.get(lo[one])
        return ok

    for found, forward in ((first, True), (last, False)):
        who = np.arange(n) if forward else np.flatnonzero(first >= 0)
        s = np.zeros(len(who), np.int64) if forward else windows[who] - 1
        right = begin[who] + s + width - 1
        at = right.copy()
        lo, hi = index.single(text[at])
        while len(who):
            ok = twice(lo, hi)
            done = ok & (at == begin[who] + s)
            found[who[done]] = s[done]
            miss = ~ok
            s = np.where(miss, (at - begin[who] + 1) if forward else s - 1, s)
            out = done | (miss & ((s >= windows[who]) if forward else (s < first[who])))
            keep = np.flatnonzero(~out)
            who, s, at, lo, hi, miss = who[keep], s[keep], at[keep], lo[keep], hi[keep], miss[keep]
            again, on = np.flatnonzero(miss), np.flatnonzero(~miss)
            at[again] = begin[who[again]] + s[again] + width - 1
            lo[again], hi[again] = index.single(text[at[again]])
            at[on] -= 1
            lo[on], hi[on] = index.extend(lo[on], hi[on], text[at[on]])
    return first, last
