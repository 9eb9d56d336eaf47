"""Simple-8b token files: many ids to a 64-bit word, in blocks that decode on their own.

A word holds a selector in its top 4 bits and a payload below it:

* selector 0: escape; the next word is one raw 64-bit value (for values of 2**60 or more)
* selector 1: a run of 120 zeros
* selectors 2 to 15: as many equal-width values as the table below says, the first in the lowest bits

A block holds ``BLOCK`` ids (the last one of a file fewer); its last word may be padded with zeros, which the
block's own count cuts off. A file is the magic, the words of all blocks, the block table, the document table and a
fixed-size tail, so it is written in one pass and read by block.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

BLOCK = 4096
MAGIC, END = b"S8TOKEN1", b"S8TOKEND"
#: Values in a word and bits of each, for selectors 2 to 15.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ZEROS = 120
_TAIL = struct.Struct("<QQQ8s")


def bit_lengths(v: np.ndarray) -> np.ndarray:
    """Bits that each value takes; a value that a double rounds up to a power of two may count as one more."""
    return np.frexp(v.astype(np.float64))[1].astype(np.uint8)


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all blocks of a run of ids, and the number of words of each block."""
    n = len(values)
    blocks = -(-n // BLOCK)
    if not blocks:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    v = np.zeros((blocks, BLOCK + ZEROS), np.uint64)
    v[:, :BLOCK].flat[:n] = values
    bits = bit_lengths(v)
    need = bits
    span, choice = 1, np.zeros(v.shape, np.uint8)  # 0: escape
    widest = {1: bits}
    for c, w, sel in sorted([*zip(COUNTS.tolist(), WIDTHS.tolist(), range(2, 16)), (ZEROS, 0, 1)]):
        if c > 1:
            half = max(k for k in widest if k * 2 >= c and k < c or k == span)
            need = widest[half].copy()
            np.maximum(need[:, : -(c - half)], widest[half][:, c - half :], out=need[:, : -(c - half)])
            widest[c], span = need, c
        fits = need <= w
        if not fits.any():  # nor do more and narrower values
            break
        choice[fits] = sel
    sizes = np.ones(16, np.int64)
    sizes[1], sizes[2:] = ZEROS, COUNTS
    ends = np.minimum(BLOCK, n - BLOCK * np.arange(blocks))
    at, alive = np.zeros(blocks, np.int64), np.arange(blocks)
    took_block, took_at = [], []
    while len(alive):
        here = at[alive]
        took_block.append(alive)
        took_at.append(here)
        at[alive] = here + sizes[choice[alive, here]]
        alive = alive[at[alive] < ends[alive]]
    block, pos = np.concatenate(took_block), np.concatenate(took_at)
    order = np.lexsort((pos, block))
    block, pos = block[order], pos[order]
    sel = choice[block, pos]
    words = sel.astype(np.uint64) << np.uint64(60)
    for k, (c, w) in enumerate(zip(COUNTS.tolist(), WIDTHS.tolist())):
        m = np.flatnonzero(sel == k + 2)
        if len(m):
            got = v[block[m, None], pos[m, None] + np.arange(c)]
            words[m] |= np.bitwise_or.reduce(got << (np.arange(c, dtype=np.uint64) * np.uint64(w)), axis=1)
    per = np.ones(len(words), np.int64)
    if (raw := np.flatnonzero(sel == 0)).size:
        per[raw] = 2
        words = np.insert(words, raw + 1, v[block[raw], pos[raw]])
    return words, np.bincount(block, weights=per, minlength=blocks).astype(np.int64)


def unpack(words: np.ndarray, n_words: np.ndarray, n_ids: np.ndarray) -> np.ndarray:
    """The ids of consecutive blocks, decoded selector by selector over all of their words at once."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(sel == 0):
        if not raw[i]:
            raw[i + 1] = True
    sizes = np.ones(16, np.int64)
    sizes[1], sizes[2:] = ZEROS, COUNTS
    count = np.where(raw, 0, sizes[sel])
    first = np.cumsum(n_words) - n_words
    block = np.repeat(np.arange(len(n_words)), n_words)
    before = np.cumsum(count) - count
    start = np.cumsum(n_ids) - n_ids
    at = before - before[first[block]] + start[block]
    end = (start + n_ids)[block]
    out = np.zeros(int(n_ids.sum()), np.uint64)
    low = (np.uint64(1) << np.uint64(60)) - np.uint64(1)
    for k, (c, w) in enumerate(zip(COUNTS.tolist(), WIDTHS.tolist())):
        m = np.flatnonzero((sel == k + 2) & ~raw)
        if not len(m):
            continue
        mask = low if w == 60 else (np.uint64(1) << np.uint64(w)) - np.uint64(1)
        got = (words[m, None] >> (np.arange(c, dtype=np.uint64) * np.uint64(w))) & mask
        to = at[m, None] + np.arange(c)
        ok = to < end[m, None]
        out[to[ok]] = got[ok]
    esc = np.flatnonzero((sel == 0) & ~raw)
    out[at[esc]] = words[esc + 1]
    return out


class Writer:
    """Writes one file: `add` a document's ids, then `close`."""

    def __init__(self, sink, flush: int = 256 * BLOCK) -> None:
        self.sink, self.flush_at = sink, flush
        self.parts: list[np.ndarray] = []
        self.held = self.words = self.total = 0
        self.blocks: list[tuple[np.ndarray, np.ndarray]] = []
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.sizes.append(len(ids))
        self.parts.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= self.flush_at:
            self._flush(self.held // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        values = np.concatenate([np.empty(0, np.uint64), *(p.astype(np.uint64) for p in self.parts)])
        words, per = pack(values[:n])
        self.sink.write(words.astype("<u8").tobytes())
        self.blocks.append((per, np.minimum(BLOCK, n - BLOCK * np.arange(len(per)))))
        self.words += len(words)
        self.parts, self.held = [values[n:]], len(values) - n

    def close(self) -> None:
        self._flush(self.held)
        for k in (0, 1):
            self.sink.write(np.concatenate([np.empty(0, np.int64), *(b[k] for b in self.blocks)]).astype("<u4").tobytes())
        self.sink.write(np.array([i is not None for i in self.ids], np.uint8).tobytes())
        self.sink.write(np.array([i or 0 for i in self.ids], "<i8").tobytes())
        self.sink.write(np.array(self.sizes, "<u8").tobytes())
        self.sink.write(_TAIL.pack(sum(len(b[0]) for b in self.blocks), len(self.ids), self.words, END))


def read(source, size: int, group: int = 256) -> Iterator[tuple[int | None, np.ndarray]]:
    """Each document's id and token ids, in file order; `group` blocks are decoded at once."""
    source.seek(size - _TAIL.size)
    n_blocks, n_docs, n_words, end = _TAIL.unpack(source.read(_TAIL.size))
    if end != END:
        raise ValueError("not a complete token file")
    source.seek(len(MAGIC) + 8 * n_words)
    per = np.frombuffer(source.read(4 * n_blocks), "<u4").astype(np.int64)
    cnt = np.frombuffer(source.read(4 * n_blocks), "<u4").astype(np.int64)
    known = np.frombuffer(source.read(n_docs), np.uint8)
    doc_ids = np.frombuffer(source.read(8 * n_docs), "<i8")
    sizes = np.frombuffer(source.read(8 * n_docs), "<u8").astype(np.int64)
    source.seek(len(MAGIC))
    have, b = np.empty(0, np.uint64), 0
    for known_, doc_id, n in zip(known.tolist(), doc_ids.tolist(), sizes.tolist()):
        while len(have) < n:
            p, c = per[b : b + group], cnt[b : b + group]
            words = np.frombuffer(source.read(8 * int(p.sum())), "<u8").astype(np.uint64)
            have, b = np.concatenate([have, unpack(words, p, c)]), b + group
        yield (doc_id if known_ else None), have[:n]
        have = have[n:]
