"""Signatures of weighted word shingles by ProbMinHash, and the exact probability Jaccard likeness.

Each distinct shingle of a text, weighted by its count, sends arrivals of a Poisson process whose rate is its weight to
random registers; a register keeps the shingle of its first arrival. A shingle stops once its next arrival is later
than the first arrivals of all registers, so the work for a text ends early. Two texts agree in a register with the
probability that is their probability Jaccard likeness.
"""

from __future__ import annotations

import numpy as np

from feria.llm import common

SHINGLE = 5
BANDS, ROWS = 30, 6
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_ODD = common.mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingles(words: np.ndarray, first: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words (given by hashes) of each row, and the row of each, from each row's first word.
    A row with fewer words has one run."""
    counts = np.diff(first)
    runs = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    row = np.repeat(np.arange(len(counts)), runs)
    begin = np.repeat(first[:-1] - (np.cumsum(runs) - runs), runs) + np.arange(len(row))
    end = np.minimum(begin + size, first[1:][row])
    return common.span_hashes(words, begin, end), row


def weighted(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row, ordered by row and shingle: shingle, row, count."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.empty(len(h), bool)
    if len(h):
        new[0] = True
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return h[at], row[at], np.diff(np.append(at, len(h)))


def signatures(h: np.ndarray, row: np.ndarray, weight: np.ndarray, rows: int, m: int) -> np.ndarray:
    """The shingle that each of m registers of each row keeps; rows without shingles keep zeros."""
    first, kept = np.full(rows * m, np.inf), np.zeros(rows * m, np.uint64)
    rate, t, step = weight.astype(np.float64), np.zeros(len(h)), 0
    while len(h):
        n = int(np.clip(200_000 // len(h), 1, 256)) if step >= 2 else 1
        draw = common.mix64(h[:, None] + (np.arange(step + 1, step + n + 1, dtype=np.uint64) * _GOLD)[None, :])
        arrive = np.log1p((draw >> np.uint64(11)) * -(2.0**-53))
        arrive /= -rate[:, None]
        arrive[:, 0] += t
        np.cumsum(arrive, axis=1, out=arrive)
        place = (row[:, None] * m + (common.mix64(draw ^ _GOLD) % np.uint64(m)).astype(np.int64)).ravel()
        when = arrive.ravel()
        np.minimum.at(first, place, when)
        won = np.flatnonzero(when == first[place])
        kept[place[won]] = h[won // n]
        live = np.unique(row)
        last = np.zeros(rows)
        last[live] = first.reshape(rows, m)[live].max(axis=1)
        t = arrive[:, -1]
        go = np.flatnonzero(t < last[row])
        h, row, rate, t, step = h[go], row[go], rate[go], t[go], step + n
    return kept.reshape(rows, m)


def band_keys(kept: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A hash of each band's registers."""
    parts = kept.reshape(len(kept), bands, rows) * _ODD[:rows]
    return common.mix64(parts.sum(axis=2, dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * _GOLD)


def likeness(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Probability Jaccard likeness of two sets of distinct shingles, ascending, with weights."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = b[at] == a
    p, q = x[both].astype(np.float64), y[at[both]].astype(np.float64)
    if not len(p):
        return 0.0
    if x.max() == 1 and y.max() == 1:
        return len(p) / (len(a) + len(b) - len(p))
    ratio = q / p
    order = np.argsort(ratio, kind="stable")
    ratio, p, q = ratio[order], p[order], q[order]
    last = np.searchsorted(ratio, ratio, side="right")
    below = np.concatenate([[0.0], np.cumsum(p)])[last] + (x.sum() - p.sum())
    above = q.sum() - np.concatenate([[0.0], np.cumsum(q)])[last] + (y.sum() - q.sum())
    return float((1.0 / (below / p + above / q)).sum())
