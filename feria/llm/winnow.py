"""Operator 7: document fingerprints by winnowing.

Every run of K code points is hashed by a rolling polynomial. Of each window of W such hashes the least is chosen, the
rightmost of equal ones, and its position is kept. So two texts that share a passage of K + W - 1 code points or more
share a fingerprint entry from it. A text of fewer than K code points is hashed as one run; a text with fewer than W
runs is one window; an empty text has no entries.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feria.llm import common

K, W = 24, 48
#: Code points handled at once; a single longer text is handled alone.
CHUNK = 2_000_000
_POS_BITS = np.uint64(24)
_POS_MASK = np.uint64((1 << 24) - 1)


def fingerprints(texts: list[str], k: int = K, w: int = W) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes (32 bits) and positions of each text's chosen runs, in text order."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    i = 0
    while i < len(texts):
        j, held = i, 0
        while j < len(texts) and (j == i or held + len(texts[j]) <= CHUNK):
            held += len(texts[j])
            j += 1
        out += _some(texts[i:j], k, w)
        i = j
    return out


def _windows(v: np.ndarray, w: int) -> np.ndarray:
    """Least of each w values in a row, by doubling."""
    least, span = v, 1
    while span * 2 <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    return np.minimum(least[: len(least) - (w - span)], least[w - span :]) if w > span else least


def _some(texts: list[str], k: int, w: int) -> list[tuple[np.ndarray, np.ndarray]]:
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    up, down = common.powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=sums[1:])
    none = (np.empty(0, np.uint32), np.empty(0, np.int64))
    if len(codes) < k:
        v = np.empty(0, np.uint64)
    else:
        n = len(codes) - k + 1
        v = common.mix64((sums[k:] - sums[:n]) * down[:n])
    # the position within the text, larger ones first among equal hashes; texts beyond 2**24 are taken in parts below
    local = np.arange(len(v), dtype=np.int64) - np.repeat(starts, sizes)[: len(v)] if len(v) else np.empty(0, np.int64)
    v = (v & ~_POS_MASK) | (_POS_MASK - (local.astype(np.uint64) & _POS_MASK))
    least = _windows(v, w) if len(v) >= w else np.empty(0, np.uint64)
    out = []
    for a, n in zip(starts.tolist(), sizes.tolist()):
        if n == 0:
            out.append(none)
        elif n < k:
            whole = common.mix64((sums[a + n : a + n + 1] - sums[a : a + 1]) * down[a : a + 1] + np.uint64(n))
            out.append(((whole >> np.uint64(32)).astype(np.uint32), np.zeros(1, np.int64)))
        else:
            runs = n - k + 1
            got = np.array([v[a : a + runs].min()]) if runs < w else least[a : a + runs - w + 1]
            keep = np.empty(len(got), bool)
            keep[0] = True
            np.not_equal(got[1:], got[:-1], out=keep[1:])
            got = got[keep]
            pos = (_POS_MASK - (got & _POS_MASK)).astype(np.int64)
            if n > 1 << 24:  # positions in order never fall, so each fall is a wrap
                pos += np.concatenate([[0], np.cumsum(pos[1:] < pos[:-1])]) << 24
            out.append(((got >> np.uint64(32)).astype(np.uint32), pos))
    return out


def as_text(hashes: np.ndarray, positions: np.ndarray) -> str:
    """A compact string of a fingerprint: base64 of the hashes and of the steps between positions (up to W)."""
    steps = np.diff(positions, prepend=0)
    return base64.b64encode(hashes.astype("<u4").tobytes() + steps.astype("<u2").tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two fingerprints' distinct hashes; two empty ones are alike."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def winnow(docs: DataFrame, *, k: int = K, w: int = W, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, hashes and positions of each row's fingerprint. Null counts as empty, and an empty text has no entries; equal texts
    get equal fingerprints, also where ids are equal or null. Texts of any length are read whole, and an empty table gives
    no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = fingerprints([t or "" for t in batch.column(1).to_pylist()], k, w)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h.astype(np.int64) for h, _ in got], pa.list_(pa.int64())), pa.array([p for _, p in got], pa.list_(pa.int64()))], names=["id", "hashes", "positions"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("t")).mapInArrow(common.trimmed(run), "id long, hashes array<long>, positions array<long>")


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """Rows in descending id order (a null id last, equal ids by text, descending), dealt to ranges, with one more row
    (extra = 1) at the end of each range: the first row of the next range, and after the last the first of all.

    Only the ranges' bounds pass through the driver; the extra rows are one a range.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    probs = [i / parts for i in range(1, parts)]
    bounds = rows.agg(F.percentile_approx("doc_id", probs, 10_000).alias("b")).first()["b"] if probs else None
    place: Column = F.lit(0)
    if bounds:
        place = F.size(F.filter(F.lit(sorted(set(bounds))), lambda b: (b > F.col("doc_id")) | F.col("doc_id").isNull()))
    rows = rows.withColumn("place", place)
    first = rows.groupBy("place").agg(F.max("doc_id").alias("top"))
    top = F.broadcast(first.withColumnRenamed("place", "p"))  # a row a range
    heads = rows.join(top, (F.col("place") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("top"))).groupBy("place").agg(F.max(F.struct("doc_id", "text")).alias("h"))
    order = Window.orderBy("place")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    to = F.coalesce(F.lag("place").over(order), F.max("place").over(every))
    extra = heads.select("h.doc_id", "h.text", to.alias("place"), F.lit(1).alias("extra"))
    both = rows.withColumn("extra", F.lit(0)).unionByName(extra)
    return both.repartitionByRange(parts, "place").sortWithinPartitions("place", "extra", F.col("doc_id").desc_nulls_last(), F.col("text").desc())


def compare_edits(docs: DataFrame, *, parts: int, k: int = K, w: int = W) -> DataFrame:
    """For each document its fingerprint, that of its edited text (the last half of its code points replaced by the
    first as many of the next document, in descending id order), and their likenesses.

    Null ids come last; documents with equal ids follow each other in descending text order, and equal rows are documents
    of their own. Null counts as empty, texts of any length are read whole, a single document is its own next one, and an
    empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            for part in common.pieces(batch):
                rows = list(zip(*(part.column(c).to_pylist() for c in (0, 1, 3))))
                prints = fingerprints([r[1] for r in rows], k, w)
                pairs = []
                for row, fp in zip(rows, prints):
                    if held is not None:
                        pairs.append((held, row, fp))
                    held = None if row[2] else (row[0], row[1], fp)
                if pairs:
                    yield _compared(pairs, k, w)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_entries long"
    return with_next(docs, parts).select("doc_id", "text", "place", "extra").mapInArrow(common.trimmed(run), schema)


def _compared(pairs: list[tuple], k: int, w: int) -> pa.RecordBatch:
    edited = []
    for (_, text, _), (_, after, _), _ in pairs:
        half = len(text) // 2
        edited.append(text[: len(text) - half] + after[:half])
    own = fingerprints(edited, k, w)
    rows = [
        (i, len(t), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), as_text(*fp), as_text(*efp), likeness(fp[0], efp[0]), likeness(fp[0], nfp[0]), len(fp[0]))
        for ((i, t, fp), _, nfp), e, efp in zip(pairs, edited, own)
    ]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64())
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_entries"]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names=names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: fingerprints of `documents` and of their edited texts."""
    common.tune(spark)
    return compare_edits(common.load(spark, sf_dir, "documents"), parts=common.shuffle_parts(spark))
