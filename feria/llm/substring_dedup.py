"""Operator 10: passages of 35 words that occur elsewhere, by FM-indexes over content-defined shards.

Each window of words has an anchor, the least hash of its runs of GRAM words; consecutive windows with one anchor make a
segment. Equal windows have equal anchors, so they meet in one shard. Segments whose anchor occurs once hold no repeat.
Equal segments are combined and weighted before anything is sent. A shard's distinct segments are indexed by an
FM-index and streamed through it: backward search finds the first and the last window of each that occurs twice, and as
all windows of a segment overlap, what lies between is covered. An anchor with very many different segments is cut up
into its windows: equal ones are combined before the shuffle, one of each is indexed in a shard of its own hash, and what
is found goes back to the segments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feria.llm import common
from feria.llm.fm_index import FMIndex, repeated_ends

WIDTH, GRAM = 35, 6
#: Words that one index holds, and different segments of an anchor above which its windows are sharded apart.
INDEX_WORDS, HOT = 600_000, 2_000


def _zipped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, id and the compressed text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            z = pa.array([c.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), z], names=["row", "id", "z"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("t"))
    return rows.mapInArrow(common.trimmed(run), "row long, id long, z binary")


def _unzipped(batch: pa.RecordBatch, name: str = "z", most: int = 1_500_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with their texts' bytes and bounds."""
    d = zstandard.ZstdDecompressor()
    held, size, begin = [], 0, 0
    col = batch.column(batch.schema.get_field_index(name)).to_pylist()
    for i, z in enumerate(col):
        held.append(d.decompress(z))
        size += len(held[-1])
        if size >= most or i == len(col) - 1:
            at = np.concatenate([[0], np.cumsum([len(t) for t in held])]).astype(np.int64)
            yield batch.slice(begin, i + 1 - begin), np.frombuffer(b"".join(held), np.uint8), at
            held, size, begin = [], 0, i + 1


def _words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, first = common.word_bounds(raw, at)
    return common.span_hashes(common.byte_values(raw), starts, ends), first, starts, ends


def _lesser(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of pairs of places, a left of b, the one with the lesser value."""
    return np.where(values[b] < values[a], b, a)


def _segments(words: np.ndarray, first: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of rows of words: each segment's row, first word (within all words), number of windows, anchor and content."""
    counts = np.diff(first)
    n = len(words)
    if n < width:
        return tuple(np.empty(0, np.int64) for _ in range(3)) + tuple(np.empty(0, np.uint64) for _ in range(2))
    grams = common.span_hashes(words, np.arange(n - gram + 1), np.arange(gram, n + 1))
    w = width - gram + 1
    least, span = np.arange(len(grams)), 1  # places of the least, the leftmost of equal ones
    while span * 2 <= w:
        least, span = _lesser(grams, least[:-span], least[span:]), span * 2
    if w > span:
        least = _lesser(grams, least[: len(least) - (w - span)], least[w - span :])
    windows = np.maximum(counts - width + 1, 0)
    row = np.repeat(np.arange(len(counts)), windows)
    place = np.repeat(first[:-1] - (np.cumsum(windows) - windows), windows) + np.arange(len(row))
    got = least[place]
    new = np.ones(len(row), bool)
    new[1:] = (got[1:] != got[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(row)))
    anchor = grams[got[at]]
    content = common.span_hashes(common.mix64(words ^ np.uint64(0x5555555555555555)), place[at], place[at] + size + width - 1)
    return row[at], place[at], size, anchor, content


def occurrences(base: DataFrame, width: int, gram: int) -> DataFrame:
    """row, start (word), windows, anchor and content of every segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in _unzipped(batch):
                words, first, _, _ = _words(raw, at)
                row, place, size, anchor, content = _segments(words, first, width, gram)
                rows = part.column(0).to_numpy()[row]
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array((place - first[row]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64))], names=["row", "start", "windows", "anchor", "content"])

    return base.select("row", "z").mapInArrow(common.trimmed(run), "row long, start int, windows int, anchor long, content long")


def sharded(found: DataFrame, base: DataFrame, width: int) -> DataFrame:
    """shard key, segment (anchor, content), windows, weight, 32-bit word codes and whether its anchor is hot, of the segments to
    index, read from one occurrence of each: the texts are sent once for all of them."""
    per_row = found.groupBy("row").agg(F.collect_list(F.struct("start", "windows", "anchor", "content", "weight", "hot")).alias("segs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in _unzipped(batch):
                words, first, _, _ = _words(raw, at)
                code = (words >> np.uint64(32)).astype(np.uint32)
                out = []
                for f, segs in zip(first.tolist(), part.column(1).to_pylist()):
                    for s in segs:
                        a, n = f + s["start"], s["windows"]
                        out.append((s["anchor"], s["anchor"], s["content"], n, s["weight"], code[a : a + n + width - 1].tobytes(), s["hot"]))
                        if len(out) >= 20_000:
                            yield _rows(out)
                            out = []
                if out:
                    yield _rows(out)

    return base.join(per_row, "row").select("z", "segs").mapInArrow(common.trimmed(run), _SHARD)


_SHARD = "shard long, anchor long, content long, windows int, weight long, codes binary, hot boolean"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["shard", "anchor", "content", "windows", "weight", "codes", "hot"])


def hot_windows(segments: DataFrame, width: int) -> DataFrame:
    """Every window of the segments of hot anchors: two hashes of its word codes, the first with the anchor, which equal
    windows share, its segment (anchor, content), offset, the segment's weight and 32-bit word codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, content, n, weight = (batch.column(k).to_numpy() for k in range(4))
            codes = batch.column(4).to_pylist()
            flat = np.frombuffer(b"".join(codes), np.uint32)
            begin = np.cumsum([0, *(len(c) // 4 for c in codes[:-1])])
            n = n.astype(np.int64)
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            place = np.repeat(begin, n) + offset
            each = [np.repeat(x, n) for x in (anchor, content, weight)]
            wide = flat.astype(np.uint64)
            k1, k2 = (common.span_hashes(common.mix64(wide ^ np.uint64(salt)), place, place + width) for salt in (0x5555555555555555, 0xA5A5A5A5A5A5A5A5))
            k1 = k1 ^ common.mix64(each[0].view(np.uint64))
            for i in range(0, len(place), 20_000):
                at = slice(i, i + 20_000)
                own = pa.array([flat[p : p + width].tobytes() for p in place[at].tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(k1[at].view(np.int64)), pa.array(k2[at].view(np.int64)), pa.array(each[0][at]), pa.array(each[1][at]), pa.array(offset[at].astype(np.int32)), pa.array(each[2][at]), own], names=["k1", "k2", "anchor", "content", "offset", "weight", "codes"])

    return segments.select("anchor", "content", "windows", "weight", "codes").mapInArrow(common.trimmed(run), "k1 long, k2 long, anchor long, content long, offset int, weight long, codes binary")


def searched(segments: DataFrame, width: int, index_words: int = INDEX_WORDS) -> DataFrame:
    """anchor, content, and the first and last repeated window of each segment that has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, shard = [], 0, None
        for batch in batches:
            for r in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if size >= index_words and r[0] != shard:
                    yield from _search(held, width)
                    held, size = [], 0
                shard = r[0]
                held.append(r)
                size += len(r[5]) // 4 + 1
        if held:
            yield from _search(held, width)

    return segments.mapInArrow(common.trimmed(run), "anchor long, content long, first int, last int")


def _search(rows: list[tuple], width: int) -> Iterator[pa.RecordBatch]:
    end = np.zeros(1, np.uint32)
    codes = np.concatenate([x for r in rows for x in (np.frombuffer(r[5], np.uint32), end)])
    sizes = np.array([len(r[5]) // 4 + 1 for r in rows])
    stops = np.cumsum(sizes) - 1
    known, text = np.unique(codes, return_inverse=True)
    text = text.astype(np.int64) + 1
    text[stops] = 0
    index = FMIndex(text, len(known) + 1, marks=np.repeat([r[4] > 1 for r in rows], sizes))
    windows = np.array([r[3] for r in rows])
    first, last = repeated_ends(index, text, stops - sizes + 1, windows, width)
    at = np.flatnonzero(first >= 0)
    yield pa.RecordBatch.from_arrays([pa.array([rows[i][1] for i in at], pa.int64()), pa.array([rows[i][2] for i in at], pa.int64()), pa.array(first[at].astype(np.int32)), pa.array(last[at].astype(np.int32))], names=["anchor", "content", "first", "last"])


def remove_repeats(docs: DataFrame, *, width: int = WIDTH, gram: int = GRAM, hot: int = HOT, index_words: int = INDEX_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept (the kept words joined by one space) and spans, the removed
    word intervals (start, end).

    A word is removed if a window of `width` words of its own text holds it whose word sequence also starts anywhere
    else, in this text or another. Words are runs of other characters than ASCII white space. Null and empty texts have
    no words; equal texts of `width` words or more lose all of them; an empty table gives no rows. Words count as equal
    when 32 bits of their hashes are, for all words of a window, and its segment's 64-bit anchor. Texts of any length are
    read whole, and repeated rows are texts of their own.
    """
    spark = docs.sparkSession
    base = common.written(_zipped(docs, id_col, text_col), "texts")
    occ = occurrences(base, width, gram)
    first = F.min(F.struct("row", "start")).alias("at")
    distinct = common.written(occ.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("weight"), F.first("windows").alias("windows"), first), "segments")
    common.release(spark)
    anchors = distinct.groupBy("anchor").agg(F.sum("weight").alias("all"), F.count(F.lit(1)).alias("kinds")).where("all > 1").drop("all")
    found = common.written(distinct.join(anchors, "anchor").select("anchor", "content", "weight", "windows", "at.row", "at.start", (F.col("kinds") > hot).alias("hot")), "met-segments")
    common.discard(distinct)
    parts = common.shuffle_parts(spark)
    cut = lambda rows: rows.repartition(parts, "shard").sortWithinPartitions("shard")
    segments = common.written(sharded(found, base, width), "coded-segments")
    common.discard(found)
    ranges = common.written(searched(cut(segments.where("not hot").drop("hot")), width, index_words), "ranges")
    common.release(spark)
    if not segments.where("hot").isEmpty():
        windows = hot_windows(segments.where("hot"), width)
        once = windows.groupBy("k1", "k2").agg(F.sum("weight").alias("weight"), F.first("codes").alias("codes"), F.count(F.lit(1)).alias("n"))
        once = common.written(once, "hot-windows")
        again = searched(cut(once.select(F.col("k1").alias("shard"), F.col("k1").alias("anchor"), F.col("k2").alias("content"), F.lit(1).alias("windows"), "weight", "codes")), width, index_words)
        again = common.written(again.select(F.col("anchor").alias("k1"), F.col("content").alias("k2")).join(once.select("k1", "k2", "n"), ["k1", "k2"]), "hot-repeats")
        places = common.written(windows.select("k1", "k2", "anchor", "content", "offset"), "hot-places")
        common.discard(once)
        more = common.hot_join(places, again, ["k1", "k2"], "n").groupBy("anchor", "content").agg(F.min("offset").alias("first"), F.max("offset").alias("last"))
        more = common.written(more, "hot-ranges")
        common.discard(places, again)
        ranges = ranges.unionByName(more)
    common.discard(segments)
    spans = occ.join(ranges, ["anchor", "content"]).select("row", F.struct((F.col("start") + F.col("first")).alias("s"), (F.col("start") + F.col("last") + width).alias("e")).alias("span"))
    per_row = spans.groupBy("row").agg(F.sort_array(F.collect_list("span")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in _unzipped(batch):
                starts, ends, f = common.word_bounds(raw, at)
                flat, out = raw.tobytes(), []
                for i, (doc, spans) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist())):
                    a, b = int(f[i]), int(f[i + 1])
                    gone = np.zeros(b - a + 1, np.int32)
                    merged: list[list[int]] = []
                    for s in spans or []:
                        if merged and s["s"] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], s["e"])
                        else:
                            merged.append([s["s"], s["e"]])
                    for s, e in merged:
                        gone[s] += 1
                        gone[e] -= 1
                    keep = np.flatnonzero(np.cumsum(gone[:-1]) == 0) + a
                    kept = b" ".join([flat[x:y] for x, y in zip(starts[keep].tolist(), ends[keep].tolist())])
                    out.append((doc, b - a, b - a - len(keep), kept, [{"start": s, "end": e} for s, e in merged]))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["id", "n_words", "n_removed", "kept", "spans"])

    schema = "id long, n_words long, n_removed long, kept binary, spans array<struct<start: long, end: long>>"
    return base.join(per_row, "row", "left").select("id", "z", "spans").mapInArrow(common.trimmed(run), schema).withColumn("kept", F.col("kept").cast("string"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: `documents` without passages of 35 words that occur elsewhere."""
    common.tune(spark)
    got = remove_repeats(common.load(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
