"""Operator 12: benchmark passages in documents, by a broadcast set of the benchmark's word windows.

Both sides' texts are lower-cased and cut into words in the same way. The benchmark's windows of N words (an item of fewer
words is one window) become a sorted array of hashes with the SHA-256 of each window and the items that hold it. It is
broadcast in shards of bounded size; each text's windows are looked up in it, hits are verified by the window's own bytes,
and all words of an occurrence are hit. Hit words can be cut out of their texts, or their documents left out.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feria.llm import common
from feria.llm.stream_dedup import lower_ascii

#: Words in a window.
N = 10
#: Bytes of windows (hash, digest, length, item) in a broadcast shard; more windows make more shards.
SHARD_BYTES = 48_000_000
#: Bits of the table that most windows are turned away by.
FILTER_BITS = 22
#: Bytes that are part of words after lower-casing: digits, a-z, and all of characters beyond ASCII.
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _words(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts, begin and end of each word, each text's first word (and the end), and each text's
    first byte (and the end)."""
    raw, at = common.text_bytes(col)
    raw = lower_ascii(raw)
    begin, end, first = common.word_bounds(raw, at, WORD)
    return raw, begin, end, first, at


def _joined(flat: bytes, begin: np.ndarray, end: np.ndarray, k: int, n: int) -> bytes:
    """n words from the k-th on, joined by one space."""
    return b" ".join([flat[a:b] for a, b in zip(begin[k : k + n].tolist(), end[k : k + n].tolist())])


def _window_hashes(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first word of each window of n words that lies in one text, and the window's hash."""
    counts = np.diff(first)
    whole = np.maximum(counts - n + 1, 0)
    ends = np.cumsum(whole)
    start = np.repeat(first[:-1] - (ends - whole), whole) + np.arange(ends[-1] if len(ends) else 0)
    return start, common.span_hashes(hashes, start, start + n)


def windows(benchmark: DataFrame, *, n: int = N, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """size (words), hash, digest (SHA-256 of the words joined by spaces) and item (id as text, null as empty) of each
    different window of each item. Null or wordless texts have none; texts of any length are read whole; equal ids are one
    item; an empty table gives no rows."""
    rows = benchmark.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{text_col}`").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, begin, end, first, _ = _words(batch.column(1))
            flat, h = raw.tobytes(), common.span_hashes(common.byte_values(raw), begin, end)
            for row, item in enumerate(batch.column(0).to_pylist()):
                lo, hi = int(first[row]), int(first[row + 1])
                size = min(n, hi - lo)
                if not size:
                    continue
                start, values = _window_hashes(h[lo:hi], np.array([0, hi - lo]), size)
                for low in range(0, len(start), 100_000):
                    part = slice(low, low + 100_000)
                    digests = [hashlib.sha256(_joined(flat, begin, end, lo + k, size)).digest() for k in start[part].tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(digests), size, np.int32)), pa.array(values[part].view(np.int64)), pa.array(digests, pa.binary()), pa.array([item] * len(digests), pa.string())], names=["size", "hash", "digest", "item"])

    return rows.mapInArrow(common.trimmed(run), "size int, hash long, digest binary, item string").distinct()


class Windows:
    """A shard of the benchmark's windows: by size their sorted hashes, digests and items."""

    def __init__(self, table: pa.Table) -> None:
        size, h = table["size"].to_numpy(), table["hash"].to_numpy().view(np.uint64)
        names, item = np.unique(np.array(table["item"].to_pylist(), object), return_inverse=True) if len(table) else ([], size)
        digest = np.frombuffer(b"".join(table["digest"].to_pylist()) or bytes(32), np.uint8).reshape(-1, 32)
        self.items, self.by_size = list(names), {}
        for n in sorted(set(size.tolist())):
            own = np.flatnonzero(size == n)
            own = own[np.argsort(h[own], kind="stable")]
            self.by_size[n] = (h[own], digest[own], item[own])

    def filters(self) -> dict[int, np.ndarray]:
        """For each size, which lowest bits of hashes occur."""
        out = {}
        for n, (h, _, _) in self.by_size.items():
            out[n] = np.zeros(1 << FILTER_BITS, bool)
            out[n][h & _LOW] = True
        return out

    def holders(self, n: int, at: int, window: bytes) -> list[str]:
        """Items that hold exactly this window, whose hash is found from place `at` on."""
        h, digest, item = self.by_size[n]
        own, found = hashlib.sha256(window).digest(), []
        for k in itertools.takewhile(lambda k: h[k] == h[at], range(at, len(h))):
            if digest[k].tobytes() == own:
                found.append(self.items[item[k]])
        return found


_LOW = np.uint64((1 << FILTER_BITS) - 1)
_RUNS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def _lists(values: list[pa.Array], counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    flat = pa.StructArray.from_arrays(values, ["begin", "end"]) if kind == _RUNS else values[0]
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), flat)


def _scanned(rows: DataFrame, sent: object, keep_text: bool) -> DataFrame:
    """For rows with row, id, key and t: row, id, key, n_words, runs of hit words (the first and the one behind the last),
    items, and text if it is kept."""
    kept = ["text"] * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = filters = None
        known: dict[tuple[int, bytes], list[str]] = {}  # as many as the shard has windows
        for batch in batches:
            for part in common.pieces(batch, "t"):
                if shard is None:
                    shard = sent.value
                    filters = shard.filters()
                raw, begin, end, first, _ = _words(part.column(3))
                h = common.span_hashes(common.byte_values(raw), begin, end)
                flat, change = raw.tobytes(), np.zeros(len(begin) + 1, np.int64)
                items: list[set[str]] = [set() for _ in range(part.num_rows)]
                for n, (hashes, _, _) in shard.by_size.items():
                    start, values = _window_hashes(h, first, n)
                    maybe = np.flatnonzero(filters[n][values & _LOW])
                    at = np.searchsorted(hashes, values[maybe])
                    has = hashes[np.minimum(at, len(hashes) - 1)] == values[maybe]
                    start, at = start[maybe[has]], at[has]
                    own = np.searchsorted(first, start, side="right") - 1
                    for k, place, row in zip(start.tolist(), at.tolist(), own.tolist()):
                        window = _joined(flat, begin, end, k, n)
                        found = known.get((n, window))
                        if found is None and (found := shard.holders(n, place, window)):
                            known[n, window] = found
                        if found:
                            change[k] += 1
                            change[k + n] -= 1
                            items[row].update(found)
                hit = np.cumsum(change[:-1]) > 0
                head = hit.copy()
                head[1:] &= ~hit[:-1]
                tail = hit.copy()
                tail[:-1] &= ~hit[1:]
                edge = first[1:-1][(first[1:-1] > 0) & (first[1:-1] < len(hit))]  # runs end with their text
                head[edge] = hit[edge]
                tail[edge - 1] = hit[edge - 1]
                b, e = np.flatnonzero(head), np.flatnonzero(tail) + 1
                runs = np.searchsorted(first, b, side="right") - 1
                per_row = np.bincount(runs, minlength=part.num_rows)
                named = [sorted(x) for x in items]
                columns = [*(part.column(k) for k in range(3)), pa.array(np.diff(first), pa.int64()), _lists([pa.array(b - first[runs]), pa.array(e - first[runs])], per_row, _RUNS), pa.array(named, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*columns, *[part.column(3) for _ in kept]], names=["row", "id", "key", "n_words", "runs", "items", *kept])

    schema = "row long, id long, key long, n_words long, runs array<struct<begin:long,end:long>>, items array<string>"
    return rows.mapInArrow(common.trimmed(run), schema + ", text string" * keep_text)


def _merged(runs: Column) -> Column:
    """Runs in order, those that meet or overlap as one."""

    def step(got: Column, x: Column) -> Column:
        last = F.try_element_at(got, F.lit(-1))
        one = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when(x["begin"] <= last["end"], F.concat(F.slice(got, 1, F.size(got) - 1), F.array(one))).otherwise(F.concat(got, F.array(x)))

    return F.aggregate(F.array_sort(runs), F.array().cast("array<struct<begin:long,end:long>>"), step)


def report(docs: DataFrame, benchmark: DataFrame, *, n: int = N, shard_bytes: int = SHARD_BYTES, keep_text: bool = False, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: id, key (text_key of id and text), n_words, n_hit, runs (begin and end of hit words), items (ids
    of items with occurring windows, as strings, sorted), and text if `keep_text`.

    A null text has no words, and neither it nor an empty one is hit; equal ids and repeated rows are judged one by one;
    texts of any length are scanned whole; an empty benchmark hits nothing, an empty table gives no rows; other columns are
    not read. Documents are read once for each broadcast shard; up to `shard_bytes` of windows there is one.
    """
    spark = docs.sparkSession
    common.tune(spark)
    known = common.written(windows(benchmark, n=n, id_col=item_col, text_col=item_text_col), "windows")
    weight = F.octet_length("item") + 48
    shards = max(1, -(-(known.agg(F.sum(weight)).first()[0] or 0) // shard_bytes))
    dealt = lambda: known.withColumn("shard", F.pmod(F.xxhash64("hash", "item"), F.lit(shards)))
    while (dealt().groupBy("shard").agg(F.sum(weight).alias("w")).agg(F.max("w")).first()[0] or 0) > shard_bytes + 4096:
        shards *= 2
    ident, text = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), ident.alias("id"), common.text_key(ident, text).alias("key"), text.alias("t"))
    if shards > 1:
        rows = common.written(rows, "numbered")

    def scan(k: int, keep: bool) -> DataFrame:
        return _scanned(rows, spark.sparkContext.broadcast(Windows(dealt().where(F.col("shard") == k).drop("shard").toArrow())), keep)

    got = scan(0, keep_text)
    if shards > 1:
        parts = [common.written(scan(k, False).where("size(runs) > 0"), "hits") for k in range(1, shards)]
        every = got
        for p in parts:
            every = every.unionByName(p, allowMissingColumns=True)
        text_kept = [F.max("text").alias("text")] * keep_text
        every = every.groupBy("row").agg(*[F.first(c).alias(c) for c in ("id", "key", "n_words")], F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), *text_kept)
        got = common.written(every.withColumn("runs", _merged(F.col("runs"))), "contamination")
        common.discard(rows, *parts)
    common.discard(known)
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["begin"])
    return got.select("id", "key", "n_words", n_hit.alias("n_hit"), "runs", "items", *["text"] * keep_text)


def without_spans(docs: DataFrame, benchmark: DataFrame, **how: object) -> DataFrame:
    """id, key, n_hit and text of each document, with every run of hit words cut out, from its first word's first letter to
    its last word's last; what stands before and after stays as it is. Odd tables as in `report`; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = common.text_bytes(batch.column(3))
            _, begin, end, first, _ = _words(batch.column(3))
            flat, texts = raw.tobytes(), []
            for row, runs in enumerate(batch.column(4).to_pylist()):
                done, kept = int(at[row]), []
                for r in runs:
                    kept.append(flat[done : begin[first[row] + r["begin"]]])
                    done = end[first[row] + r["end"] - 1]
                texts.append(b"".join([*kept, flat[done : at[row + 1]]]).decode())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(texts, pa.string())], names=["id", "key", "n_hit", "text"])

    got = report(docs, benchmark, keep_text=True, **how).select("id", "key", "n_hit", "text", "runs")
    return got.mapInArrow(common.trimmed(run), "id long, key long, n_hit long, text string")


def without_documents(docs: DataFrame, benchmark: DataFrame, *, most: float = 0.0, id_col: str = "doc_id", text_col: str = "text", **how: object) -> DataFrame:
    """The rows of docs of which at most this share of words is hit, all columns as they were. Odd tables as in `report`."""
    got = report(docs, benchmark, id_col=id_col, text_col=text_col, **how)
    good = got.where(F.col("n_hit") <= F.lit(float(most)) * F.col("n_words")).groupBy("id", "key").agg(F.count(F.lit(1)).alias("copies"))
    wanted = common.written(good.select("id", "key", F.lit(1).alias("copies")), "clean")  # equal rows are judged alike: all stay
    return common.rows_of(docs, wanted, id_col=id_col, text_col=text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: what of `benchmark` stands in each of `documents`."""
    got = report(common.load(spark, sf_dir, "documents"), common.load(spark, sf_dir, "benchmark"))
    return got.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: The same by joins on the windows' own words.
ORACLE = """
WITH item AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
sized AS (SELECT *, least(10, len(w)) AS n FROM item WHERE len(w) > 0),
known AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1:i + n], ' ') AS words FROM (SELECT *, unnest(range(len(w) - n + 1)) AS i FROM sized)),
doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
cut AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + n], ' ') AS words FROM (SELECT doc.doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM doc, (SELECT DISTINCT n FROM known) WHERE len(w) >= n)),
met AS (SELECT doc_id, i, n, item_id FROM cut JOIN known USING (n, words)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM met) GROUP BY doc_id)
SELECT doc.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""
