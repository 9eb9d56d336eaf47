"""Operator 1: near-duplicate documents by ProbMinHash signatures, banding and verification.

Texts with the same words form a group, and one row stands for it. Representatives that agree in a whole band of their
signatures meet in a bucket. In each bucket the member with most company over all of its buckets is the hub, and the
pairs of the hub and the others are verified by their exact likeness: so an original and its many copies are linked in
as many pairs as there are copies. What a bucket then still holds outside its largest component is compared with all of
its members in blocks, so that no link within a bucket is lost; only links leave a block. Components of the links are
the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feria.llm import common
from feria.llm import probminhash as pmh
from feria.llm.components import components

LEAST = 0.8
#: Rows of each side of a block.
BLOCK = 128
_REGISTERS = pmh.BANDS * pmh.ROWS


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def described(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, id, key (common.text_key), text (lower case), two independent hashes of the word sequence, and the keys of
    the bands (none without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.pieces(batch):
                raw, at = common.text_bytes(part.column(3))
                starts, ends, first = common.word_bounds(raw, at)
                words = [common.span_hashes(common.byte_values(raw, other=other), starts, ends) for other in (False, True)]
                h, row, count = pmh.weighted(*pmh.shingles(words[0], first))
                keys = pmh.band_keys(pmh.signatures(h, row, count, part.num_rows, _REGISTERS)).view(np.int64)
                some = np.diff(first) > 0
                bands = pa.array([k if s else k[:0] for k, s in zip(keys, some)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, *(_long(common.span_hashes(w, first[:-1], first[1:])) for w in words), bands], names=["row", "id", "key", "text", "d1", "d2", "bands"])

    text, ident = F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.col(f"`{id_col}`").cast("long")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), ident.alias("id"), common.text_key(ident, text).alias("key"), F.lower(text).alias("text"))
    return rows.mapInArrow(common.trimmed(run), "row long, id long, key long, text string, d1 long, d2 long, bands array<long>")


def payloads(texts: DataFrame) -> DataFrame:
    """rep and its distinct shingles with counts, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.pieces(batch):
                raw, at = common.text_bytes(part.column(1))
                starts, ends, first = common.word_bounds(raw, at)
                h, row, count = pmh.weighted(*pmh.shingles(common.span_hashes(common.byte_values(raw), starts, ends), first))
                cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
                cut = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([h[a:b].tobytes() for a, b in cut], pa.binary()), pa.array([count[a:b].astype(np.uint32).tobytes() for a, b in cut], pa.binary())], names=["rep", "shingles", "counts"])

    return texts.select("rep", "text").mapInArrow(common.trimmed(run), "rep long, shingles binary, counts binary")


def _likeness(a: bytes, x: bytes, b: bytes, y: bytes) -> float:
    return pmh.likeness(np.frombuffer(a, np.uint64), np.frombuffer(x, np.uint32), np.frombuffer(b, np.uint64), np.frombuffer(y, np.uint32))


def verified(pairs: DataFrame, payload: DataFrame, least: float) -> DataFrame:
    """Of pairs a, b those whose exact likeness is at least `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(2, 6)]
            ok = pa.array([_likeness(*r) >= least for r in zip(*cols)], pa.bool_())
            yield batch.select([0, 1]).filter(ok)

    one, two = (payload.select(F.col("rep").alias(n), F.col("shingles").alias(f"{n}_s"), F.col("counts").alias(f"{n}_c")) for n in "ab")
    # by shuffles at any size: what is joined grows with the documents
    return pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").select("a", "b", "a_s", "a_c", "b_s", "b_c").mapInArrow(common.trimmed(run), "a long, b long")


def rest_links(members: DataFrame, comps: DataFrame, payload: DataFrame, least: float) -> DataFrame:
    """Links between different components within the buckets: members outside a bucket's largest component against all
    of its members, in blocks of BLOCK rows each."""
    m = members.join(comps, members["rep"] == comps["node"], "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"))
    sizes = m.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    per = sizes.groupBy("key").agg(F.sum("c").alias("n"), F.max(F.struct("c", "comp")).alias("top")).where("n > top.c")
    per = per.select("key", F.col("top.comp").alias("top"), F.ceil((F.col("n") - F.col("top.c")) / BLOCK).alias("nx"), F.ceil(F.col("n") / BLOCK).alias("ny"))
    m = common.written(m.join(per, "key"), "rest-members")
    place = lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n))
    x = m.where("comp != top").select("key", "rep", "comp", place("nx", 1).alias("bx"), F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("by"), F.lit(0).alias("side"))
    y = m.select("key", "rep", "comp", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("bx"), place("ny", 2).alias("by"), F.lit(1).alias("side"))
    rows = x.union(y).join(payload.hint("merge"), "rep").select("key", "bx", "by", "side", "rep", "comp", "shingles", "counts")
    rows = rows.repartition("key", "bx", "by").sortWithinPartitions("key", "bx", "by", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            for r in zip(*(batch.column(k).to_pylist() for k in range(8))):
                if r[:3] != at:
                    if held:
                        yield _block_links(held, least)
                    held, at = [], r[:3]
                held.append(r)
        if held:
            yield _block_links(held, least)

    return rows.mapInArrow(common.trimmed(run), "a long, b long").distinct()


def _bounds(x: tuple, owner: np.ndarray, shingles: np.ndarray, share: np.ndarray, n: int) -> np.ndarray:
    """At least the likeness of x and each of n others, whose shingles are ascending with their owners and shares (count
    by all counts). A common shingle adds 1 / sum(max of ratios), which is no more than the lesser of its two shares."""
    own, count = np.frombuffer(x[6], np.uint64), np.frombuffer(x[7], np.uint32)
    first, last = np.searchsorted(shingles, own, "left"), np.searchsorted(shingles, own, "right")
    size = last - first
    at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
    both = np.minimum(np.repeat(count / count.sum(), size), share[at])
    return np.bincount(owner[at], weights=both, minlength=n)


def _block_links(rows: list[tuple], least: float) -> pa.RecordBatch:
    x, y = ([r for r in rows if r[3] == side] for side in (0, 1))
    out: list[tuple[int, int]] = []
    if x and y:
        counts = [np.frombuffer(r[7], np.uint32) for r in y]
        owner = np.repeat(np.arange(len(y)), [len(c) for c in counts])
        shingles, share = np.frombuffer(b"".join(r[6] for r in y), np.uint64), np.concatenate([c / c.sum() for c in counts])
        order = np.argsort(shingles, kind="stable")
        owner, shingles, share = owner[order], shingles[order], share[order]
        comp = np.array([r[5] for r in y])
        for r in x:
            may = _bounds(r, owner, shingles, share, len(y)) >= least - 1e-9
            for j in np.flatnonzero(may & (comp != r[5])).tolist():
                if _likeness(r[6], r[7], y[j][6], y[j][7]) >= least:
                    out.append((min(r[4], y[j][4]), max(r[4], y[j][4])))
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])


def classes(docs: DataFrame, *, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: row, id, key (common.text_key of id and text), class_row, class_id, class_size and copies (rows
    with the same words). class_id is the least id of the class, class_row the row that stands for it (least id, nulls last).

    Words are runs of other characters than ASCII white space, in lower case; shingles are five words, weighted by
    their counts (a text of one to four words is one shingle). Null counts as empty, and texts without words form one
    class. Texts of any length are read whole. Repeated rows and equal ids are separate rows of one class; an empty table
    gives no rows.
    """
    base = common.written(described(docs, id_col, text_col), "described")
    group = common.written(base.groupBy("d1", "d2").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("copies")), "same-words")
    reps = base.select("row", "bands").join(group.select(F.col("rep").alias("row")), "row", "left_semi")
    bands = common.written(reps.select(F.col("row").alias("rep"), F.posexplode("bands")).select("rep", F.xxhash64("pos", "col").alias("key")), "bands")
    full = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = common.written(bands.join(full.hint("merge"), "key"), "buckets")
    common.discard(bands)
    company = members.groupBy("rep").agg(F.sum("n").alias("company"))
    hubs = members.join(company, "rep").groupBy("key").agg(F.max(F.struct("company", (-F.col("rep")).alias("r"))).alias("h")).select("key", (-F.col("h.r")).alias("hub"))
    pairs = members.join(hubs, "key").where("rep != hub").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    met = members.select("rep").distinct()
    payload = common.written(payloads(base.select(F.col("row").alias("rep"), "text").join(met.hint("merge"), "rep", "left_semi")), "payloads")
    names = common.written(base.select("row", "id", "key", "d1", "d2"), "names")
    common.discard(base)
    links = common.written(verified(pairs, payload, least), "star-links")
    common.release(docs.sparkSession)
    more = common.written(rest_links(members, components(links), payload, least), "rest-links")
    common.discard(members, payload)
    comps = components(links.union(more))
    named = common.written(group.join(comps, group["rep"] == comps["node"], "left").select("d1", "d2", "copies", F.coalesce("component", "rep").alias("class")), "class-of-words")
    rows = common.written(common.hot_join(names, named, ["d1", "d2"], "copies"), "class-of-rows")
    common.discard(group, links, more, names)
    first = rows.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "row")).alias("k"), F.count(F.lit(1)).alias("class_size"))
    first = common.written(first.select("class", F.col("k.row").alias("class_row"), F.col("k.id").alias("class_id"), "class_size"), "class-heads")
    common.discard(named)
    return common.hot_join(rows, first, ["class"], "class_size").select("row", "id", "key", "class_row", "class_id", "class_size", "copies")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text and more) that stand for their classes, all columns as they were."""
    got = classes(docs)
    same = got.groupBy("key", "id").agg(F.count_if(F.col("row") == F.col("class_row")).alias("kept"), F.count(F.lit(1)).alias("copies"))
    return common.rows_of(docs, common.written(same.where("kept > 0").select("id", "key", "copies"), "kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: the near-duplicate class of each of `documents`."""
    common.tune(spark)
    got = classes(common.load(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), "class_id", "class_size", "copies", (F.col("row") == F.col("class_row")).alias("kept"))
