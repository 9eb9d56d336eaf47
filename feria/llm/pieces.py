"""Operator 4: SentencePiece encoding and decoding as a relational lattice.

Texts are cut into units that no piece crosses. Each distinct unit's substrings, up to the longest piece, are exploded
and joined to the piece table; the matches are the unit's lattice edges, grouped by unit, and a higher-order aggregate
folds them into the best path. Units' ids go back to the chunks of documents that hold the unit. Units of MASK characters
or more are merged in tasks from an agenda of pairs, which for a BPE model gives the same path.

The fold follows the model's kind. For a unigram model it is Viterbi: edges by end, best sum of scores for each end. The
model at hand is a BPE model, for which the best sum is not what SentencePiece returns, so there the edges are folded
best score first, leftmost first: an edge is taken if its ends are borders now and just one border lies inside. As a
piece's parts always score better than it does, one pass over the edges gives what repeated merging gives.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feria.llm import common

SPACE = "▁"
#: Units below this length are folded with a 64-bit mask of borders inside Spark. Longer ones, which natural text hardly
#: has, would be lattices of any size in a row; they are merged by the same rule in tasks, from an agenda of pairs.
MASK = 62
#: Rows that the piece table may have to be broadcast; a larger one is joined by a shuffle.
BROADCAST_PIECES = 1_000_000
#: Chunks that are listed beside a unit in one row; a unit of more chunks has several rows.
BLOCK = 1000
#: Tasks that the lattices of a chunk's units are dealt to: a task then sorts its edges in memory.
LATTICE_TASKS = 8
#: Characters of a chunk, and of the texts that are cut at once: a task holds a chunk's units and some of its texts.
CHUNK_CHARS, CUT_CHARS = 24_000_000, 800_000
#: Bytes of texts that a task deals to chunks at once.
BLOB_BYTES = 16_000_000


@dataclass(frozen=True)
class Pieces:
    """A model's pieces: text, id and score of each ordinary piece, ids of byte pieces (empty: unknown characters get
    `unknown`), and whether its scores are those of a unigram model."""

    table: tuple[tuple[str, int, float], ...]
    byte_ids: tuple[int, ...]
    unknown: int
    unigram: bool = False

    @property
    def longest(self) -> int:
        return max(len(p) for p, _, _ in self.table)


class Cutter:
    """Cuts texts between two characters that stand side by side in no piece: nothing is merged across."""

    def __init__(self, pieces: Pieces) -> None:
        many = [p for p, _, _ in pieces.table if len(p) > 1]
        chars = sorted(set("".join(many)))
        self.kind = np.zeros(0x110000, np.int32)
        self.kind[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.joined = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for p in many:
            k = self.kind[[ord(c) for c in p]]
            self.joined[k[:-1], k[1:]] = True

    def units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
        """The hash of each unit of some texts in order, each text's number of units, and the units' places: all texts
        as UTF-8, begin and end of each unit."""
        marked = [_marked(t) for t in texts]
        whole = "".join(marked)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
        sizes = np.array([len(t) for t in marked], np.int64)
        first = np.cumsum(sizes) - sizes
        kind = self.kind[codes]
        cut = np.ones(len(codes), bool)
        cut[1:] = ~self.joined[kind[:-1], kind[1:]]
        cut[first[sizes > 0]] = True
        starts = np.flatnonzero(cut)
        at = np.concatenate([[0], np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))])
        begin, end = at[starts], at[np.append(starts[1:], len(codes))]
        flat = whole.encode("utf-8", "surrogatepass")
        h = common.span_hashes(common.byte_values(np.frombuffer(flat, np.uint8)), begin, end)
        return h, np.diff(np.searchsorted(starts, np.append(first, len(codes)))), flat, begin, end


def load_pieces(path: str) -> Pieces:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    scores = [sp.get_score(i) for i in plain if len(sp.id_to_piece(i)) > 1]
    by_byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
    whole = all(float(s).is_integer() for s in scores)  # BPE scores are ranks
    return Pieces(tuple((sp.id_to_piece(i), i, sp.get_score(i)) for i in plain), tuple(by_byte[b] for b in range(256)) if len(by_byte) == 256 else (), sp.unk_id(), not whole)


_ID = (1 << 20) - 1  # an unknown character's id in an edge that is packed into a number


def _met(units: DataFrame, pieces: Pieces) -> DataFrame:
    """All columns of `units`, and for each substring that is a piece or one character: s, e, piece, id and rank, the
    place of its score among all, best first (an unknown character: null and last)."""
    spark = units.sparkSession
    ranks = {s: i for i, s in enumerate(sorted({s for _, _, s in pieces.table}, reverse=True))}
    if len(ranks) >= 1 << 19 or max(i for _, i, _ in pieces.table) >= _ID:
        raise ValueError("too many pieces for packed edges")
    table = spark.createDataFrame([(p, i, float(s), ranks[s]) for p, i, s in pieces.table], "piece string, id int, score double, rank long")
    if len(pieces.table) <= BROADCAST_PIECES:
        table = F.broadcast(table)
    n = F.length("unit")
    heads = units.withColumn("s", F.explode(F.sequence(F.lit(0), n - 1)))
    subs = heads.withColumn("e", F.explode(F.sequence(F.col("s") + 1, F.least(F.col("s") + pieces.longest, n)))).withColumn("piece", F.expr("substring(unit, s + 1, e - s)"))
    return subs.join(table, "piece", "left").where("id is not null or e = s + 1").withColumn("rank", F.coalesce("rank", F.lit(len(ranks)).cast("long")))


def _order(piece: Column, s: Column, e: Column) -> tuple[Column, Column]:
    """Among equal scores: the leftmost first; runs of blanks share one score and grow from the left, so by their ends,
    and by length among equal ends."""
    blank = piece.rlike(f"^{SPACE}+$")
    return F.when(blank, e).otherwise(s), F.when(blank, MASK - s).otherwise(F.lit(0))


def _other(pieces: Pieces, piece: Column) -> Column:
    """Ids of a character that is no piece: those of its bytes, or the unknown id."""
    if not pieces.byte_ids:
        return F.array(F.lit(pieces.unknown))
    raw = F.hex(F.encode(piece, "utf-8"))
    codes = F.array(*[F.lit(i) for i in pieces.byte_ids])
    return F.transform(F.sequence(F.lit(1), F.length(raw), F.lit(2)), lambda k: F.get(codes, F.conv(F.substring(raw, k, F.lit(2)), 16, 10).cast("int")))


def packed_lattice(units: DataFrame, pieces: Pieces) -> DataFrame:
    """All columns of `units` (unit: up to MASK characters, distinct, or with `block` if there is one) and edges, numbers that hold rank, order, end,
    start and id from the highest bits down, so that their own order is the fold's."""
    met = _met(units, pieces)
    tie, o = _order(F.col("piece"), F.col("s"), F.col("e"))
    word = F.lit(0).cast("long")
    for part, bits in ((F.col("rank"), 19), (tie, 6), (o, 6), (F.col("e"), 6), (F.col("s"), 6), (F.coalesce("id", F.lit(_ID)), 20)):
        word = F.shiftleft(word, bits).bitwiseOR(part.cast("long"))
    by = [c for c in ("unit", "block") if c in units.columns]
    keep = [F.first(c).alias(c) for c in units.columns if c not in by]
    return met.select(*units.columns, word.alias("x")).groupBy(*by).agg(F.sort_array(F.collect_list("x")).alias("edges"), *keep)


def lattice(units: DataFrame, pieces: Pieces) -> DataFrame:
    """All columns of `units` (unit: distinct, or with `block`) and edges: an array of structs with s, e and ids, in fold order."""
    met = _met(units, pieces)
    ids = F.when(F.col("id").isNotNull(), F.array("id")).otherwise(_other(pieces, F.col("piece")))
    tie, o = _order(F.col("piece"), F.col("s"), F.col("e"))
    edge = F.struct("rank", tie.alias("tie"), o.alias("o"), "e", "s", ids.alias("ids"))
    if pieces.unigram:
        worst = F.lit(min(s for _, _, s in pieces.table) - 10.0)
        edge = F.struct("e", "s", (-F.coalesce("score", worst)).alias("rank"), ids.alias("ids"))
    by = [c for c in ("unit", "block") if c in units.columns]
    keep = [F.first(c).alias(c) for c in units.columns if c not in by]
    return met.groupBy(*by).agg(F.sort_array(F.collect_list(edge)).alias("edges"), *keep)


def with_merged(grid: DataFrame, pieces: Pieces) -> DataFrame:
    """Adds the ids of each unit by a BPE model, from packed edges: the fold's state is a mask of the borders left."""
    unit, edges = F.col("unit"), F.col("edges")
    one = F.lit(1).cast("long")
    shift = lambda a, n: F.call_function("shiftleft", a, n)
    start = lambda x: F.shiftright(x, 20).bitwiseAND(63).cast("int")
    end = lambda x: F.shiftright(x, 26).bitwiseAND(63).cast("int")
    ends = lambda x: shift(one, start(x)).bitwiseOR(shift(one, end(x)))
    inside = lambda x: shift(one, end(x)) - shift(one, start(x) + 1)  # noqa: E731  the borders between

    def step(m: Column, x: Column) -> Column:
        take = (F.bitwise_not(m).bitwiseAND(ends(x)) == 0) & (F.bit_count(m.bitwiseAND(inside(x))) == 1)
        return F.when(take, m - m.bitwiseAND(inside(x))).otherwise(m)

    borders = F.aggregate(F.filter(edges, lambda x: end(x) - start(x) > 1), shift(one, F.length(unit) + 1) - 1, step)
    left = F.filter(edges, lambda x: (F.bitwise_not(F.col("borders")).bitwiseAND(ends(x)) == 0) & (F.col("borders").bitwiseAND(inside(x)) == 0))
    path = F.sort_array(F.transform(left, lambda x: F.shiftleft(F.shiftright(x, 20).bitwiseAND(63), 20).bitwiseOR(x.bitwiseAND(_ID))))
    known = F.transform("path", lambda x: x.bitwiseAND(_ID).cast("int"))
    each = F.transform("path", lambda x: F.when(x.bitwiseAND(_ID) != _ID, F.array(x.bitwiseAND(_ID).cast("int"))).otherwise(_other(pieces, F.substring(unit, F.shiftright(x, 20).cast("int") + 1, F.lit(1)))))
    return grid.withColumn("borders", borders).withColumn("path", path).withColumn("path_ids", known).withColumn("ids", F.when(F.array_contains("path_ids", _ID), F.flatten(each)).otherwise(F.col("path_ids")))


def viterbi(unit: Column, edges: Column) -> Column:
    """Ids of a unit by a unigram model: edges come by end, and each end keeps its best cost and path; of equal costs
    the longer last piece stays."""
    blank = F.struct(F.lit(float("inf")).alias("cost"), F.array().cast("array<int>").alias("ids"))
    start = F.transform(F.sequence(F.lit(0), F.length(unit)), lambda i: F.when(i == 0, F.struct(F.lit(0.0).alias("cost"), F.array().cast("array<int>").alias("ids"))).otherwise(blank))

    def step(best: Column, x: Column) -> Column:
        before = F.get(best, x["s"])
        cost = before["cost"] + x["rank"]
        new = F.struct(cost.alias("cost"), F.concat(before["ids"], x["ids"]).alias("ids"))
        return F.transform(best, lambda b, i: F.when((i == x["e"]) & (cost < b["cost"]), new).otherwise(b))

    return F.element_at(F.aggregate(edges, start, step), -1)["ids"]


class Merger:
    """Ids of one unit by a BPE model: of all neighbours that make a piece the best, leftmost pair is joined, until none is
    left. The neighbours wait in a heap, so a unit of n characters takes n log n steps."""

    def __init__(self, pieces: Pieces) -> None:
        self.score = {p: s for p, _, s in pieces.table}
        self.id = {p: i for p, i, _ in pieces.table}
        self.byte_ids, self.unknown = pieces.byte_ids, pieces.unknown

    def ids(self, unit: str) -> list[int]:
        n = len(unit)
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))  # by start of a part
        agenda: list[tuple[float, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < n and (score := self.score.get(unit[a : end[b]])) is not None:
                heapq.heappush(agenda, (-score, a, b, end[b]))

        for i in range(n - 1):
            offer(i, i + 1)
        alive = bytearray(b"\x01" * n)
        while agenda:
            _, a, b, stop = heapq.heappop(agenda)
            if not (alive[a] and alive[b]) or after[a] != b or end[b] != stop:
                continue
            alive[b], end[a], after[a] = 0, stop, after[b]
            if after[b] < n:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        out: list[int] = []
        a = 0
        while a < n:
            part = unit[a : end[a]]
            out += [self.id[part]] if part in self.id else [self.byte_ids[x] for x in part.encode()] if self.byte_ids else [self.unknown]
            a = end[a]
        return out


def encoded_units(units: DataFrame, pieces: Pieces, tasks: int | None = None) -> DataFrame:
    """All columns of `units` (unit: not empty, distinct, or with `block` if there is one) and ids; the lattices are dealt
    to so many tasks."""
    if pieces.unigram:
        return lattice(units, pieces).withColumn("ids", viterbi(F.col("unit"), F.col("edges"))).drop("edges")
    rest = [f.simpleString().replace(":", " ", 1) for f in units.schema.fields if f.name != "unit"]
    names = [c for c in units.columns if c != "unit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = None
        for batch in batches:
            for part in common.pieces(batch, "unit"):
                merger = merger or Merger(pieces)
                ids = [merger.ids(u) for u in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32()))], names=["unit", *names, "ids"])

    fits = F.length("unit") < MASK
    # dealt by unit before substrings are exploded, so that edges are grouped where they are made
    placed = units.where(fits).repartition(max(tasks or 0, common.shuffle_parts(units.sparkSession)), "unit")
    short = with_merged(packed_lattice(placed, pieces), pieces).select("unit", *names, "ids")
    long = units.where(~fits).select("unit", *names).mapInArrow(common.trimmed(run), ", ".join(["unit string", *rest, "ids array<int>"]))
    return short.unionByName(long)


def blobs(docs: DataFrame, chunks: int, id_col: str, text_col: str) -> DataFrame:
    """chunk, ids, sizes and the compressed texts of some documents to a row. A document's chunk depends on its id and text
    alone, so it is the same whenever the documents are read again, in whatever order they come."""
    names = ["chunk", "ids", "sizes", "z"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=9)
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            chunk = table["chunk"].to_numpy()
            order = np.argsort(chunk, kind="stable")
            table, chunk = table.take(pa.array(order)), chunk[order]  # once: what is of one chunk is then a slice
            edges = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
            for low, high in zip(edges[:-1], edges[1:]):
                part = table.slice(low, high - low)
                raw, at = common.text_bytes(part["t"])
                z = c.compress(raw)
                yield pa.RecordBatch.from_arrays([pa.array([chunk[low]], pa.int64()), pa.array([part["i"].to_pylist()], pa.list_(pa.int64())), pa.array([np.diff(at)], pa.list_(pa.int64())), pa.array([z], pa.binary())], names=names)

        for batch in batches:
            for part in common.pieces(batch, "t"):
                held.append(part)
                size += part.nbytes
                if size >= BLOB_BYTES:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()

    ident, text = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.pmod(common.text_key(ident, text), F.lit(chunks)).cast("long").alias("chunk"), ident.alias("i"), text.alias("t"))
    return rows.mapInArrow(common.trimmed(run), "chunk long, ids array<long>, sizes array<long>, z binary").repartition(chunks, "chunk")


def _texts(ids: list, sizes: list[int], z: bytes) -> Iterator[tuple[int | None, str]]:
    raw, at = zstandard.ZstdDecompressor().decompress(z), 0
    for i, n in zip(ids, sizes):
        yield i, raw[at : at + n].decode("utf-8", "surrogatepass")
        at += n


def _groups(ids: list, sizes: list[int], z: bytes) -> Iterator[tuple[list, list[str]]]:
    """A blob's documents in groups of about CUT_CHARS characters: ids and texts."""
    own: tuple[list, list[str]] = ([], [])
    held = 0
    for i, text in _texts(ids, sizes, z):
        own[0].append(i)
        own[1].append(text)
        held += len(text)
        if held >= CUT_CHARS:
            yield own
            own, held = ([], []), 0
    if own[0]:
        yield own


def _marked(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def encode(docs: DataFrame, pieces: Pieces, *, chunks: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and piece_ids (little-endian unsigned 32-bit integers) for each row, as SentencePiece gives them.

    Null counts as empty, and an empty text has no ids. Rows with equal ids or texts are encoded one by one, texts of any
    length whole, an empty table gives no rows, and other columns are not read. A chunk's units are told apart by 64 bits
    of hash. The documents are read twice, in any order; should a text differ the second time, it is an error.
    """
    spark = docs.sparkSession
    n = chunks or common.text_chunks(docs, text_col, CHUNK_CHARS)
    parts = blobs(docs, n, id_col, text_col)

    def units_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, at, seen = Cutter(pieces), None, np.empty(0, np.uint64)
        for batch in batches:
            for chunk, *blob in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if chunk != at:  # a task's chunks come one after the other
                    at, seen = chunk, np.empty(0, np.uint64)
                for _, texts in _groups(*blob):
                    h, _, flat, begin, end = cutter.units(texts)
                    values, where = np.unique(h, return_index=True)
                    place = np.searchsorted(seen, values)
                    lacks = np.append(seen, values[-1:] + np.uint64(1))[place] != values
                    new = where[lacks]
                    if len(new):
                        seen = np.insert(seen, place[lacks], values[lacks])
                        own = pa.array([flat[a:b] for a, b in zip(begin[new].tolist(), end[new].tolist())], pa.binary()).cast(pa.string())
                        yield pa.RecordBatch.from_arrays([own, pa.array(np.full(len(new), chunk), pa.int64())], names=["unit", "chunk"])

    held = parts.sortWithinPartitions("chunk").mapInArrow(common.trimmed(units_of), "unit string, chunk long")
    # as many tasks as the lattices have, so that each holds few units
    units = held.repartition(max(LATTICE_TASKS * n, common.shuffle_parts(spark)), "unit").groupBy("unit", F.floor(F.col("chunk") / BLOCK).alias("block")).agg(F.collect_list("chunk").alias("chunks"))
    units = common.written(units, "units")
    common.release(spark)
    known = common.written(encoded_units(units, pieces, LATTICE_TASKS * n).select("unit", "chunks", "ids"), "unit-ids")
    common.discard(units)
    by_chunk = known.select(F.explode("chunks").alias("chunk"), "unit", "ids")

    def run(docs_: pa.Table, model: pa.Table) -> pa.Table:
        model = model.combine_chunks()
        raw, place = common.text_bytes(model["unit"])
        h = common.span_hashes(common.byte_values(raw), place[:-1], place[1:])
        order = np.argsort(h)
        h = h[order]
        flat = model["ids"].combine_chunks()
        at = np.asarray(flat.offsets, np.int64) if len(model) else np.zeros(1, np.int64)
        values = np.asarray(flat.flatten(), np.uint32) if len(model) else np.empty(0, np.uint32)
        at = at - at[0]
        cutter = Cutter(pieces)
        out_ids, out = [], []
        for blob in zip(*(docs_[c].to_pylist() for c in ("ids", "sizes", "z"))):
            for ids, texts in _groups(*blob):
                mine, counts, *_ = cutter.units(texts)
                k = np.searchsorted(h, mine)
                if len(mine) and not (len(h) and (h[np.minimum(k, len(h) - 1)] == mine).all()):
                    raise RuntimeError("a unit of the chunk has no ids: the documents changed while they were read")
                k = order[k]
                first = at[k]
                size = at[k + 1] - first
                ends = np.cumsum(size)
                got = values[np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)].astype("<u4")
                bounds = np.concatenate([[0], ends])[np.cumsum(counts)]
                out_ids += ids
                out.append(pa.array([x.tobytes() for x in np.split(got, bounds[:-1])], pa.binary()))
        return pa.Table.from_arrays([pa.array(out_ids, pa.int64()), pa.chunked_array(out, pa.binary())], names=["id", "piece_ids"])

    return parts.groupBy("chunk").cogroup(by_chunk.groupBy("chunk")).applyInArrow(common.trimmed(run), "id long, piece_ids binary")


def decode(rows: DataFrame, pieces: Pieces) -> DataFrame:
    """id and text of rows with id and piece_ids; bytes that are not UTF-8 become replacement characters. No ids or null
    give an empty text, rows are decoded one by one, and an empty table stays empty."""
    out_of: dict[int, bytes] = {i: p.replace(SPACE, " ").encode() for p, i, _ in pieces.table} | {i: bytes([b]) for b, i in enumerate(pieces.byte_ids)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for x in batch.column(1).to_pylist():
                text = b"".join(map(out_of.__getitem__, np.frombuffer(x or b"", "<u4").tolist())).decode("utf-8", "replace")
                texts.append(text[1:] if text[:1] == " " else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return rows.select("id", "piece_ids").mapInArrow(common.trimmed(run), "id long, text string")


def summary(rows: DataFrame, pieces: Pieces) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 and decoded_sha256, the checksum of the text that the ids decode to; for no ids 0, 0 and
    the empty text's. Rows with null or equal ids are summed up one by one, an empty table stays empty."""
    out = {i: p.replace(SPACE, " ").encode() for p, i, _ in pieces.table} | {i: bytes([b]) for b, i in enumerate(pieces.byte_ids)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, crc, sha = [], [], []
            for x in batch.column(1).to_pylist():
                x = x or b""
                text = b"".join(map(out.__getitem__, np.frombuffer(x, "<u4").tolist()))
                n.append(len(x) // 4)
                crc.append(zlib.crc32(x))
                sha.append(hashlib.sha256(text[1:] if text[:1] == b" " else text).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_pieces", "ids_crc32", "decoded_sha256"])

    return rows.select("id", "piece_ids").mapInArrow(common.trimmed(run), "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: the number of pieces of each of `documents`, checksums of the ids and of the text decoded from them."""
    return report(common.load(spark, sf_dir, "documents"))


def report(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    common.tune(docs.sparkSession)
    pieces = load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return summary(encode(docs, pieces), pieces)
