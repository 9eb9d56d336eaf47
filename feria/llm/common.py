"""Helpers shared by the training-data operators: shared folders, materialised steps, Arrow text to numpy."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words, as bytes.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
#: Rows in an Arrow batch: texts can be long, so a batch is kept to a few MB.
ARROW_ROWS, ARROW_BYTES = 512, "4m"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI under ``spark.checkpoint.dir``; only a local session may fall back to a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="feria-")
        spark.sparkContext.setCheckpointDir(base)
    if "://" not in base and not base.startswith("file:"):
        base = "file://" + base if base.startswith("/") else base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, so that a Python worker holds a few MB of text at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder as Parquet and read back: lineage is cut and survives lost executors. `discard` deletes
    the folder once every reader has ended."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    got = spark.read.schema(df.schema).parquet(path)
    got.step_path = path
    return got


def delete(spark: SparkSession, path: str) -> None:
    """Remove a step's folder, through Spark's own view of the file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def discard(*steps: DataFrame) -> None:
    """Delete written steps that nothing reads any more, and let Spark drop the shuffle files of what read them."""
    for step in steps:
        delete(step.sparkSession, step.step_path)
    if steps:
        release(steps[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files of steps that have been written since: its cleaner follows the collectors."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: A key with more than one row in so many is hot, and so is one with more than a quarter of what a shuffle's task gets on
#: average: there are at most so many hot keys, or four for each task, whatever the input.
HOT_SHARE = 1000


def hot_join(rows: DataFrame, one: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Inner join of `rows` with `one`, which has a row for each key and the key's number of rows in the column `size`.

    Rows of hot keys (over 1 / HOT_SHARE of all rows, or a quarter of a task's) meet their key where they are, by a
    broadcast of as many rows at most; all others by a shuffle, in which no key is large. Both inputs are read twice, so
    they should be written steps.
    """
    total = one.agg(F.sum(size)).first()[0] or 0
    share = max(HOT_SHARE, 4 * shuffle_parts(rows.sparkSession))
    hot = one.where(F.col(size) * share > total)
    plain = one.where(F.col(size) * share <= total)
    few = F.broadcast(hot.select(*keys))
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(few, keys, "left_anti").join(plain.hint("merge"), keys))


def text_key(ident: Column, text: Column) -> Column:
    """A hash of id and text that tells rows with equal ids apart."""
    return F.xxhash64(ident, text)


def rows_of(docs: DataFrame, keep: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that `keep` names by id, key (text_key of the id as long and the text, null as empty) and copies
    (rows with this id and text): one row for each, all columns as they were."""
    mine = docs.select(F.col(f"`{id_col}`").cast("long").alias("_i"), text_key(F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("_k"), F.struct("*").alias("_row"))
    same = lambda k: mine["_k"].eqNullSafe(k["key"]) & mine["_i"].eqNullSafe(k["id"])
    once, often = keep.where("copies = 1"), keep.where("copies > 1")
    got = mine.join(once, same(once), "left_semi").select("_row.*")
    if often.isEmpty():
        return got
    rest = mine.join(often, same(often), "left_semi").groupBy("_k", "_i").agg(F.first("_row").alias("_row"))
    return got.unionByName(rest.select("_row.*"))


#: Characters of text in a chunk: what one task holds a dictionary for.
CHUNK_CHARS = 24_000_000


def text_chunks(docs: DataFrame, text_col: str = "text", chars: int = CHUNK_CHARS) -> int:
    """The number of chunks that the texts fill; only their total length comes to the driver."""
    total = docs.agg(F.sum(F.length(F.col(f"`{text_col}`")))).first()[0] or 0
    return max(1, -(-total // chars))


def trim() -> None:
    """Hand memory that a worker no longer uses back to the system: workers stay alive between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def trimmed(run: Callable) -> Callable:
    """A function over the batches of a task, or over the tables of a group, that trims its worker when it ends."""

    @functools.wraps(run)
    def over_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    def over_groups(left: pa.Table, right: pa.Table) -> pa.Table:
        got = run(left, right)
        trim()
        return got

    return over_groups if run.__code__.co_argcount == 2 else over_batches


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, nulls as empty, and each row's start, with the end after the last."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    if len(col) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def word_bounds(raw: np.ndarray, at: np.ndarray, inside: np.ndarray = ~_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of each maximal run of the bytes marked in `inside` (without: of non-space bytes) within a row,
    and each row's first word."""
    word = inside[raw]
    edge = np.empty(len(raw), bool)
    if len(raw):
        edge[0] = word[0]
        np.logical_and(word[1:], ~word[:-1], out=edge[1:])
    cut = at[:-1][at[:-1] < len(raw)]
    edge[cut] = word[cut]  # a row's first byte starts a word even if the row before ended in one
    starts = np.flatnonzero(edge)
    last = np.empty(len(raw), bool)
    if len(raw):
        last[-1] = word[-1]
        np.logical_and(word[:-1], ~word[1:] | edge[1:], out=last[:-1])
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of a sequence of unsigned 64-bit values."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    got = (sums[ends] - sums[starts]) * down[starts]
    return mix64(got + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_OTHER = mix64(_TABLE ^ np.uint64(0xA5A5A5A5A5A5A5A5))


def byte_values(raw: np.ndarray, *, other: bool = False) -> np.ndarray:
    """A 64-bit value for each byte; `other` gives those of a second, independent hash."""
    return (_OTHER if other else _TABLE)[raw]


def pieces(batch: pa.RecordBatch, text: str = "text", most: int = 1_500_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text each, one row at least."""
    _, at = text_bytes(batch.column(batch.schema.get_field_index(text)))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, side="right")) - 1)
        yield batch.slice(row, end - row)
        row = end


def safe(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, by exact name, so that extra columns never clash with an operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])
