"""Operator 2: exact duplicates by a stateful stream with disk-backed keyed state.

Arrivals (a locator, the id, the digest and the text) are appended once to the content store. A Structured Streaming
query reads the store in micro-batches and keeps, for each digest, the row that stays and the number of rows, in RocksDB
and without expiry; Spark combines equal digests of a micro-batch before it shuffles them. With a state folder of one's
own a later call's arrivals meet the state of all earlier calls. The locator (call and row number) leads to the content:
each hit's full bytes are compared with the retained row's, and where a digest holds different contents its rows are
grouped again by the content itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feria.llm import common

FILES_PER_BATCH = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z lower-cased and nothing else changed."""
    return raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)


def content_of(text: Column) -> Column:
    """What two equal texts have in common: null as empty, A-Z lower-cased."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def arrivals(docs: DataFrame, call: int, digest: Callable[[bytes], bytes], id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    ident, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), ident.alias("id"), common.text_key(ident, F.coalesce(text, F.lit(""))).alias("key"), text.alias("t"), F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in carry]).alias("carried"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.pieces(batch, "t"):
                raw, at = common.text_bytes(part.column(3))
                flat = lower_ascii(raw).tobytes()
                digests = pa.array([digest(flat[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, call, np.int32)), *(part.column(k) for k in range(3)), digests, part.column(3), part.column(4)], names=["call", "row", "id", "key", "digest", "text", "carried"])

    schema = T.StructType.fromDDL("call int, row long, id long, key long, digest binary, text string").add("carried", rows.schema["carried"].dataType)
    return rows.mapInArrow(common.trimmed(run), schema)


def sha256(content: bytes) -> bytes:
    return hashlib.sha256(content).digest()


def _streamed(spark: SparkSession, schema: T.StructType, home: str, files_per_batch: int) -> DataFrame:
    """Run the stream over what the store has gained; digest, keep (id, call and row) and n of every digest ever seen."""
    kept = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{home}/content")
        state = stream.groupBy("digest").agg(F.max(F.struct("id", "call", "row")).alias("keep"), F.count(F.lit(1)).alias("n"))
        ran = state.writeStream.outputMode("update").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(f"{home}/changed/epoch={epoch}")).start()
        ran.awaitTermination()
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    log = T.StructType.fromDDL("digest binary, keep struct<id:long,call:int,row:long>, n long, epoch int")
    changed = spark.read.schema(log).option("basePath", f"{home}/changed").parquet(f"{home}/changed") if common.exists(spark, f"{home}/changed") else spark.createDataFrame([], log)
    return changed.groupBy("digest").agg(F.max(F.struct("n", "keep")).alias("s")).select("digest", "s.keep", "s.n")  # a digest's last state has its largest count


def dedup(docs: DataFrame, *, home: str | None = None, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[bytes], bytes] = sha256, files_per_batch: int = FILES_PER_BATCH, carry: list[str] | None = None) -> DataFrame:
    """One row per input row: id, key (text_key of id and text), digest, text, kept, keep_id, group_size and carried, a
    struct of the columns named in `carry`.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, and empty texts equal each other. Of
    equal texts the row with the largest id stays (a null id is the smallest; of equal ids, the later row), so exactly
    one row of a group is kept. An empty table gives no rows. Texts of any length are compared whole; other columns are
    not read. `home` is a shared folder with the state and contents of earlier calls: then groups reach over all of
    them, and only this call's rows are returned (with the same `carry` and `digest` each time).
    """
    spark = docs.sparkSession
    common.tune(spark)
    home = home or common.shared_dir(spark, "stream-dedup")
    store = f"{home}/content"
    call = (spark.read.parquet(store).agg(F.max("call")).first()[0] or 0) + 1 if common.exists(spark, store) else 1
    came = arrivals(docs, call, digest, id_col, text_col, carry or [])
    came.write.option("compression", "zstd").mode("append").parquet(store)
    schema = came.schema
    last = common.written(_streamed(spark, schema, home, files_per_batch), "stream-state")
    rows = spark.read.schema(schema).parquet(store)
    mine = rows.where(F.col("call") == call)
    many = last.where("n > 1")
    if call > 1:
        many = many.join(mine.select("digest").distinct(), "digest", "left_semi")
    hits = common.written(common.hot_join(rows.select("call", "row", "digest"), many, ["digest"], "n").where("row != keep.row or call != keep.call"), "hits")
    need = hits.select("call", "row").union(many.select("keep.call", "keep.row")).distinct()
    texts = rows.select("call", "row", "text").join(need, ["call", "row"], "left_semi")
    texts = common.written(texts.select("call", "row", content_of(F.col("text")).alias("content")), "hit-texts")
    common.release(spark)
    retained = texts.select(F.struct("call", "row").alias("at"), F.col("content").alias("was"))
    compared = hits.withColumn("at", F.struct("keep.call", "keep.row")).join(texts, ["call", "row"]).join(retained, "at")
    unlike = common.written(compared.where("content != was").select("digest").distinct(), "unlike")
    common.discard(hits, texts)
    cols = ["id", "key", "digest", "text", "kept", "keep_id", "group_size", "carried"]
    same = last
    apart = not unlike.isEmpty()
    if apart:
        same = common.written(last.join(unlike, "digest", "left_anti"), "true-groups")
    got = common.hot_join(mine, same, ["digest"], "n").withColumn("kept", F.expr("row = keep.row and call = keep.call")).withColumns({"keep_id": F.col("keep.id"), "group_size": F.col("n")}).select(*cols)
    if apart:
        mixed = rows.join(unlike, "digest", "left_semi").withColumn("content", content_of(F.col("text")))
        again = mixed.groupBy("digest", "content").agg(F.max(F.struct("id", "call", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        more = mixed.where(F.col("call") == call).join(again, ["digest", "content"]).withColumn("kept", F.expr("row = keep.row and call = keep.call")).withColumn("keep_id", F.col("keep.id"))
        got = got.unionByName(more.select(*cols))
    got.home = home
    return got


def distinct(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text and more) that stay, all columns as they were."""
    got = dedup(docs)
    same = got.groupBy("key", "id").agg(F.count_if("kept").alias("kept"), F.count(F.lit(1)).alias("copies")).where("kept > 0")
    keep = common.written(same.select("id", "key", "copies"), "kept")
    common.delete(docs.sparkSession, got.home)
    common.release(docs.sparkSession)
    return common.rows_of(docs, keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: for each of `documents`, the equal document that stays."""
    got = dedup(common.load(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


#: What op2 returns, as SQL over `documents` with ids that are set and differ.
ORACLE = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256 FROM t JOIN g USING (norm)
"""
