"""The price model's tables, and their projection from the star-schema test tables.

Prices are whole cents, so sums and rounded averages are exact on any engine.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Model:
    """Tables of one snapshot of the data, and the time that counts as now, or a function that finds it when it is asked
    for. `listed` may have the price records with what they would be joined with: product_id and status (null without a
    link), store_id and corrected; then nothing is joined."""

    product: DataFrame
    store: DataFrame
    category: DataFrame
    sku: DataFrame
    link: DataFrame
    price: DataFrame
    correction: DataFrame
    clock: datetime | Callable[[], datetime]
    listed: DataFrame | None = None

    @cached_property
    def now(self) -> datetime:
        return self.clock() if callable(self.clock) else self.clock


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """Rows dealt to all tasks by columns, where a small file has much work in each row."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def kept(rows: DataFrame) -> DataFrame:
    """Rows that are read more than once, as compressed Parquet in the checkpoint folder, a tenth of what a checkpoint of many
    short rows takes. Shuffle files of what made them are let go."""
    spark = rows.sparkSession
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/kept-{uuid.uuid4().hex[:12]}"
    rows.write.option("compression", "zstd").parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(rows.schema).parquet(path)


#: A listing's id is its product's key times this and its store's key, which is below it at any size; products of up to
#: 900 million keys fit (beyond them Spark raises an error).
STORES = 10_000_000_000


def sku_id() -> F.Column:
    return F.col("l_partkey") * F.lit(STORES) + F.col("l_suppkey")


def from_star(spark: SparkSession, sf_dir: str) -> Model:
    """part → product, supplier → store, nation under region → category, lineitem → price record."""
    part, supplier, nation, region, lineitem = (read(spark, sf_dir, t) for t in ("part", "supplier", "nation", "region", "lineitem"))
    roots = region.select((F.col("r_regionkey") + 100).alias("category_id"), F.lower("r_name").alias("slug"), F.col("r_name").alias("name"), F.lit(None).cast("int").alias("parent_id"), F.lower("r_name").alias("path"))
    leaves = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.col("n_nationkey").alias("category_id"), F.lower("n_name").alias("slug"), F.col("n_name").alias("name"), (F.col("r_regionkey") + 100).alias("parent_id"), F.concat_ws("/", F.lower("r_name"), F.lower("n_name")).alias("path"))
    product = part.select(F.col("p_partkey").alias("product_id"), F.concat_ws("-", F.regexp_replace("p_name", " ", "-"), F.col("p_partkey").cast("string")).alias("slug"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), (F.col("p_partkey") % 25).cast("int").alias("category_id"), F.col("p_size").alias("size"))
    store = supplier.select(F.col("s_suppkey").alias("store_id"), F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))).alias("slug"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 10 != 0).alias("is_active"))
    rows = lineitem.select(
        sku_id().alias("sku_id"), "l_partkey", "l_suppkey",
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("price"),
        F.timestamp_add("SECOND", F.col("l_orderkey") % 86_400, F.col("l_shipdate").cast("timestamp")).alias("captured_at"),
        (F.col("l_discount") >= 0.05).alias("promo"), (F.col("l_returnflag") == "R").alias("suspect"),
    )
    own = [F.expr(f"sku_id div {STORES}").alias("product_key"), (F.col("sku_id") % F.lit(STORES)).alias("store_id")]
    sku = rows.groupBy("sku_id").agg(F.max("captured_at").alias("last_seen_at")).select("sku_id", *own, "last_seen_at")
    m = F.col("sku_id") % 7
    status = F.when(m == 0, "pending_review").when(m == 1, "rejected").when(m == 2, "confirmed").otherwise("auto")
    link = sku.where("sku_id % 11 != 0").select("sku_id", F.col("product_key").alias("product_id"), status.alias("status"), F.when(m < 3, "ean").otherwise("semantic").alias("method"))
    # one record for each listing, time and kind: the cheapest, as a later one with the same key changes nothing; both kinds
    # come from one aggregation by listing and time, which also tells whether the time was corrected
    best = lambda kind: F.min(F.when(F.col("promo") == kind, F.struct("price", "suspect"))).alias("yes" if kind else "no")
    odd = lambda kind: F.coalesce(F.col(f"{kind}.price") % 97 == 0, F.lit(False))
    both = rows.groupBy("sku_id", "captured_at").agg(best(True), best(False)).withColumn("corrected", odd("yes") | odd("no"))
    kinds = F.array(F.struct(F.lit(True).alias("promo"), F.col("yes").alias("r")), F.struct(F.lit(False).alias("promo"), F.col("no").alias("r")))
    flat = both.select("sku_id", "captured_at", "corrected", F.explode(F.filter(kinds, lambda k: k["r"].isNotNull())).alias("k"))
    price = flat.select("sku_id", "captured_at", "k.promo", "k.r.price", "k.r.suspect", "corrected")
    correction = both.where("corrected").select("sku_id", "captured_at")
    linked = F.col("sku_id") % 11 != 0
    listed = price.select("*", F.when(linked, F.expr(f"sku_id div {STORES}")).alias("product_id"), F.when(linked, status).alias("status"), own[1])
    clock = lambda: lineitem.agg(F.max("l_shipdate")).first()[0]  # noqa: E731  one value
    return Model(product, store, roots.unionByName(leaves), sku, link, price.drop("corrected"), correction, clock, listed)


#: The same projection as common table expressions.
SQL = """
clock AS (SELECT max(l_shipdate)::TIMESTAMP AS now FROM lineitem),
category AS (
  SELECT (r_regionkey + 100)::INTEGER AS category_id, lower(r_name) AS slug, r_name AS name, NULL::INTEGER AS parent_id, lower(r_name) AS path FROM region
  UNION ALL SELECT n_nationkey::INTEGER, lower(n_name), n_name, (r_regionkey + 100)::INTEGER, lower(r_name) || '/' || lower(n_name) FROM nation JOIN region ON n_regionkey = r_regionkey),
product AS (SELECT p_partkey AS product_id, replace(p_name, ' ', '-') || '-' || p_partkey AS slug, p_name AS name, p_brand AS brand, (p_partkey % 25)::INTEGER AS category_id, p_size AS size FROM part),
store AS (SELECT s_suppkey AS store_id, lower(replace(s_name, '#', '-')) AS slug, s_name AS name, s_suppkey % 10 <> 0 AS is_active FROM supplier),
item AS (
  SELECT l_partkey * 10000000000 + l_suppkey AS sku_id, l_partkey, l_suppkey, round(l_extendedprice * 100)::BIGINT AS price,
    l_shipdate::TIMESTAMP + to_seconds(l_orderkey % 86400) AS captured_at, l_discount >= 0.05 AS promo, l_returnflag = 'R' AS suspect FROM lineitem),
sku AS (SELECT sku_id, any_value(l_partkey) AS product_key, any_value(l_suppkey) AS store_id, max(captured_at) AS last_seen_at FROM item GROUP BY sku_id),
link AS (
  SELECT sku_id, product_key AS product_id, CASE sku_id % 7 WHEN 0 THEN 'pending_review' WHEN 1 THEN 'rejected' WHEN 2 THEN 'confirmed' ELSE 'auto' END AS status,
    CASE WHEN sku_id % 7 < 3 THEN 'ean' ELSE 'semantic' END AS method FROM sku WHERE sku_id % 11 <> 0),
price AS (SELECT sku_id, captured_at, promo, min(price) AS price, arg_min(suspect, price * 2 + suspect::INTEGER) AS suspect FROM item GROUP BY ALL HAVING true),
correction AS (SELECT DISTINCT sku_id, captured_at FROM price WHERE price % 97 = 0)
"""
SQL = SQL.replace("FROM item GROUP BY ALL HAVING true", "FROM item GROUP BY sku_id, captured_at, promo")


def rank(by: list[str], order: list[F.Column]) -> F.Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))
