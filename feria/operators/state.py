"""Changes to tables as pure functions: old rows and changes in, new rows out. Parquet is then written anew by version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feria.sources.model import rank


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key: new rows win over old ones, among new ones the highest `order`, and among equal ones the
    greatest by all other columns, so that a result never depends on the order of rows."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return rows.withColumn("_r", rank(key, [F.col("_new").desc(), F.col(order).desc(), *[F.col(c).desc() for c in old.columns if c not in (*key, order)]])).where("_r = 1").drop("_r", "_new")


def insert_new(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Old rows, and of the new ones the first of each key that is not there yet (of equal `order` the least by all other
    columns)."""
    first = new.withColumn("_r", rank(key, [F.col(order).asc(), *[F.col(c).asc() for c in new.columns if c not in (*key, order)]])).where("_r = 1").drop("_r")
    return old.unionByName(first.join(old.select(*key), key, "left_anti"))


def monotone(old: DataFrame, new: DataFrame, key: str, amount: str) -> DataFrame:
    """The largest amount of each key so far."""
    return old.select(key, amount).unionByName(new.select(key, amount)).groupBy(key).agg(F.max(amount).alias(amount))


def cascade(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each table without the rows of removed keys (under the column named beside it)."""
    return {name: df.join(gone.select(F.col(key).alias(col)), col, "left_anti") for name, (df, col) in tables.items()}


def retained(prices: DataFrame, now, months: int) -> DataFrame:
    """Records of the last `months` whole months, with their month, by which they are written."""
    edge = F.add_months(F.trunc(F.lit(now), "month"), -months)
    return prices.withColumn("month", F.date_format("captured_at", "yyyy-MM")).where(F.col("captured_at") >= edge)


def append_months(prices: DataFrame, path: str) -> None:
    """Append-only write, a folder for each month."""
    prices.write.mode("append").partitionBy("month").parquet(path)
