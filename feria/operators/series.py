"""The daily series as a versioned table that is refreshed by days.

A version is a manifest: for each day the folder that has it. A refresh computes the days that changed, writes them as a
folder of their own, and then a manifest in which only these days differ; readers follow the newest manifest that was
written to its end, so they never see half a refresh, and days that did not change are neither read nor written.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feria.operators import prices
from feria.schemas import RULES, Rules
from feria.sources.model import Model

ROWS = "product_id long, min_price long, avg_price long, records long"
_MANIFEST = "day date, version int"


def _path(spark: SparkSession, where: str):
    return spark._jvm.org.apache.hadoop.fs.Path(where), spark._jsc.hadoopConfiguration()


def versions(spark: SparkSession, home: str) -> list[int]:
    """Versions whose manifest was written to its end, oldest first."""
    where, conf = _path(spark, f"{home}/manifest")
    fs = where.getFileSystem(conf)
    if not fs.exists(where):
        return []
    found = [s.getPath() for s in fs.listStatus(where)]
    return sorted(int(p.getName().split("=")[1]) for p in found if fs.exists(_path(spark, f"{p.toString()}/_SUCCESS")[0]))


def manifest(spark: SparkSession, home: str, version: int | None = None) -> DataFrame:
    """day and version of the folder that has it, by the newest or the given manifest."""
    have = versions(spark, home)
    if not have:
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).parquet(f"{home}/manifest/version={version or have[-1]}")


def read(spark: SparkSession, home: str, version: int | None = None) -> DataFrame:
    """The series (product_id, day, min_price, avg_price, records) of a version; a filter on days reads only their files."""
    days = manifest(spark, home, version).orderBy("day").collect()  # a row for each day
    if not days:
        return spark.createDataFrame([], ROWS).withColumn("day", F.lit(None).cast("date"))
    folders = [f"{home}/data/version={r.version}/day={r.day.isoformat()}" for r in days]
    got = spark.read.schema(f"{ROWS}, day date, version int").option("basePath", f"{home}/data").parquet(*folders)
    return got.select("product_id", "day", "min_price", "avg_price", "records")


def refresh(m: Model, home: str, days: DataFrame | None = None, rules: Rules = RULES) -> int:
    """Compute the given days (a table of `day`; without: all) anew and write the next version, whose number is returned.

    Days come from what an ingest wrote last, so late records bring their own day back; a day that has no more records
    leaves the manifest. Prices of other days are not read where prices are stored by day.
    """
    spark = m.price.sparkSession
    have = versions(spark, home)
    version = (have[-1] if have else 0) + 1
    if days is not None:
        days = days.select("day").distinct().checkpoint()
        own = lambda df: df.join(F.broadcast(days) if days.count() <= 10_000 else days, F.to_date("captured_at") == days["day"], "left_semi")
        m = replace(m, price=own(m.price), listed=None if m.listed is None else own(m.listed))
    rows = prices.daily_series(m, rules)
    rows.select("product_id", "min_price", "avg_price", "records", "day").repartition("day").write.mode("overwrite").partitionBy("day").parquet(f"{home}/data/version={version}")
    written = spark.read.schema(f"{ROWS}, day date").parquet(f"{home}/data/version={version}").select("day").distinct().select("day", F.lit(version).alias("version"))
    if days is not None:
        written = written.unionByName(manifest(spark, home).join(days, "day", "left_anti"))
    written.coalesce(1).write.mode("overwrite").parquet(f"{home}/manifest/version={version}")  # a row for each day
    return version
