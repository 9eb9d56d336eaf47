"""Sources of pages as Spark data sources: one reader for any shop that has categories of pages.

A `Shop` says which categories there are and gives a category's pages one after the other. Each category is a partition, so
Spark reads them side by side and reads one again after a lost executor. What goes wrong in a category is a row of its own
and leaves the others alone; a shop fails only if nothing came and something went wrong.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "store string, category string, page int, payload string, error string"


@dataclass(frozen=True)
class Shop:
    """A shop: its name, a function that lists its categories, and one that gives page n of a category, null after the
    last. Both are sent to executors, so they carry all they need."""

    name: str
    categories: Callable[[], list[str]]
    page: Callable[[str, int], str | None]
    most_pages: int = 200


class NothingArrived(RuntimeError):
    """A shop gave no page, and its first error says why."""


class _Category(InputPartition):
    def __init__(self, category: str | None, error: str | None = None) -> None:
        super().__init__(category)
        self.category, self.error = category, error


def _source(shop: Shop) -> type[DataSource]:
    """The data source of a shop; its format is the shop's name."""

    class Reader(DataSourceReader):
        def partitions(self) -> list[_Category]:
            try:
                return [_Category(c) for c in shop.categories()] or [_Category(None)]
            except Exception as e:  # the shop's list itself is out of reach: one row says so
                return [_Category(None, repr(e))]

        def read(self, partition: _Category) -> Iterator[tuple]:
            if partition.error:
                yield (shop.name, None, None, None, partition.error)
            if partition.category is None:
                return
            for n in range(shop.most_pages):
                try:
                    payload = shop.page(partition.category, n)
                except Exception as e:  # the category ends here, the others go on
                    yield (shop.name, partition.category, n, None, repr(e))
                    return
                if payload is None:
                    return
                yield (shop.name, partition.category, n, payload, None)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return f"shop-{shop.name}"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema: object) -> Reader:
            return Reader()

    return Source


def pages(spark: SparkSession, shops: list[Shop]) -> DataFrame:
    """store, category, page, payload and error of all pages of all shops, as one table; rows have a payload or an error.
    A shop without categories has no rows."""
    parts = []
    for shop in shops:
        source = _source(shop)
        spark.dataSource.register(source)
        parts.append(spark.read.format(source.name()).load())
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], SCHEMA)


def arrivals(rows: DataFrame) -> DataFrame:
    """store, pages, errors, categories that broke off (sorted) and first_error, a row for each shop that has rows."""
    bad = F.col("error").isNotNull()
    return rows.groupBy("store").agg(F.count("payload").alias("pages"), F.count("error").alias("errors"), F.sort_array(F.collect_set(F.when(bad, F.col("category")))).alias("broken"), F.min_by("error", F.struct("category", "page")).alias("first_error"))


def arrived(rows: DataFrame) -> DataFrame:
    """The pages of a written table of pages, without errors; raises if a shop has errors and no page."""
    lost = arrivals(rows).where("pages = 0 and errors > 0").orderBy("store").limit(1).collect()
    if lost:
        raise NothingArrived(f"{lost[0].store}: {lost[0].first_error}")
    return rows.where("payload is not null").drop("error")
