"""Flat outputs: CSV with semicolons, serving tables by version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv(rows: DataFrame, path: str) -> None:
    """Semicolons, a header, quotes where a cell needs them; files by task, in the rows' order. The header begins with a
    byte order mark, by which spreadsheets know UTF-8."""
    first = rows.columns[0]
    rows.withColumnRenamed(first, "\ufeff" + first).write.mode("overwrite").option("sep", ";").option("header", True).option("lineSep", "\r\n").option("escape", "\"").csv(path)


def serving(tables: dict[str, DataFrame], root: str, version: str) -> None:
    """Each table under its version's folder, so that readers see a whole one."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{version}/{name}")


def synced(old: DataFrame, new: DataFrame, key: list[str], mode: str, seen_since=None) -> DataFrame:
    """A serving table after a sync: `replace` takes the new rows, `upsert` puts them over the old ones by key, and
    `close_offers` does so and drops what was not seen since the sync began (column last_seen_at)."""
    if mode == "replace":
        return new
    rows = old.join(new.select(*key), key, "left_anti").unionByName(new)
    return offers_still_open(rows, seen_since) if mode == "close_offers" else rows


def offers_still_open(old: DataFrame, seen_since, column: str = "last_seen_at") -> DataFrame:
    """Offers that the last sync saw; the others are closed."""
    return old.where(F.col(column) >= F.lit(seen_since))
