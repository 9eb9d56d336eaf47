"""Connected components of a table of links, its rounds written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from feria.llm import common
from feria.operators.matching import min_labels


def components(links: DataFrame) -> DataFrame:
    """node and component (its least node) for every node of the links (columns a and b)."""
    return min_labels(links, keep=lambda df: common.written(df, "labels"), drop=common.discard)
