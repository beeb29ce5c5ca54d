"""Connected components, with every round as a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assetloom.llm.common import staged
from assetloom.operators import components as stars


def components(spark: SparkSession, links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, label for every node of links (a long, b long)."""
    return stars.components(links, lambda df: staged(spark, df, "edges"), most_rounds)
