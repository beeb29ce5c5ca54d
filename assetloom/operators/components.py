"""Connected components with the smallest member as label, without collecting any link."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(links: DataFrame, kept: Callable[[DataFrame], DataFrame], most_rounds: int = 60, broadcast_rows: int = 1_000_000) -> DataFrame:
    """node, label for every node of links (a long, b long).

    Links are kept as (u, v), u > v. A round hangs what hangs on a node on that node's own smallest neighbour, if it has a
    smaller one (large star), and then joins each node's several smaller neighbours by their smallest (small star), until
    the links form stars. Only nodes that have both larger and smaller neighbours, or several smaller ones, take part: stars
    that are done meet nothing, so the links of a centre never gather in one task for being many. The few nodes that still
    change go to the links (broadcast below ``broadcast_rows``, checked by counting; a skewed shuffle join beyond).
    ``kept`` stores what a round made and cuts its lineage."""
    edges = kept(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    few = lambda df: F.broadcast(df) if df.count() <= broadcast_rows else df
    for _ in range(most_rounds):
        ends = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.lit(None).cast("long").alias("v")))
        open_ = ends.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("other"), F.max(F.col("v").isNull()).alias("larger"))
        open_ = kept(open_.where("m is not null and (larger or m <> other)"))
        if not open_.limit(1).count():
            break
        hung = edges.join(few(open_.where("larger").select(F.col("u").alias("v"), "m")), "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        least = hung.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("other"))
        several = kept(least.where("m <> other").select("u", "m"))
        moved = hung.join(few(several), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = kept(least.select("u", F.col("m").alias("v")).union(moved).distinct())
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
