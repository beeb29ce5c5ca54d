"""Near hashes of a store that grows: an index of band keys beside it, which new hashes probe.

Two ranged tables that only get rows added: the keys of every hash, and what each hash hangs together with. A batch makes
keys of its new hashes alone, meets the stored keys of the ranges that these fall into (the batch's keys are sent to the
stored ones where they are few, checked by counting), and adds its hashes with the group that each joins; groups that a new
hash connects are noted as one. Stored hashes are never compared with each other again, and no pair is kept.

The keys follow from the distance and from the number of hashes that the index is made for; both are noted in the table. More
hashes than that still are found, by longer lists. Hashes whose files are gone stay in the index and may connect others;
``rebuild`` begins anew. A batch that ended between its two tables is simply added again.

Defined results: null hashes take no part; equal hashes are one; a batch of known hashes changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetloom.operators import similarity
from assetloom.operators.components import components
from assetloom.operators.ranges import RangedTable

KEYS = T.StructType([T.StructField("key", T.LongType()), T.StructField("h", T.LongType())])
#: h belongs to the group of ``label``; with merges, the two are groups that are one.
GROUPS = T.StructType([T.StructField("h", T.LongType()), T.StructField("label", T.LongType()), T.StructField("merges", T.BooleanType())])


class NearIndex:
    def __init__(self, spark: SparkSession, root: str, max_distance: int, expected: int = 10_000_000, most_rows: int = 1_000_000, broadcast_rows: int = 1_000_000, kept: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.broadcast_rows = spark, broadcast_rows
        self.kept = kept or (lambda df: df.checkpoint())
        meta = {"max_distance": max_distance, "expected": expected}
        self.keys = RangedTable(spark, f"{root.rstrip('/')}/keys", KEYS, "key", 1, most_rows, meta)
        self.groups = RangedTable(spark, f"{root.rstrip('/')}/groups", GROUPS, "h", 1, most_rows)
        noted = self.keys.noted()
        if noted["max_distance"] != max_distance:
            raise ValueError(f"the index is of distance {noted['max_distance']}")
        self.plan = similarity.Keys(max_distance, noted["expected"])

    def _few(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= self.broadcast_rows else df

    def add(self, hashes: DataFrame, phash: str = "phash") -> int:
        """Takes the hashes that the index lacks; returns their number."""
        one = self.kept(hashes.where(F.col(phash).isNotNull()).select(F.col(phash).cast("long").alias("h")).distinct())
        held = self.groups.holding(one).where("not merges").select("h").join(self._few(one), "h", "left_semi")
        new = self.kept(one.join(held, "h", "left_anti"))
        count = new.count()
        if not count:
            return 0
        tasks = max(1, count * len(self.plan.choices) // similarity.TASK_ROWS)
        rows = self.kept(new.repartition(tasks, "h").select(F.explode(self.plan.of("h")).alias("key"), "h"))
        mine, first = rows.select("key", F.col("h").alias("a")), self.plan.first("key", "a", "b")
        theirs = self.keys.holding(rows).select("key", F.col("h").alias("b"))
        met = theirs.join(self._few(mine), "key").where("a <> b").where(first).select("a", "b").distinct()  # a key may have been added twice
        among = mine.hint("merge").join(mine.withColumnRenamed("a", "b").hint("merge"), "key").where("a < b").where(first).select("a", "b")
        links = self.kept(met.union(among))

        # Groups that the links touch, under the labels that they have, and the new hashes under their own.
        old = links.select(F.col("b").alias("h")).join(new, "h", "left_anti").distinct()
        label = self.kept(self.groups.holding(old).where("not merges").join(self._few(old), "h", "left_semi").select("h", "label").distinct())
        named = links.join(label.withColumnRenamed("h", "b"), "b", "left").select("a", F.coalesce("label", "b").alias("b"))
        of = self.kept(components(named, self.kept))
        joins = new.join(of, new["h"] == of["node"], "left").select("h", F.coalesce("label", "h").alias("label"), F.lit(False).alias("merges"))
        merged = label.select(F.col("label").alias("node")).distinct().join(of, "node").where("node <> label").select(F.col("node").alias("h"), "label", F.lit(True).alias("merges"))
        self.keys.put(rows, replace=False)
        self.groups.put(joins.union(merged), replace=False)
        return count

    def labels(self) -> DataFrame:
        """h, group of every hash; hashes within a chain of near ones have one group."""
        held = self.groups.read()
        # Merges are noted once for two groups that a batch connects; they are few beside the hashes.
        whole = components(held.where("merges").select(F.col("h").alias("a"), F.col("label").alias("b")), self.kept).withColumnRenamed("label", "group")
        rows = held.where("not merges").groupBy("h").agg(F.min("label").alias("label"))
        return rows.join(self._few(whole), rows["label"] == whole["node"], "left").select("h", F.coalesce("group", "label").alias("group"))

    def near_groups(self, hashes: DataFrame, key: str, phash: str = "phash") -> DataFrame:
        """key, label as similarity.near_groups gives them, for hashes that have been added."""
        return similarity.named(hashes, self.labels(), key, phash)

    def rebuild(self, hashes: DataFrame, phash: str = "phash") -> int:
        """Begins anew with these hashes."""
        hashes = self.kept(hashes.select(phash))
        self.keys.reinitialise()
        self.groups.reinitialise()
        return self.add(hashes, phash)
