"""The hash store: path, digest and perceptual hash by path (a RangedTable), its joins and views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetloom.operators.ranges import RangedTable

SCHEMA = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("digest", T.BinaryType()), T.StructField("phash", T.LongType()),
    T.StructField("phash_enh", T.ArrayType(T.LongType())), T.StructField("phash_is_fallback", T.BooleanType()), T.StructField("pixels", T.LongType()),
])


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the last by order. A grouped maximum, so a key with many rows is combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    top = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("last"))
    return top.select(*keys, *[F.col(f"last.{c}").alias(c) for c in rows.columns if c not in keys]).select(rows.columns)


def new_assets(catalog: DataFrame, store: DataFrame, key: str = "path", force_rescan: bool = False) -> DataFrame:
    """Rows of catalog that the store has no digest for."""
    if force_rescan:
        return catalog
    return catalog.join(store.where(F.col("digest").isNotNull()).select(key), key, "left_anti")


def without_skipped(catalog: DataFrame, skip: DataFrame, key: str = "path") -> DataFrame:
    return catalog.join(skip.select(key).distinct(), key, "left_anti")


def all_hashes(digests: DataFrame, phashes: DataFrame, key: str = "path") -> DataFrame:
    """Every digest with its perceptual hash, if any; hashes without a digest don't show."""
    return digests.join(phashes, key, "left")


def inconsistent(digests: DataFrame, phashes: DataFrame, key: str = "path") -> DataFrame:
    """Keys that only one side has: key, side."""
    a, b = digests.select(F.col(key), F.lit(1).alias("__a")), phashes.select(F.col(key), F.lit(1).alias("__b"))
    both = a.join(b, key, "full_outer").where(F.col("__a").isNull() != F.col("__b").isNull())
    return both.select(key, F.when(F.col("__a").isNull(), "phash_only").otherwise("digest_only").alias("side"))


def key_value_view(store: DataFrame) -> DataFrame:
    """The store as prefixed keys and bytes."""
    from assetloom.functions.hashing import to_bytes, words_to_bytes

    phash = F.coalesce(words_to_bytes(F.col("phash_enh")), to_bytes(F.col("phash")))
    both = store.select("path", F.inline(F.array(F.struct(F.lit("pc:").alias("prefix"), F.col("digest").alias("value")), F.struct(F.lit("pp:").alias("prefix"), phash.alias("value")))))
    return both.where(F.col("value").isNotNull()).select(F.concat("prefix", "path").alias("key"), "value")


def in_key_order(view: DataFrame) -> DataFrame:
    """A key-value view as an iteration over sorted keys gives it."""
    return view.orderBy("key")


class SkipList:
    """Paths that a later run leaves out, such as those whose hash took too long; a folder of Parquet files that only grows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def add(self, rejects: DataFrame, error_class: str = "TimedOutError") -> None:
        """Takes the rejects of this error class."""
        rejects.where(F.col("error_class") == error_class).select("path").distinct().write.mode("append").parquet(self.root)

    def read(self) -> DataFrame:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        there = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)
        return self.spark.read.schema("path string").parquet(self.root).distinct() if there else self.spark.createDataFrame([], "path string")


class HashStore(RangedTable):
    """ranges: into how many ranges a new store is cut; a range that comes to hold more than most_rows is cut further."""

    def __init__(self, spark: SparkSession, root: str, ranges: int = 1, most_rows: int = 1_000_000):
        super().__init__(spark, root, SCHEMA, "path", ranges, most_rows)

    def upsert(self, rows: DataFrame, order: str | None = None) -> int:
        """Rows by path replace what the store has; of one path's rows in a batch the last stays, by ``order`` or else as the
        batch has them. Returns the version."""
        at = F.col(order) if order else F.monotonically_increasing_id()
        batch = latest(rows.select(*SCHEMA.fieldNames(), at.alias("__at")), ["path"], ["__at"]).drop("__at")
        return self.put(batch, replace=True)

    def known(self, catalog: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
        """path of those rows of catalog (path, ...) that the store has a digest for.

        Only ranges that the catalog touches are read. A catalog of few paths, checked by counting, goes to the store's
        tasks, so that nothing of the store is shuffled; beyond that, these ranges' paths are shuffled."""
        paths = catalog.select("path").distinct()
        there = self.holding(paths).where(F.col("digest").isNotNull()).select("path")
        if paths.count() <= broadcast_rows:
            return there.join(F.broadcast(paths), "path", "left_semi")
        return there.join(paths, "path", "left_semi")

    def new_assets(self, catalog: DataFrame, force_rescan: bool = False, broadcast_rows: int = 1_000_000) -> DataFrame:
        """Rows of catalog that the store has no digest for."""
        if force_rescan:
            return catalog
        found = self.known(catalog, broadcast_rows)
        return catalog.join(found, "path", "left_anti")

    def stats(self) -> DataFrame:
        return self.read().agg(F.count("digest").alias("digests"), F.count(F.coalesce(F.col("phash"), F.get("phash_enh", 0))).alias("phashes"))
