"""The engine: scan, hash what is new, keep, and plan what to do with duplicates."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetloom.config import Config
from assetloom.functions import magic, paths
from assetloom.operators import dedup, near_long, similarity, store
from assetloom.operators.near_index import NearIndex
from assetloom.plans.progress import Progress, State
from assetloom.sources.catalog import catalog
from assetloom.sources.decode import hashed, split, with_pictures
from assetloom.sources.folders import shared_dir
from assetloom.sources.pictures import EXTENSIONS, pictures, recovered_pictures


#: What the settings' levels are to Python's logging.
LOG_LEVELS = {"trace": 5, "debug": logging.DEBUG, "info": logging.INFO, "warn": logging.WARNING, "error": logging.ERROR}


#: Files that a task hashes, beyond four tasks for each core.
TASK_FILES = 1000


class Engine:
    """Steps are logged to the logger ``assetloom``, from the level of the settings on."""

    def __init__(self, spark: SparkSession, store_root: str, config: Config | None = None):
        self.spark, self.config = spark, config or Config()
        self.store = store.HashStore(spark, f"{store_root.rstrip('/')}/{self.config.database_name}")
        self.roots: list[str] = []
        self.log = logging.getLogger("assetloom")
        self.log.setLevel(LOG_LEVELS[self.config.log_level])
        self.skipped = store.SkipList(spark, f"{store_root.rstrip('/')}/{self.config.database_name}_skipped")
        self.near = f"{store_root.rstrip('/')}/{self.config.database_name}_near"
        if self.config.reinitialise_database:
            self.store.reinitialise()

    def index(self, max_distance: int | None = None) -> NearIndex:
        """The index of near hashes beside the store, one for each distance."""
        t = self.config.distance() if max_distance is None else max_distance
        return NearIndex(self.spark, f"{self.near}/{t}", t)

    def discover(self, roots: list[str]) -> DataFrame:
        c, self.roots = self.config, roots
        return catalog(self.spark, roots, c.max_depth, c.process_unsupported_formats, c.excluded_directories)

    def hash_and_persist(self, assets: DataFrame, skip: DataFrame | None = None, tell: Callable[[State], None] | None = None, **how) -> tuple[int, DataFrame]:
        """Hashes what the store lacks, but for the skip list. Returns the store's version and the rejects, whose timeouts are
        kept in the skip list. tell: is called with the state of the run while files are hashed. how: see decode.hashed."""
        todo = self.store.new_assets(assets.dropDuplicates(["path"]), self.config.force_rescan)
        todo = store.without_skipped(todo, self.skipped.read() if skip is None else skip)
        todo = todo.checkpoint()
        n = todo.count()
        todo = todo.repartition(max(4 * self.spark.sparkContext.defaultParallelism, n // TASK_FILES))  # Spark would put rows together by their few bytes
        if tell:
            progress = Progress(self.spark, n, tell)
            with progress:
                rows = hashed(todo, **how, count=progress.count).checkpoint()
        else:
            rows = hashed(todo, **how)
        if self.roots:
            rows = with_pictures(rows, pictures(self.spark, self.roots, how.get("enhanced", False)))
        rows = rows.checkpoint()  # files are read once
        seen = F.col("digest").isNotNull() & (F.coalesce("phash_is_fallback", F.lit(False)) | (F.col("stage") == "phash")) & paths.lower_extension(F.col("path")).isin(*EXTENSIONS)
        missed = rows.where(seen & (F.coalesce("phash_is_fallback", F.lit(False)) | F.col("path").rlike(r"/[._]")))
        if missed.limit(1).count():
            rows = with_pictures(rows, recovered_pictures(self.spark, missed, f"{shared_dir(self.spark)}/assetloom-pictures", how.get("enhanced", False))).checkpoint()
        good, rejects = split(rows)
        self.skipped.add(rejects)
        version = self.store.upsert(good)
        if self.config.force_rescan:  # hashes may have changed; those of before would still connect others
            self.index().rebuild(_real(self.store.read()))
        else:
            self.index().add(_real(good))
        self.log.info("store version %d: %s", version, {r["stage"] or "ok": r["n"] for r in rows.groupBy("stage").agg(F.count("*").alias("n")).collect()})
        return version, rejects

    def duplicates(self, assets: DataFrame) -> DataFrame:
        """The action plan for files of equal digest."""
        both = assets.join(self.store.read(), "path")
        columns = {"size": "size", "created": "created", "format": "format", "pixels": "pixels"}
        return dedup.action_plan(both, dedup.keepers(both, "path", columns, self.config), "path", self.config)

    def near_duplicates(self, max_distance: int | None = None) -> DataFrame:
        """path, label of files with similar pictures; fallback hashes take no part.

        Runs keep the index of the settings' distance up to date, so that only hashes that it lacks are compared."""
        real, index = _real(self.store.read()), self.index(max_distance)
        index.add(real)
        return index.near_groups(real, "path")

    def near_long_duplicates(self, max_distance: int | None = None) -> DataFrame:
        """path, label of files with similar long hashes, within 16 times the distance of short ones."""
        t = self.config.distance(1024) // 16 if max_distance is None else max_distance
        return near_long.near_long_groups(self.store.read().where("phash_enh is not null and not phash_is_fallback"), t, "path")


def _real(rows: DataFrame) -> DataFrame:
    return rows.where("phash is not null and not phash_is_fallback")


def suffix_plan(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """old_path, format, new_path and status ('ok', 'mismatch', 'unknown') of files that the extension check looks at.

    ``blocked`` marks a name that another file of the table has already. Nothing is renamed."""
    p = F.col(path)
    looked = files.where(paths.lower_extension(p).isin(*magic.CANDIDATES)).select(p.alias("old_path"), magic.format_by_magic(F.col(content)).alias("format"), paths.extension(p).alias("ext"))
    status = F.when(F.col("format").isNull(), "unknown").when(magic.extension_matches(F.col("ext"), F.col("format")), "ok").otherwise("mismatch")
    out = looked.withColumn("status", status).withColumn("new_path", F.when(F.col("status") == "mismatch", magic.corrected(F.col("old_path"), F.col("format"))))
    taken = files.select(p.alias("new_path"), F.lit(True).alias("blocked")).distinct()
    return out.join(taken, "new_path", "left").select("old_path", "format", "new_path", "status", F.coalesce("blocked", F.lit(False)).alias("blocked"))
