"""Incremental scans as streams: new files once, one row for each path, and upserts batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from assetloom.functions.hashing import digest
from assetloom.operators.store import SCHEMA, HashStore


def file_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """path, size, last_modified, digest of files as they come. Names that begin with _ or . are Spark's own to hide."""
    raw = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files)
    rows = raw.schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return rows.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"), F.unhex(digest(F.col("content"))).alias("digest"))


def into_store(rows: DataFrame, store: HashStore, checkpoint: str) -> StreamingQuery:
    """Upserts each micro-batch; a batch that runs again writes the same rows."""

    def put(batch: DataFrame, _: int) -> None:
        have = set(batch.columns)
        store.upsert(batch.select(*[F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMA]))

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(events: DataFrame, key: str = "path", time: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark; a timestamp without zone is read as UTC."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def first_seen_for(events: DataFrame, key: str = "path", time: str = "ts", days: float = 30.0) -> DataFrame:
    """The first row of each key, also of keys that come again long after any watermark: a key is remembered until it hasn't
    been seen for so many days (of the cluster's clock), in the stream's own state, which a restart keeps.

    Of a key's rows in one batch the one with the smallest time counts (null last). Null keys are one key. A key with very many rows in a
    batch comes in parts, of which one row is held.

    With a trigger that ends (availableNow), spark.sql.streaming.noDataMicroBatches.enabled must be false: Spark else runs
    batches without data for as long as any key is remembered."""
    keep = int(days * 86_400_000)
    names = events.columns

    def seen(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first = None
        for part in parts:
            if not state.exists and len(part):
                one = part.sort_values(time, kind="stable", na_position="last").iloc[:1]
                first = one if first is None else pd.concat([first, one]).sort_values(time, kind="stable", na_position="last").iloc[:1]
        if first is not None:
            yield first[names]
        state.update((True,))
        state.setTimeoutDuration(keep)

    return events.groupBy(key).applyInPandasWithState(seen, events.schema, "seen boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)
