"""A corpus from raw documents to token ids, by five operators in turn.

Each stage works on all that the one before kept; all but the last return the columns of documents.

Defined results: a null or empty text has no language and goes in the first stage; a null doc_id, lang or source is a value like
others, and a null or missing label none; rows are documents each, also where their doc_id or all of them is equal, and the
near-duplicate stage keeps one of equal ones; ties there go to the smaller doc_id, elsewhere as the operators say; an
empty table goes through all stages and gives no rows; further columns are kept, whatever their names, but those of the
last stage's results give way to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetloom.llm import bpe, langid, mixing, ngram_join, toxicity
from assetloom.llm.common import freed, fresh_dir, staged

#: Up to so many groups and dropped documents are sent to all workers; beyond that joins shuffle.
BROADCAST_ROWS = 1_000_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or with no clear language."""
    return langid.kept(spark, docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic."""
    return toxicity.kept(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of similar ones: that with the smallest doc_id, null last, and of several rows that
    have it one. Documents are rows: those that share a doc_id but not a text are compared and kept each by itself. Texts
    without words are similar to nothing and stay."""
    id_, text = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], F.monotonically_increasing_id().alias("row"))
    rows = staged(spark, rows, "rows")
    found = ngram_join.joined(spark, rows.select("row", text), text, "row").select("row", "component_id")
    found = staged(spark, found.join(rows.select("row", F.col(id_).alias("id")), "row"), "joined")
    best = found.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("best"), F.count("*").alias("n")).where("n > 1").select("component_id", F.col("best.row").alias("stays"))
    gone = found.join(_small(best), "component_id").where("row <> stays").select("row")
    return rows.join(_small(gone), "row", "left_anti").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(spark, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the texts, with digests of the ids and of what they decode to."""
    return bpe.encoded(spark, docs, bpe.default_path())


STAGES = [("language ID", language), ("toxicity", toxic), ("n-gram Jaccard join", near_duplicates), ("mixing sources to target weights", mix), ("BPE encoding and decoding", encode)]

#: Compression and trained weights can't be written in SQL; tests/llm/test_pipeline.py follows the stages by hand.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = fresh_dir(spark, f"stage{k}")
        with freed(spark):  # what a stage worked with goes when its output is written
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
