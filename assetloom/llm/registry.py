"""Queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from assetloom.llm import sql
from assetloom.llm.audit import op12_filter_audit
from assetloom.llm.bpe import op3_bpe
from assetloom.llm.html import op7_html_text
from assetloom.llm.langid import op9_language_id
from assetloom.llm.lm import op4_lm_score
from assetloom.llm.mixing import op8_mixing
from assetloom.llm.ngram_join import op10_ngram_join
from assetloom.llm.packing import op5_packed_ids
from assetloom.llm.periods import op13_periodic_runs
from assetloom.llm.pivots import op11_pivot_near_dup
from assetloom.llm.toxicity import op2_toxicity
from assetloom.llm.vectors import op1_exact_top_k, op6_near


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_exact_top_k": lambda s, d: op1_exact_top_k(s, _table(s, d, "embeddings")),
        "op6_near": lambda s, d: op6_near(s, _table(s, d, "embeddings")),
        "op2_toxicity": lambda s, d: op2_toxicity(s, _table(s, d, "documents"), _table(s, d, "labels")),
        "op3_bpe": lambda s, d: op3_bpe(s, _table(s, d, "documents")),
        "op4_lm_score": lambda s, d: op4_lm_score(s, _table(s, d, "documents")),
        "op5_packed_ids": lambda s, d: op5_packed_ids(s, _table(s, d, "documents")),
        "op7_html_text": lambda s, d: op7_html_text(_table(s, d, "pages")),
        "op10_ngram_join": lambda s, d: op10_ngram_join(s, _table(s, d, "documents")),
        "op8_mixing": lambda s, d: op8_mixing(s, _table(s, d, "documents")),
        "op9_language_id": lambda s, d: op9_language_id(s, _table(s, d, "documents")),
        "op11_pivot_near_dup": lambda s, d: op11_pivot_near_dup(s, _table(s, d, "embeddings")),
        "op12_filter_audit": lambda s, d: op12_filter_audit(_table(s, d, "documents"), _table(s, d, "labels")),
        "op13_periodic_runs": lambda s, d: op13_periodic_runs(s, _table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_top_k": sql.OP1, "op10_ngram_join": sql.OP10, "op11_pivot_near_dup": sql.OP11, "op12_filter_audit": sql.OP12}
