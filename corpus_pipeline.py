"""Corpus pipeline over ``documents``; the stages are in ``tessera.llm.pipeline``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.pipeline import COLUMNS, STAGES, good_quality, language, near_duplicates, packed, repeats
from tessera.session import materialize

__all__ = ["COLUMNS", "ORACLE_SQL", "STAGES", "good_quality", "language", "near_duplicates", "packed", "repeats", "run"]
# Trained models, tokenisers and suffix arrays are not SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
