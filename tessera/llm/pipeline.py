"""Stages of the corpus pipeline: language identification, quality, near duplicates, repeated passages, packing.

Every stage takes the documents that the one before it kept and applies its decisions to rows, not ids: a
row stays or goes by its own text, whatever other rows carry its id, and a null id is an id like any other.
All but the last return the columns of ``documents``; extra columns are dropped. Null texts count as empty: they have no
language and go in the first stage. Of rows that tie in the near-duplicate stage, the first with the least id
stays; repeated rows are copies there. Very long texts are taken whole. Empty tables pass through every stage.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, ngramjoin, packing, quality, suffixdedup
from tessera.session import recorded, release, sweep

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document goes when its quality score is under this. On the labelled held-out rows of sf0.1, 0.5 (the classifier's own border) drops more
#: bad documents but twice as many clean ones; a filtering stage keeps a clean document that the model merely doubts.
LEAST_QUALITY = 0.3


_MADE: list[str] = []


def stage(decide):
    """A stage begins when the one before it has been written: intermediate tables of earlier stages go then, unless ``docs`` still reads them."""

    @functools.wraps(decide)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        sweep(spark, _MADE, docs)
        release(spark)
        with recorded(_MADE):
            return decide(spark, docs, sf_dir)

    return run


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows without a letter or outside the radius of every language."""
    return langid.identify(docs, langid.train(docs), COLUMNS).where(~F.col("rejected")).select(*COLUMNS)


@stage
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that the quality classifier scores under LEAST_QUALITY."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, COLUMNS).where(F.col("score") >= LEAST_QUALITY).select(*COLUMNS)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group linked by five-word shingles at a similarity of 0.8: the first with the least id."""
    return ngramjoin.keep_one(docs, COLUMNS, 5, 80)


@stage
def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that a document with a smaller id has too; characters that a cut leaves in parts go, and rows left without a letter or digit go."""
    kept = suffixdedup.remove_repeats(docs.select(*COLUMNS), carry=["lang", "source"])
    cut = F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "\ufffd", "")
    whole = F.when(F.col("n_removed") == 0, F.col("kept").cast("string")).otherwise(cut)
    return kept.withColumn("text", whole).where(F.col("text").rlike(r"[\p{L}\p{N}]")).select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens: doc_id, start, length, ids, doc_tokens, sequence_id, offset."""
    return packing.pack_texts(docs)


STAGES = [("language", language), ("quality", good_quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("packing", packed)]
