"""Windowed operators on event streams. Each takes a batch or a streaming frame of (ts, ...) alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, folder: str, files: str = "events*.parquet") -> DataFrame:
    """A stream over the event files that arrive in a folder."""
    return spark.readStream.schema(SCHEMA).option("pathGlobFilter", files).parquet(folder)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step)).agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "n", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), "n")


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def lag_ratio(events: DataFrame, by: str = "user_id") -> DataFrame:
    """Each value against the one before it of the same key (batch); null at the first and after a zero."""
    before = F.lag("value").over(Window.partitionBy(by).orderBy("ts", "event_id"))
    return events.select("event_id", F.when(before != 0, F.col("value") / before).alias("ratio"))


def majority(events: DataFrame, cell: list, word: str) -> DataFrame:
    """Each cell's most frequent word; ties go to the least."""
    n = events.groupBy(*cell, word).agg(F.count("*").alias("n"))
    names = [c for c in n.columns if c not in (word, "n")]
    return n.groupBy(*names).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(word))).alias("b")).select(*names, F.col(f"b.{word}").alias(word), (-F.col("b.n")).alias("n"))
