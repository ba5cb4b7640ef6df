"""Sharding by global byte-size prefix sums.

Rows are put in order of their id, each partition's total is taken, and every row's
middle byte decides its shard: contiguous shards cut at equal byte targets. Null texts
count one byte, null ids come first, repeated ids and rows are ordered by their place in
the input, empty tables give empty results; other columns are not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import scratch, ship


def byte_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, shard, slot: contiguous in the order of ids, sizes equal up to one row at each cut."""
    spark = docs.sparkSession
    ship(spark)
    scratch(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.monotonically_increasing_id().alias("place"))
        .repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place").drop("place")
        .checkpoint()
    )
    # One row for each partition: bounded by the number of partitions, whatever the rows.
    totals = sorted(map(tuple, rows.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("size"), F.count("*")).collect()))
    total, before, at, n = sum(x[1] for x in totals), {}, 0, 0
    for p, size, count in totals:
        before[p], at, n = (at, n), at + size, n + count

    def place(batches):
        start, index = before.get(TaskContext.get().partitionId(), (0, 0))
        for b in batches:
            size = b.column(1).to_numpy()
            ends = start + np.cumsum(size)
            middle = ends - (size + 1) // 2
            shard = np.minimum(middle * shards // max(total, 1), shards - 1).astype(np.int32)
            nth = index + np.arange(len(size), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(shard), pa.array(nth)], names=["doc_id", "size", "text_crc32", "shard", "nth"])
            if len(size):
                start, index = int(ends[-1]), index + len(size)

    placed = rows.mapInArrow(place, "doc_id long, size long, text_crc32 long, shard int, nth long")
    first = F.broadcast(placed.groupBy("shard").agg(F.min("nth").alias("first")))  # a row for each shard
    return placed.join(first, "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("nth") - F.col("first")).alias("slot"))


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    out = byte_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op6_sharding": op6_sharding}
# DuckDB has no crc32, so the query is tested against a brute-force version.
ORACLE_SQL: dict[str, str] = {}
