"""Session helpers: shipping the package, shared scratch space, size-checked joins."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType

#: Rows and bytes up to which a side may be broadcast; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 300_000, 16 << 20


def ship(spark: SparkSession) -> None:
    """Makes this package importable on executors that do not have it on their path."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")  # whole texts are long rows
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sc = spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(":") or getattr(sc, "_tessera_shipped", False):
        return
    base = os.path.join(tempfile.mkdtemp(), "tessera_pkg")
    sc.addPyFile(shutil.make_archive(base, "zip", root, "tessera"))
    sc._tessera_shipped = True


#: What a worker keeps between tasks of one operator, such as a tokenizer's cache.
KEPT: dict = {}


def tidy(keep: bool = False) -> None:
    """On a worker: hands memory that earlier tasks have freed back to the system, what another operator kept included."""
    import pyarrow

    if not keep:
        KEPT.clear()
    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the checkpoint folder already set; a temporary one only in local mode."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        named = getattr(sc, "_tessera_scratch", None)
        if named is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = sc._tessera_scratch = "file://" + tempfile.mkdtemp(prefix="tessera-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return f"{named.rstrip('/')}/tessera-{sc.applicationId}"


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes a frame as Parquet to the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _RECORDING:
        made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_RECORDING: list[list[str]] = []


@contextlib.contextmanager
def recorded(made: list[str]):
    """Notes the paths of the frames that are materialised inside, so that ``sweep`` can delete them."""
    _RECORDING.append(made)
    try:
        yield made
    finally:
        _RECORDING.remove(made)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def sweep(spark: SparkSession, made: list[str], keep: DataFrame | None = None) -> None:
    """Deletes noted frames whose results have been written, but for those that ``keep`` reads."""
    used = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in keep.inputFiles()} if keep is not None and made else set()
    for path in [x for x in made if x.rsplit("/", 1)[-1] not in used]:
        _delete(spark, path)
        made.remove(path)


def release(spark: SparkSession) -> None:
    """Lets Spark clean up shuffle files that no frame refers to any more; else they stay until the driver happens to collect garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_files(*frames: DataFrame) -> None:
    """Deletes the files of materialised frames whose results have been written."""
    for df in frames:
        for path in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            _delete(df.sparkSession, path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a materialised frame whose results have been written, and shuffle files that are no longer needed."""
    drop_files(df)
    release(df.sparkSession)


def width(df: DataFrame) -> Column:
    """A row's bytes: eight for a number, text and binary by their length, arrays by their items; zero of what is null."""
    parts = []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, (StringType, BinaryType)):
            parts.append(F.coalesce(F.octet_length(c), F.lit(0)))
        elif isinstance(t, ArrayType):
            each = F.octet_length if isinstance(t.elementType, (StringType, BinaryType)) else (lambda x: F.lit(8))
            parts.append(F.coalesce(F.aggregate(c, F.lit(0), lambda n, x, each=each: n + F.coalesce(each(x), F.lit(0))), F.lit(0)) if each is F.octet_length else F.coalesce(F.size(c) * 8, F.lit(0)))
        else:
            parts.append(F.lit(8))
    return sum(parts[1:], parts[0]).cast("long")


def small(df: DataFrame, limit: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a materialised frame for broadcast if its rows and their bytes are within the bounds; else leaves the join to shuffle."""
    n, held = df.limit(limit + 1).agg(F.count("*"), F.sum(width(df))).first()
    return F.broadcast(df) if n <= limit and (held or 0) <= size else df
