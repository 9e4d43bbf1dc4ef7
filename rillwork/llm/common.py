"""Shared pieces of the training-data operators: shared storage, Arrow access, byte tables."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, ship_package

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Let the executors import this package, and bound Arrow batches where the session has not chosen already."""
    ship_package(spark)
    for key, value in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "500"),
        ("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20)),
    ):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/rillwork-{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, codec: str | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors.

    Reading back also gives the planner measured sizes for its broadcasts: those of the compressed files, of which the rows
    in memory may be several times as large.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage through Spark's own file system layer."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Intermediate tables of one operator in the shared folder, deleted when it has no more use for them."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.tag = spark, tag
        self.paths: list[tuple[str, str]] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(self.spark, f"{self.tag}-{name}")
        df.write.parquet(path)
        self.paths.append((name, path))
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Let the driver collect its garbage now: Spark deletes the shuffle files of plans that nothing refers to."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, name: str) -> None:
        for own, path in self.paths:
            if own == name:
                remove(self.spark, path)
        self.paths = [x for x in self.paths if x[0] != name]

    def close(self) -> None:
        for name in {n for n, _ in self.paths}:
            self.drop(name)


def frugal(work, *clear):
    """Wraps a function over Arrow batches: when its task ends, however that is, tables it kept are cleared (`clear`) and
    free memory goes back to the system. Python workers are reused, and what one operator leaves is missing to the next."""

    def run(*batches):
        try:
            yield from work(*batches)
        finally:
            for f in clear:
                f()
            if clear:
                gc.collect()
            give_back()

    return run


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim:
        trim(0)


def utf8_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary array without copying; a null has length 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if offsets is None or n == 0:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return off, raw


def runs(off: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most `limit` bytes; a single longer row is a range of its own."""
    n, start = len(off) - 1, 0
    while start < n:
        end = int(np.searchsorted(off, off[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


def append_columns(batch: pa.RecordBatch, extra: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *extra.values()], [*batch.schema.names, *extra])



def word_count(column) -> "F.Column":
    """Number of words as the contracts define them; null counts 0. Evaluated in the JVM."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
