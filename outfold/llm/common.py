"""Helpers shared by the corpus operators: scratch tables and Arrow batches."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outfold.session import shared_dir


class Workspace:
    """Tables of one operator run, under the folder of ``spark.checkpoint.dir``.

    ``save`` writes a DataFrame as Parquet with Spark's commit protocol and
    reads it back, which cuts the lineage: a lost executor costs its own tasks
    only. ``drop`` removes tables that are no longer read. After a table is
    written, the driver collects its garbage, so that Spark's cleaner removes
    the shuffle files of finished steps while the operator goes on.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._kept: set[str] = set()

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        return self.save_at(df, name)[0]

    def save_at(self, df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path = self.path(name)
        df.write.parquet(path)
        self._kept.add(path)
        gc.collect()
        self.spark._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop_all(self, but: str) -> None:
        for path in self._kept - {but}:
            self.drop(path)

    def drop(self, path: str) -> None:
        self._kept.discard(path)
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """While it lasts, ``rows`` at most travel to Python at once: a batch of whole
    texts is held by the JVM and by Python, in each task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(old)) if int(old) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20
           ) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` (string or binary) holds at most
    ``limit`` bytes in each, or one row; keeps the memory of a task bounded."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = byte_lengths(batch.column(column))
        ends = np.cumsum(sizes)
        lo = 0
        while lo < n:
            base = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def byte_lengths(col: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each value, 0 for null."""
    import pyarrow.compute as pc
    return pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def texts(col: pa.Array) -> list[str]:
    """Python strings, null as the empty string."""
    return ["" if t is None else t for t in col.to_pylist()]


def blobs(col: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value, null as the empty string."""
    return [t or b"" for t in col.cast(pa.binary()).to_pylist()]


#: Bits of a table that tells tasks which hashes to let through (8 MB).
FILTER_BITS = 1 << 26
_SHIFT = 64 - FILTER_BITS.bit_length() + 1


def bit_table(df: DataFrame, column: str) -> np.ndarray:
    """The 64-bit hashes in ``column`` as bits: bounded at any number of rows."""
    h = F.col(column)
    marked = df.select(
        F.shiftrightunsigned(h, _SHIFT + 6).alias("_at"),
        F.expr(f"shiftleft(1L, cast(shiftrightunsigned(`{column}`, {_SHIFT}) & 63 as int))").alias("_b")
    ).groupBy("_at").agg(F.bit_or("_b").alias("_bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    bits[marked.column("_at").to_numpy()] = marked.column("_bits").to_numpy().view(np.uint64)
    return bits


def in_table(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which (unsigned) hashes may be in the table: all that are, few others."""
    place = hashes >> np.uint64(_SHIFT)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def bit_filter(df: DataFrame, column: str):
    """For ``mapInArrow``: rows whose ``column`` may be among that of ``df``."""
    bits = df.sparkSession.sparkContext.broadcast(bit_table(df, column))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(in_table(bits.value, b.column(column).to_numpy().view(np.uint64))))
    return keep
