"""Stored states that grow batch by batch without reading old rows again.

A state is a small table that can be merged with others of its kind (sums,
sketches). ``put`` stores the state of one batch under its own folder and
replaces it when the batch is replayed, so a retry never counts twice.
``compact`` merges everything up to a batch into one folder; a reader takes the
newest whole one and the batches after it, so a crash halfway changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _whole(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the folders ``kind=N`` under ``path`` that were written whole."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}=") and fs.exists(
        _fs(spark, f"{path}/{n}/_SUCCESS")[1]))


def batches(spark: SparkSession, path: str) -> tuple[int | None, list[int]]:
    """The newest merged folder (it holds all batches up to its number) and the
    batches after it."""
    merged = _whole(spark, path, "merged")
    last = merged[-1] if merged else None
    return last, [b for b in _whole(spark, path, "batch") if last is None or b > last]


def put(state: DataFrame, path: str, batch: int) -> None:
    """Store the state of ``batch``, in place of an earlier one of that number. A
    batch that was merged already is part of that folder and is left alone."""
    last, _ = batches(state.sparkSession, path)
    if last is None or batch > last:
        state.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def states(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of all stored states; merge them with the state's own aggregate."""
    last, after = batches(spark, path)
    paths = [f"{path}/batch={b}" for b in after] + ([f"{path}/merged={last}"] if last is not None else [])
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths)


def compact(spark: SparkSession, path: str, schema, merge: Callable[[DataFrame], DataFrame]) -> None:
    """Merge all whole batches so far into one folder, then remove what it holds.
    Batches must not be put in while it runs."""
    last, after = batches(spark, path)
    if not after:
        return
    merge(states(spark, path, schema)).write.mode("overwrite").parquet(f"{path}/merged={after[-1]}")
    for name in [f"batch={b}" for b in after] + ([f"merged={last}"] if last is not None else []):
        fs, p = _fs(spark, f"{path}/{name}")
        fs.delete(p, True)
