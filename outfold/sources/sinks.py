"""Prediction sink (D25): one row per scored key, checked before it is written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class SinkCheckError(ValueError):
    pass


def check_keys(df: DataFrame, key) -> dict:
    """Counts of rows, null keys and distinct keys in one aggregate."""
    keys = [key] if isinstance(key, str) else list(key)
    nn = F.count(F.when(F.greatest(*[F.col(c).isNull() for c in keys]) if len(keys) > 1
                        else F.col(keys[0]).isNull(), F.lit(1)))
    r = df.agg(F.count(F.lit(1)).alias("n"), nn.alias("n_null_key"),
               F.count_distinct(*[F.col(c) for c in keys]).alias("n_distinct")).first()
    return r.asDict()


def write_predictions(df: DataFrame, path: str, key, cols=("pred",), fmt: str = "parquet",
                      mode: str = "errorifexists", expected_rows: int | None = None) -> dict:
    """Write ``key`` + ``cols`` once, check what was written, then publish it.

    The rows go to a staging folder beside ``path``; keys and counts are checked
    on the written files, so the scoring plan runs only once and what is checked
    is what is published. A null or duplicate key, or a row count other than
    ``expected_rows``, raises and leaves neither output nor staging folder. The
    staging folder is renamed to ``path`` at the end.
    """
    if mode not in ("errorifexists", "overwrite"):
        raise ValueError(f"unknown mode {mode!r}")
    keys = [key] if isinstance(key, str) else list(key)
    out = df.select(*keys, *cols)
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if mode == "errorifexists" and fs.exists(target):
        raise FileExistsError(path)
    name = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    staging = spark._jvm.org.apache.hadoop.fs.Path(name)
    try:
        if fmt == "csv":
            out.write.option("header", True).csv(name)
            back = spark.read.option("header", True).schema(out.schema).csv(name)
        else:
            out.write.format(fmt).save(name)
            back = spark.read.format(fmt).load(name)
        st = check_keys(back, keys)
        if st["n_null_key"]:
            raise SinkCheckError(f"{st['n_null_key']} rows with a null key")
        if st["n_distinct"] != st["n"]:
            raise SinkCheckError(f"{st['n'] - st['n_distinct']} duplicate key rows")
        if expected_rows is not None and st["n"] != expected_rows:
            raise SinkCheckError(f"{st['n']} rows, expected {expected_rows}")
        if mode == "overwrite":
            fs.delete(target, True)
        if not fs.rename(staging, target):
            raise SinkCheckError(f"could not publish {path}")
    finally:
        if fs.exists(staging):
            fs.delete(staging, True)
    return {"path": path, "rows": st["n"]}
