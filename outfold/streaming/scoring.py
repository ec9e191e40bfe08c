"""Held-out scoring on a stream (R5 over arriving rows).

New rows arrive as files; each micro-batch is scored against a fitted
group-mean model (a stream-static join: the model is a static DataFrame) and
folded into a running (sum of absolute error, n_scored, n_missing) state kept
by Spark's state store. The running score is written by ``foreachBatch`` into a
folder of its epoch, which is idempotent when a batch is replayed after a
failure; ``latest`` reads the newest whole epoch, so a reader never meets a
table that is being replaced. Checkpoints go under the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outfold.functions.safe import abs_err, safe_div
from outfold.operators.joins import broadcast_if_small
from outfold.session import scratch_path


def score_stream(stream: DataFrame, model: DataFrame, glob: DataFrame, by,
                 out: str = "pred") -> DataFrame:
    """Streaming rows with a prediction from a fitted group-mean model
    (``holdout.fit_group_mean``); unseen groups get the global mean."""
    by = [by] if isinstance(by, str) else list(by)
    g = glob.select(safe_div("__s", "__n").alias("__glob"))
    gmean = g.first()["__glob"]
    j = stream.join(broadcast_if_small(model), on=by, how="left")
    return j.withColumn(out, F.coalesce(safe_div("__gs", "__gn"), F.lit(gmean))).drop("__gs", "__gn")


def running_mae(scored: DataFrame, y: str = "y", pred: str = "pred", by=None) -> DataFrame:
    """Streaming aggregate: the running MAE state over every row seen, one
    row in all or one row per ``by`` segment (state bounded by the number of
    segments)."""
    err = abs_err(y, pred)
    aggs = [F.sum(err).alias("sum_abs_err"), F.count(err).alias("n_scored"),
            (F.count(F.lit(1)) - F.count(err)).alias("n_missing")]
    if by is None:
        return scored.agg(*aggs)
    by = [by] if isinstance(by, str) else list(by)
    return scored.groupBy(*by).agg(*aggs)


def run_running_mae(spark: SparkSession, scored: DataFrame, out_path: str,
                    y: str = "y", pred: str = "pred", checkpoint: str | None = None,
                    available_now: bool = True, by=None):
    """Start the running-MAE query (per ``by`` segment if given); with
    ``available_now`` it processes every file present and stops. Each batch
    writes the whole current table to ``out_path/epoch=N``; the epoch before the
    last is removed. Read it with ``latest``. Returns the StreamingQuery."""
    checkpoint = checkpoint or scratch_path(spark, "stream-ckpt")

    def write(batch: DataFrame, epoch_id: int) -> None:
        (batch.withColumn("mae", safe_div("sum_abs_err", F.col("n_scored").cast("double")))
         .write.mode("overwrite").parquet(f"{out_path}/epoch={epoch_id}"))
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{out_path}/epoch={epoch_id - 2}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    w = (running_mae(scored, y, pred, by).writeStream.outputMode("complete")
         .option("checkpointLocation", checkpoint).foreachBatch(write))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def latest(spark: SparkSession, out_path: str) -> DataFrame:
    """The running table of the newest epoch that was written whole."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(out_path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(folder)
            if f.getPath().getName().startswith("epoch=") and fs.exists(
                spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    epoch = max(done)
    return spark.read.parquet(f"{out_path}/epoch={epoch}").withColumn(
        "epoch", F.lit(epoch).cast("bigint"))


def file_stream(spark: SparkSession, path: str, schema: T.StructType,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files arriving under the folder ``path``. A single file is
    read through a glob matching exactly that file, since the file source
    takes a non-glob path as its (directory) base path."""
    r = spark.readStream.schema(schema)
    path = path.rstrip("/")
    if path.endswith(".parquet"):
        path = f"{path[:-1]}[{path[-1]}]"
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)
