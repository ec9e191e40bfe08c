"""Group sums that take in new facts without reading old ones (R3, D15).

The state of a batch is its sum and count of the target per (group, fold); the
sums of all batches are the model's. They are kept as exact decimals, so the
model does not depend on how the facts were cut into batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outfold.functions.safe import known
from outfold.operators.oof import oof_encode
from outfold.session import scratch_path
from outfold.sources import increments


class StoredSums:
    """(group, fold) sums of ``y`` at ``path``, one state a batch.

    ``schema`` is that of the facts: columns ``by`` and ``fold``. Rows without a
    fold and unknown targets (null, NaN) teach nothing; an infinite target or one
    of 10^29 and more raises, since the sums are exact decimals of nine places."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, by, fold: str = "fold", y: str = "y"):
        self.spark, self.path, self.fold, self.y = spark, path.rstrip("/"), fold, y
        self.by = [by] if isinstance(by, str) else list(by)
        self.schema = T.StructType([
            *[T.StructField(c, schema[c].dataType) for c in (*self.by, fold)],
            T.StructField("s", T.DecimalType(38, 9)), T.StructField("n", T.LongType())])

    def state(self, facts: DataFrame) -> DataFrame:
        y = known(self.y)
        return facts.where(F.col(self.fold).isNotNull()).groupBy(*self.by, self.fold).agg(
            F.sum(y.cast("decimal(38,9)")).alias("s"), F.count(y).alias("n"))

    def add(self, facts: DataFrame, batch: int) -> None:
        """Take in the facts of ``batch``; adding it again replaces it."""
        increments.put(self.state(facts), self.path, batch)

    def merge(self, states: DataFrame) -> DataFrame:
        return states.groupBy(*self.by, self.fold).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))

    def compact(self) -> None:
        increments.compact(self.spark, self.path, self.schema, self.merge)

    def stats(self) -> DataFrame:
        """All batches together, in the form of ``oof.group_fold_sums``."""
        return self.merge(increments.states(self.spark, self.path, self.schema)).select(
            *self.by, self.fold, F.col("s").cast("double").alias("__s"), F.col("n").alias("__n"))

    def predict(self, df: DataFrame, k: int, m: float | None = None, out: str = "pred") -> DataFrame:
        """``oof.oof_encode`` of rows ``df`` with the stored sums as its model: a
        row is predicted from all facts taken in but those of its own fold. A
        (group, fold) never taken in learns from the group's other folds too."""
        return oof_encode(df, col=self.by, y=self.y, fold=self.fold, k=k, m=m, out=out, stats=self.stats())

    def follow(self, stream: DataFrame, checkpoint: str | None = None, available_now: bool = True):
        """Take in a stream of facts, one batch a micro-batch, under the stream's
        own batch numbers; a replayed micro-batch replaces its state. Returns the
        StreamingQuery."""
        w = stream.writeStream.option(
            "checkpointLocation", checkpoint or scratch_path(self.spark, "stored-ckpt")).foreachBatch(self.add)
        w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
        return w.start()
