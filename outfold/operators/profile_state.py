"""A column profile as a state that can be stored and merged (D5).

The profile of a new file is added to those of the files before without reading
them: counts, extremes and moments merge exactly, distinct values and quartiles
through HyperLogLog and KLL sketches of bounded size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outfold.operators.joins import materialize
from outfold.operators.profile import numeric_columns
from outfold.sources import increments

#: log2 of the HyperLogLog registers (relative error about 0.8 %), and KLL size
#: (rank error about 0.1 %).
HLL_BITS = 14
KLL_SIZE = 2000

SCHEMA = ("column string, n_rows long, n_known long, min double, max double, mean double, m2 double, "
          "hll binary, kll binary")


def state(df: DataFrame, cols=None) -> DataFrame:
    """One row per column (numeric ones by default), of schema ``SCHEMA``, from
    one aggregate. NaN counts as null; infinities are ordinary values, with which
    mean and deviation are not finite."""
    cols = numeric_columns(df) if cols is None else ([cols] if isinstance(cols, str) else list(cols))
    aggs, structs = [], []
    for i, c in enumerate(cols):
        x = F.col(f"`{c}`").cast("double")
        x = F.when(~F.isnan(x), x + F.lit(0.0))  # -0.0 and 0.0 are one value
        aggs += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"l{i}"), F.max(x).alias(f"h{i}"),
                 F.avg(x).alias(f"a{i}"), F.var_pop(x).alias(f"v{i}"),
                 F.hll_sketch_agg(F.hex(x.cast("string")), HLL_BITS).alias(f"d{i}"),
                 F.kll_sketch_agg_double(x, F.lit(KLL_SIZE)).alias(f"q{i}")]
        structs.append(F.struct(
            F.lit(c).alias("column"), F.col("_n").alias("n_rows"), F.col(f"n{i}").alias("n_known"),
            F.col(f"l{i}").alias("min"), F.col(f"h{i}").alias("max"), F.col(f"a{i}").alias("mean"),
            (F.col(f"v{i}") * F.col(f"n{i}")).alias("m2"), F.col(f"d{i}").alias("hll"),
            F.col(f"q{i}").alias("kll")))
    return df.agg(F.count(F.lit(1)).alias("_n"), *aggs).select(F.inline(F.array(*structs)))


def merge(states: DataFrame) -> DataFrame:
    """States of any number of parts as one, again of schema ``SCHEMA``. Squared
    deviations are merged around the common mean, not as a difference of sums."""
    states = materialize(states)
    mean = states.groupBy("column").agg(
        F.try_divide(F.sum(F.col("mean") * F.col("n_known")), F.sum(F.when(F.col("n_known") > 0, F.col("n_known")))
                     .cast("double")).alias("_mean"))
    off = F.col("mean") - F.col("_mean")
    return states.join(mean, "column").groupBy("column").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_known").alias("n_known"), F.min("min").alias("min"),
        F.max("max").alias("max"), F.any_value("_mean").alias("mean"),
        F.sum(F.col("m2") + F.col("n_known") * off * off).alias("m2"),
        F.hll_union_agg("hll").alias("hll"), F.kll_merge_agg_double("kll").alias("kll"))


def report(states: DataFrame) -> DataFrame:
    """The columns of ``profile.profile`` from states, merged: (column, n_rows,
    n_null, n_distinct, min, max, mean, sd, q1, median, q3)."""
    known = F.col("n_known") > 0
    q = F.when(known, F.kll_sketch_get_quantile_double("kll", F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75)])))
    return merge(states).select(
        "column", "n_rows", (F.col("n_rows") - F.col("n_known")).alias("n_null"),
        F.hll_sketch_estimate("hll").alias("n_distinct"), "min", "max", "mean",
        F.sqrt(F.try_divide(F.col("m2"), F.col("n_known") - 1)).alias("sd"), q.alias("q")).select(
        "*", *[F.col("q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))]).drop("q")


class StoredProfile:
    """Profile states of batches at ``path`` (see ``sources.increments``)."""

    def __init__(self, spark: SparkSession, path: str, cols=None):
        self.spark, self.path, self.cols = spark, path.rstrip("/"), cols

    def add(self, df: DataFrame, batch: int) -> None:
        increments.put(state(df, self.cols), self.path, batch)

    def compact(self) -> None:
        increments.compact(self.spark, self.path, SCHEMA, merge)

    def report(self) -> DataFrame:
        return report(increments.states(self.spark, self.path, SCHEMA))
