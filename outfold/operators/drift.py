"""Do two parts of a table have the same distribution (R5, D23)? Exact two-sample
Kolmogorov-Smirnov and Wasserstein distances of several columns at once.

Equal values are counted first, so a value that holds a third of all rows is one
row. The counts are range-partitioned by (column, value); cumulative counts run
inside a partition, and the totals of the partitions before it are added from a
table of one row for each partition and column. No column is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outfold.functions.safe import known, safe_div
from outfold.operators.joins import broadcast_bounded, materialize


def drift(df: DataFrame, part: str, columns, partitions: int | None = None) -> DataFrame:
    """One row for each column: ``column``, ``n_in`` and ``n_out`` (rows with a known
    value where the boolean ``part`` is true and false), ``ks`` (largest difference of
    the two distribution functions), ``ks_at`` (the smallest value where it is
    reached), ``ks_critical`` (the difference that equal distributions exceed with
    probability 0.05, for large samples) and ``wasserstein`` (area between them, in
    the column's units).

    Null and NaN values and rows with a null ``part`` are not counted. Where a side
    has no row, the last four are null. Columns without any known value have no
    row. Where the parts differ next to an infinite value, ``wasserstein`` is infinite.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = list(columns)
    each = F.array(*[F.struct(F.lit(c).alias("column"), known(c).alias("v")) for c in columns])
    values = (df.where(F.col(part).isNotNull()).select(F.col(part).alias("__in"), F.inline(each))
              .where("v is not null").groupBy("column", (F.col("v") + F.lit(0.0)).alias("v"))
              .agg(F.count(F.when(F.col("__in"), 1)).alias("a"), F.count(F.when(~F.col("__in"), 1)).alias("b")))
    values = materialize(values.repartitionByRange(n, "column", "v").withColumn("p", F.spark_partition_id()))
    parts = materialize(values.groupBy("column", "p").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b"), F.min("v").alias("least")))
    order = Window.partitionBy("column").orderBy("p")
    whole = Window.partitionBy("column")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "column", "p", F.coalesce(F.sum("a").over(before), F.lit(0)).alias("a0"),
        F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"), F.lead("least").over(order).alias("after"),
        F.sum("a").over(whole).alias("n_in"), F.sum("b").over(whole).alias("n_out"))
    inside = Window.partitionBy("column", "p").orderBy("v")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    gap = F.abs(safe_div(F.col("a0") + F.col("ca"), "n_in") - safe_div(F.col("b0") + F.col("cb"), "n_out"))
    width = F.coalesce("next", "after") - F.col("v")
    steps = (values.select("column", "p", "v", F.sum("a").over(upto).alias("ca"),
                           F.sum("b").over(upto).alias("cb"), F.lead("v").over(inside).alias("next"))
             .join(broadcast_bounded(parts, n * len(columns)), ["column", "p"])
             .select("column", "v", "n_in", "n_out", gap.alias("gap"), width.alias("width")))
    best = F.max(F.struct("gap", (-F.col("v")).alias("minus")))
    both = (F.col("n_in") > 0) & (F.col("n_out") > 0)
    return steps.groupBy("column", "n_in", "n_out").agg(
        best.alias("best"), F.sum(F.when(F.col("gap") > 0, F.col("gap") * F.col("width"))).alias("w")).select(
        "column", "n_in", "n_out", F.col("best.gap").alias("ks"),
        F.when(both, -F.col("best.minus") + F.lit(0.0)).alias("ks_at"),
        F.when(both, F.sqrt(-F.log(F.lit(0.025)) / 2 * safe_div(
            F.col("n_in") + F.col("n_out"), F.col("n_in").cast("double") * F.col("n_out")))).alias("ks_critical"),
        F.when(both, F.coalesce("w", F.lit(0.0))).alias("wasserstein"))
