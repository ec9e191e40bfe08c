"""Column profile (D5), category frequency (D6), numeric summary per category
(D7) and correlation of numeric pairs (D8). Each is a single aggregate
whose wide one-row result is turned into rows with ``inline``."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outfold.functions.safe import safe_div
from outfold.operators.gram import wide_corr
from outfold.operators.joins import materialize
from outfold.operators.quantiles import exact_quantiles, quantile_agg

def numeric_columns(df: DataFrame) -> list[str]:
    from pyspark.sql import types as T
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def profile(df: DataFrame, cols=None, exact: bool = False, accuracy: int = 10000) -> DataFrame:
    """(column, n_rows, n_null, n_distinct, min, max, mean, sd, q1, median, q3).

    Moments and counts come from one aggregate; by default distinct counts and
    quartiles are bounded sketches (``approx_count_distinct``,
    ``percentile_approx``) in that same aggregate. ``exact=True`` counts distinct
    values exactly, which shuffles every column's distinct values, and takes
    quartiles from ``exact_quantiles`` over the columns unpivoted to (column,
    value), so all columns share each pass and no task holds a column's values.
    """
    cols = numeric_columns(df) if cols is None else ([cols] if isinstance(cols, str) else list(cols))
    probs = [0.25, 0.5, 0.75]
    aggs, structs = [], []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        nd = F.count_distinct(c) if exact else F.approx_count_distinct(c)
        aggs += [F.count(F.when(F.col(c).isNull(), 1)).alias(f"nn{i}"), nd.alias(f"nd{i}"),
                 F.min(x).alias(f"mi{i}"), F.max(x).alias(f"ma{i}"), F.avg(x).alias(f"me{i}"),
                 F.stddev_samp(x).alias(f"sd{i}")]
        if not exact:
            aggs.append(quantile_agg(x, probs, exact=False, accuracy=accuracy).alias(f"q{i}"))
        structs.append(F.struct(
            F.lit(c).alias("column"), F.col("__n").alias("n_rows"),
            F.col(f"nn{i}").alias("n_null"), F.col(f"nd{i}").alias("n_distinct"),
            F.col(f"mi{i}").alias("min"), F.col(f"ma{i}").alias("max"),
            F.col(f"me{i}").alias("mean"), F.col(f"sd{i}").alias("sd"),
            (F.col(f"q{i}") if not exact else F.lit(None).cast("array<double>")).alias("q")))
    wide = df.agg(F.count(F.lit(1)).alias("__n"), *aggs)
    rows = wide.select(F.inline(F.array(*structs)))
    if exact:
        long = df.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in cols])))
        qs = exact_quantiles(long, "x", probs, by="column", out="__q")
        rows = rows.join(qs, "column", "left").withColumn("q", F.col("__q")).drop("__q")
    return rows.select(*[c for c in rows.columns if c != "q"],
                       F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"),
                       F.col("q")[2].alias("q3"))


def freq(df: DataFrame, col: str) -> DataFrame:
    """(value, n, share) per category, nulls included as their own value."""
    per = materialize(df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n")))
    total = per.agg(F.sum("n")).scalar()
    return per.withColumn("share", safe_div(F.col("n").cast("double"), total))


def summary_by(df: DataFrame, by, cols) -> DataFrame:
    """Per category: n_rows and, per column, n, mean, sd, min, max."""
    by = [by] if isinstance(by, str) else list(by)
    cols = [cols] if isinstance(cols, str) else list(cols)
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for c in cols:
        aggs += [F.count(c).alias(f"{c}_n"), F.avg(c).alias(f"{c}_mean"),
                 F.stddev_samp(c).alias(f"{c}_sd"), F.min(c).alias(f"{c}_min"),
                 F.max(c).alias(f"{c}_max")]
    return df.groupBy(*by).agg(*aggs)


def corr_pairs(df: DataFrame, cols=None, method: str = "agg") -> DataFrame:
    """(a, b, r): Pearson correlation of every pair of ``cols``.

    ``method="agg"``: one aggregate with a ``corr`` per pair (pairwise
    complete rows, as SQL ``corr``). ``method="matrix"``: Spark ML's
    ``Correlation`` over an assembled vector, one pass for very wide inputs;
    rows with a null in any column are skipped, and only the p x p matrix
    reaches the driver. ``method="blocks"``: blocks of the matrix multiplied in
    the tasks and added in a tree (``gram.wide_corr``); hundreds of columns.
    """
    if method == "blocks":
        return wide_corr(df, numeric_columns(df) if cols is None else list(cols))
    cols = numeric_columns(df) if cols is None else list(cols)
    pairs = list(combinations(cols, 2))
    if method == "matrix":
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.stat import Correlation
        vec = VectorAssembler(inputCols=cols, outputCol="__v", handleInvalid="skip").transform(
            df.select(*[F.col(c).cast("double").alias(c) for c in cols]))
        m = Correlation.corr(vec, "__v").first()[0].toArray()
        idx = {c: i for i, c in enumerate(cols)}
        rows = [(a, b, float(m[idx[a], idx[b]])) for a, b in pairs]
        return df.sparkSession.createDataFrame(rows, "a string, b string, r double")
    wide = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r"))
        for i, (a, b) in enumerate(pairs)])))
