"""Out-of-fold fitted models: linear least squares (D17) and gradient-boosted
trees with absolute loss (D18).

D17 needs one pass over the data: per fold, Spark's numerically stable
moment aggregates (``avg``, ``covar_pop``) give the count, means and
co-moments of the features and the target; the training moments of fold t
are the exact parallel combination of the other folds' moments, and the
p x p normal equations of each fold are solved on the driver. Only k rows of
O(p^2) moments reach the driver; no data row does.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outfold.functions.safe import known
from outfold.operators.folds import check_folds
from outfold.operators.gram import wide_moments
from outfold.operators.joins import broadcast_bounded, materialize

#: Features up to which moments are aggregate columns, one for each pair.
WIDE = 40


def fold_moments(df: DataFrame, fold: str, y: str, xs) -> DataFrame:
    """Per fold over complete rows (a fold, and no null or NaN in y or any x): n,
    the means of every x_i and y, and the population co-moments cov(x_i, x_j),
    cov(x_i, y). One aggregate, k rows out."""
    xs = list(xs)
    complete = F.col(fold).isNotNull()
    for c in (*xs, y):
        complete = complete & known(c).isNotNull()
    cols = [*xs, y]
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)]
    aggs += [F.covar_pop(cols[i], cols[j]).alias(f"c_{i}_{j}")
             for i, j in combinations_with_replacement(range(len(cols)), 2)]
    return df.where(complete).groupBy(fold).agg(*aggs)


def _merge(parts: list, p1: int):
    """Exact combination of (n, means, co-moment matrix) of several folds."""
    n = sum(r[0] for r in parts)
    if n == 0:
        return 0, None, None
    mean = sum(r[0] * r[1] for r in parts) / n
    com = np.zeros((p1, p1))
    for cnt, mu, cov in parts:
        d = mu - mean
        com += cnt * cov + cnt * np.outer(d, d)
    return n, mean, com


def _moments(r, p1: int):
    mu = np.array([r[f"m_{i}"] for i in range(p1)], dtype=float)
    cov = np.zeros((p1, p1))
    for i, j in combinations_with_replacement(range(p1), 2):
        cov[i, j] = cov[j, i] = r[f"c_{i}_{j}"]
    return int(r["n"]), mu, cov


def solve(moments: list, p: int, l2: float = 0.0) -> list[float] | None:
    """``solve_parts`` of rows of ``fold_moments``."""
    return solve_parts([_moments(r, p + 1) for r in moments], p, l2)


def solve_parts(parts: list, p: int, l2: float = 0.0) -> list[float] | None:
    """Intercept and coefficients from moments (n, means, covariances; the target
    last) that are taken together; None without a row. Ridge ``l2`` adds to the
    diagonal of the centred normal equations (the intercept is not penalised)."""
    n, mean, com = _merge(parts, p + 1)
    if n < 1:
        return None
    lhs, rhs = com[:p, :p] + l2 * np.eye(p), com[:p, p]
    try:
        beta = np.linalg.solve(lhs, rhs)
    except np.linalg.LinAlgError:
        beta = np.linalg.lstsq(lhs, rhs, rcond=None)[0]
    return [float(mean[p] - mean[:p] @ beta), *map(float, beta)]


def linear(coefs: list[float] | None, xs):
    """Prediction as a column; null without a model, or where a feature is."""
    if coefs is None:
        return F.lit(None).cast("double")
    pred = F.lit(coefs[0])
    for b, c in zip(coefs[1:], xs, strict=True):
        pred = pred + F.lit(b) * known(c)
    return pred


def oof_ols(df: DataFrame, fold: str = "fold", y: str = "y", xs=("x",), k: int = 5,
            l2: float = 0.0, out: str = "pred") -> DataFrame:
    """Out-of-fold linear least squares: each row is predicted by the model
    fitted on the other folds. Rows with a null or NaN feature, without a fold,
    or without any training row get a null pred; rows without a fold train
    nothing; a fold outside 0..k-1 raises ValueError. More than ``WIDE`` features
    take their moments from blocks (``gram.wide_moments``), the rest is the same."""
    xs = list(xs)
    if len(xs) > WIDE:
        parts = wide_moments(df, [*xs, y], fold)
        if any(not 0 <= f < k for f in parts):
            raise ValueError(f"folds {min(parts)}..{max(parts)} are not in 0..{k - 1}")
    else:
        mom = materialize(fold_moments(df, fold, y, xs))
        check_folds(mom, fold, k)
        parts = {r[fold]: _moments(r, len(xs) + 1) for r in mom.collect()}  # k rows
    coefs = [(t, solve_parts([m for f, m in sorted(parts.items()) if f != t], len(xs), l2)) for t in range(k)]
    spark: SparkSession = df.sparkSession
    cdf = broadcast_bounded(spark.createDataFrame(
        coefs, T.StructType([T.StructField(fold, T.LongType()),
                             T.StructField("__b", T.ArrayType(T.DoubleType()))])), k)
    if len(xs) > WIDE:  # one expression over an array, not a sum nested once a feature
        terms = F.zip_with(F.slice("__b", 2, len(xs)), F.array(*[known(c) for c in xs]), lambda b, x: b * x)
        pred = F.aggregate(terms, F.col("__b")[0], lambda s, t: s + t)
    else:
        pred = F.col("__b")[0]
        for i, c in enumerate(xs):
            pred = pred + F.col("__b")[i + 1] * known(c)
    return df.join(cdf, on=fold, how="left").withColumn(out, pred).drop("__b")


def oof_gbt(df: DataFrame, fold: str = "fold", y: str = "y", xs=("x",), k: int = 5,
            max_iter: int = 20, max_depth: int = 5, seed: int = 7, out: str = "pred",
            parallelism: int | None = None, rate: float = 0.1, bins: int = 32) -> DataFrame:
    """Out-of-fold gradient-boosted trees with absolute loss, each on the rows of
    the other folds, as Spark ML's ``GBTRegressor`` boosts: a regression tree of the
    target, then ``max_iter - 1`` trees of the residuals' signs at ``rate``, whose
    leaves are means.

    The k models are grown together over the same bins (``boosting.fit``), so a round
    is one scan with few features, not a number of jobs for each fold and level; the
    cut points come from a sketch of all rows. The rows (fold, target, features) are
    written once, so what makes ``df`` runs once for the models and once for the scores.
    Nothing is drawn and no fits run side by side: ``seed`` and ``parallelism`` have no
    effect any more.

    Every row is returned. Rows without a fold, and rows whose fold has no
    training row (k=1), get a null pred; rows without a fold, with a null or
    NaN target train nothing; a fold outside 0..k-1 raises ValueError.
    """
    from outfold.operators import boosting

    names = [f"__x{i}" for i in range(len(xs))]
    train = materialize(df.select(F.col(fold).cast("bigint").alias("__f"), known(y).alias("__y"),
                                  *[known(c).alias(n) for c, n in zip(xs, names, strict=True)])
                        .where("__f is not null and __y is not null"))
    check_folds(train, "__f", k)
    model = boosting.fit(train, "__f", "__y", names, k, rounds=max_iter, depth=max_depth, rate=rate, bins=bins,
                         least_rows=1, leaf="mean")
    model.xs = list(xs)
    return boosting.predict(df, model, F.col(fold), out)
