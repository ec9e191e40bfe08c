"""Held-out scoring (R5): fit on training rows, score rows never used in a fold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outfold.functions.folds import fold_col
from outfold.functions.safe import known, safe_div
from outfold.operators.joins import broadcast_if_small, materialize
from outfold.operators.models import fold_moments, linear, solve

HOLD_SEED = "hold"


def split_holdout(df: DataFrame, key, parts: int = 10, seed: str = HOLD_SEED,
                  col: str = "is_holdout") -> DataFrame:
    """Flag rows whose seeded key hash falls in bucket 0 of ``parts``: about
    1/parts of the rows, the same on every run; no shuffle. A row without a key
    is not held out, so each row is in exactly one of the two parts."""
    return df.withColumn(col, F.coalesce(fold_col(key, parts, seed) == 0, F.lit(False)))


def fit_group_mean(train: DataFrame, y: str, by) -> tuple[DataFrame, DataFrame]:
    """(by, sum, count) per group, materialised once, and the one-row global
    (sum, count) derived from it (the null group included), so the training
    rows are read once."""
    by = [by] if isinstance(by, str) else list(by)
    model = materialize(train.groupBy(*by).agg(
        F.sum(known(y)).alias("__gs"), F.count(known(y)).alias("__gn")))
    glob = model.agg(F.sum("__gs").alias("__s"), F.sum("__gn").alias("__n"))
    return model, glob


def score_group_mean(test: DataFrame, model: DataFrame, glob: DataFrame, by,
                     out: str = "pred", m: float = 0.0) -> DataFrame:
    """Score ``test`` with a fitted group-mean model, smoothed by ``m`` rows of
    the global mean; an unseen group gets the global training mean (a scalar
    subquery, no join)."""
    by = [by] if isinstance(by, str) else list(by)
    gmean = glob.select(safe_div("__s", "__n")).scalar()
    j = test.join(broadcast_if_small(model), on=by, how="left")
    if m:
        s, n = F.coalesce("__gs", F.lit(0.0)), F.coalesce("__gn", F.lit(0)).cast("double")
        pred = safe_div(s + F.lit(float(m)) * gmean, n + F.lit(float(m)))
    else:
        pred = safe_div("__gs", "__gn")
    return j.withColumn(out, F.coalesce(pred, gmean)).drop("__gs", "__gn")


def holdout_score(df: DataFrame, key, y: str, by, parts: int = 10,
                  seed: str = HOLD_SEED) -> DataFrame:
    """R5: one row (mae, n_scored, n_missing) on the held-out part."""
    from outfold.operators.metrics import mae
    return mae(holdout_predict(df, key, y, by, parts, seed), y=y)


def holdout_predict(df: DataFrame, key, y: str, by, parts: int = 10,
                    seed: str = HOLD_SEED, out: str = "pred") -> DataFrame:
    """Rows of the held-out part with predictions from the other parts."""
    flagged = split_holdout(df, key, parts, seed, "__hold")
    train = flagged.where(~F.col("__hold"))
    test = flagged.where(F.col("__hold")).drop("__hold")
    model, glob = fit_group_mean(train, y, by)
    return score_group_mean(test, model, glob, by, out)


def holdout_encode(df: DataFrame, key, y: str, by, m: float = 20.0, parts: int = 10,
                   seed: str = HOLD_SEED, out: str = "pred") -> DataFrame:
    """The held-out part with the smoothed target encoding of the other parts:
    the held-out form of ``oof_encode``."""
    flagged = split_holdout(df, key, parts, seed, "__hold")
    model, glob = fit_group_mean(flagged.where(~F.col("__hold")), y, by)
    return score_group_mean(flagged.where("__hold").drop("__hold"), model, glob, by, out, m)


def holdout_linear(df: DataFrame, key, y: str, xs, l2: float = 0.0, parts: int = 10,
                   seed: str = HOLD_SEED, out: str = "pred") -> DataFrame:
    """The held-out part with least squares fitted on the other parts: the
    held-out form of ``oof_ols``. One row of moments reaches the driver."""
    xs = list(xs)
    flagged = split_holdout(df, key, parts, seed, "__hold")
    rows = fold_moments(flagged.where(~F.col("__hold")).withColumn("__one", F.lit(0)),
                        "__one", y, xs).collect()
    return flagged.where("__hold").drop("__hold").withColumn(out, linear(solve(rows, len(xs), l2), xs))
