"""Scores: pooled MAE (R4), per fold (D21), per segment (D22), the gap between
two scores (D23) and a blend search (D24).

Every score is one partial+final hash aggregate; scalars are attached with a
scalar subquery (``DataFrame.scalar()``), never with a join. When a scalar is
taken over a grouped result, the grouped table (k folds, segments, weights)
is materialised once so the subquery does not rerun the scoring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outfold.functions.safe import abs_err, col_, known, safe_div
from outfold.operators.joins import materialize


def _mae_aggs(y, pred, exact: bool = False) -> list[Column]:
    err = abs_err(y, pred)
    if exact:
        # decimal sums are exact, so the score does not depend on the order
        # in which partitions are merged (bit-identical on every run)
        total = F.sum(err.cast("decimal(38,9)")).cast("double")
        m = F.try_divide(total, F.count(err).cast("double"))
    else:
        m = F.avg(err)
    return [
        m.alias("mae"),
        F.count(err).alias("n_scored"),
        (F.count(F.lit(1)) - F.count(err)).alias("n_missing"),
    ]


def mae(df: DataFrame, y: str = "y", pred: str = "pred", exact: bool = False) -> DataFrame:
    """One row: (mae, n_scored, n_missing). Pairs with a null ``y`` or ``pred``
    are not scored but counted; an empty input gives a null mae.

    ``exact``: sum the errors as decimal(38,9), so the result is identical for
    any partitioning and merge order (a double ``avg`` may differ in its last
    bits between runs of different layout); somewhat slower.
    """
    return df.agg(*_mae_aggs(y, pred, exact))


def mae_by_fold(df: DataFrame, y: str = "y", pred: str = "pred",
                fold: str = "fold", exact: bool = False) -> DataFrame:
    """Per fold: (fold, mae, n_scored, n_missing, mean_fold_mae, sd_fold_mae).

    The pooled MAE equals the n_scored-weighted mean of fold MAEs, not the
    plain mean, unless folds are equal in size.
    """
    per = materialize(df.groupBy(fold).agg(*_mae_aggs(y, pred, exact)))
    return (per.withColumn("mean_fold_mae", per.agg(F.avg("mae")).scalar())
            .withColumn("sd_fold_mae", per.agg(F.stddev_samp("mae")).scalar()))


def mae_by(df: DataFrame, by, y: str = "y", pred: str = "pred", exact: bool = False) -> DataFrame:
    """Per segment: (by, mae, n_scored, n_missing, sum_abs_err, err_share),
    ``err_share`` being the segment's part of the total absolute error."""
    by = [by] if isinstance(by, str) else list(by)
    err = abs_err(y, pred)
    per = materialize(df.groupBy(*by).agg(*_mae_aggs(y, pred, exact), F.sum(err).alias("sum_abs_err")))
    total = per.agg(F.sum("sum_abs_err")).scalar()
    return per.withColumn("err_share", safe_div(F.col("sum_abs_err"), total))


def mae_report(df: DataFrame, fold: str = "fold", by: str | None = None, y: str = "y",
               pred: str = "pred", exact: bool = False) -> DataFrame:
    """Pooled, per-fold and (with ``by``) per-segment MAE from one aggregate
    over the scored rows by (fold, segment); the levels are rolled up from its
    few rows. Rows: (level, key, mae, n_scored, n_missing) with level in
    {"pooled", "fold", <by>} and key the fold or segment as a string."""
    err = abs_err(y, pred)
    keys = [fold] + ([by] if by else [])
    total = F.sum(err.cast("decimal(38,9)")) if exact else F.sum(err)
    cells = materialize(df.groupBy(*keys).agg(
        total.alias("__e"), F.count(err).alias("__n"), F.count(F.lit(1)).alias("__all")))

    def level(name: str, column: str | None) -> DataFrame:
        key = F.col(column).cast("string") if column else F.lit(None).cast("string")
        return cells.groupBy(F.lit(name).alias("level"), key.alias("key")).agg(
            safe_div(F.sum("__e").cast("double"), F.sum("__n").cast("double")).alias("mae"),
            F.sum("__n").alias("n_scored"), (F.sum("__all") - F.sum("__n")).alias("n_missing"))

    pooled = cells.agg(
        safe_div(F.sum("__e").cast("double"), F.sum("__n").cast("double")).alias("mae"),
        F.coalesce(F.sum("__n"), F.lit(0)).alias("n_scored"),
        F.coalesce(F.sum("__all") - F.sum("__n"), F.lit(0)).alias("n_missing")).select(
        F.lit("pooled").alias("level"), F.lit(None).cast("string").alias("key"), "*")
    out = pooled.unionByName(level("fold", fold))
    return out.unionByName(level(by, by)) if by else out


def gap(scored_a: DataFrame, scored_b: DataFrame, y: str = "y", pred: str = "pred",
        names=("oof", "holdout")) -> DataFrame:
    """D23: one row comparing two scored tables (e.g. out-of-fold and held-out):
    both MAEs, their counts, ``gap = b - a`` and ``gap_pct = 100 * gap / a``.

    The two inputs are tagged and unioned, so both scores come from one
    aggregate and no join is needed. Where both are one table with a flag, see
    ``gap_of``, which reads it once.
    """
    a, b = names
    err = abs_err(y, pred)
    u = (scored_a.select(F.lit(a).alias("__src"), err.alias("__e"))
         .unionByName(scored_b.select(F.lit(b).alias("__src"), err.alias("__e"))))
    return _gap(u, names)


def gap_of(scored: DataFrame, second, y: str = "y", pred: str = "pred",
           names=("oof", "holdout")) -> DataFrame:
    """``gap`` of the rows of one table without and with the flag ``second``."""
    src = F.when(second, names[1]).otherwise(names[0])
    return _gap(scored.select(src.alias("__src"), abs_err(y, pred).alias("__e")), names)


def _gap(u: DataFrame, names) -> DataFrame:
    a, b = names
    mae_a = F.avg(F.when(F.col("__src") == a, F.col("__e")))
    mae_b = F.avg(F.when(F.col("__src") == b, F.col("__e")))
    r = u.agg(mae_a.alias(f"mae_{a}"), mae_b.alias(f"mae_{b}"),
              F.count(F.when(F.col("__src") == a, F.col("__e"))).alias(f"n_{a}"),
              F.count(F.when(F.col("__src") == b, F.col("__e"))).alias(f"n_{b}"))
    g = F.col(f"mae_{b}") - F.col(f"mae_{a}")
    return r.withColumn("gap", g).withColumn("gap_pct", safe_div(g * 100.0, F.col(f"mae_{a}")))


def blend(df: DataFrame, p1: str, p2: str, y: str = "y", steps: int = 10) -> DataFrame:
    """D24: MAE of ``w*p1 + (1-w)*p2`` for ``w = 0, 1/steps, ..., 1``, all in one
    aggregate, one row per weight, with ``best`` marking the lowest MAE
    (ties to the smaller weight)."""
    return blend_many(df, [p1, p2], y, steps).select(
        F.col("weights")[0].alias("w"), "mae", "best")


def blend_many(df: DataFrame, preds, y: str = "y", steps: int = 10) -> DataFrame:
    """MAE of every mixture of ``preds`` with weights in steps of 1/``steps``
    that sum to 1, all in one aggregate: (weights, mae, n_scored, best). The
    number of mixtures, (steps + p - 1 choose p - 1), is a parameter of the
    call. ``best`` marks the lowest MAE to six decimals, ties to the smaller
    weights in order. A row is scored where y and all preds are known."""
    preds = list(preds)

    def parts(left: int, n: int):
        if n == 1:
            yield (left,)
            return
        for i in range(left + 1):
            for rest in parts(left - i, n - 1):
                yield (i, *rest)

    grid = [tuple(i / steps for i in w) for w in parts(steps, len(preds))]
    all_known = known(y).isNotNull()
    for p in preds:
        all_known = all_known & known(p).isNotNull()
    aggs = []
    for i, w in enumerate(grid):
        mixed = F.lit(w[0]) * col_(preds[0])
        for wi, p in zip(w[1:], preds[1:], strict=True):
            mixed = mixed + F.lit(wi) * col_(p)
        aggs.append(F.avg(F.when(all_known, F.abs(col_(y) - mixed))).alias(f"m{i}"))
    wide = materialize(df.agg(F.count(F.when(all_known, 1)).alias("n"), *aggs))
    rows = F.array(*[F.struct(F.array(*[F.lit(x) for x in w]).alias("weights"),
                              F.col(f"m{i}").alias("mae"), F.col("n").alias("n_scored"))
                     for i, w in enumerate(grid)])
    long = wide.select(F.inline(rows))
    best = long.orderBy(F.round("mae", 6).asc_nulls_last(), F.col("weights")).select("weights").limit(1)
    return long.withColumn("best", F.col("weights") == best.scalar())
