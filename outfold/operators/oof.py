"""Out-of-fold models that need no fitting loop: group mean (R3), smoothed
target encoding (D15) and group median (D16).

The k-fold cost is removed by algebra, not by k passes: per (group, fold)
partial sums are aggregated once (map-side combine, so a hot group costs one
row per task, not its rows), the out-of-fold sum of a (group, fold) is the
group total minus its own fold, and the result is joined back to the rows.
The fact rows are never shuffled for the model. The (group, fold) table is
materialised and broadcast when its measured size is under the threshold, so
the join back streams the fact without a shuffle; beyond it a shuffle join
with AQE's skew splitting is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outfold.functions.safe import known, safe_div
from outfold.operators.folds import check_folds
from outfold.operators.joins import (broadcast_bounded, broadcast_checked, broadcast_if_small,
                                     broadcast_sized, materialize, table_bytes)
from outfold.operators.quantiles import exact_quantiles


def _cols(by):
    return [by] if isinstance(by, str) else list(by)


def _other_folds(fold: str, k: int) -> Column:
    """Array of the k-1 folds a row of fold ``fold`` trains."""
    return F.filter(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint")),
                    lambda t: t != F.col(fold))


def group_fold_sums(df: DataFrame, fold: str, y: str, by) -> DataFrame:
    """Sum and count of the known ``y`` (not null, not NaN) per (by, fold): one
    partial+final aggregate."""
    by = _cols(by)
    return df.groupBy(*by, fold).agg(F.sum(known(y)).alias("__s"), F.count(known(y)).alias("__n"))


def oof_group_sums(df: DataFrame, fold: str, y: str, by, stats: DataFrame | None = None) -> DataFrame:
    """(by, fold, s_oof, n_oof): sum/count of ``y`` in the group's other folds.

    The window only sees the aggregated table (k rows per group); ``stats``
    may pass an already computed ``group_fold_sums``.
    """
    by = _cols(by)
    st = stats if stats is not None else group_fold_sums(df, fold, y, by)
    # ordered by fold so the k partial sums are added in the same order on
    # every run (shuffle fetch order would otherwise decide the last bits)
    w = (Window.partitionBy(*by).orderBy(fold)
         .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return st.select(
        *by, fold,
        (F.coalesce(F.sum("__s").over(w), F.lit(0.0)) - F.coalesce(F.col("__s"), F.lit(0.0)))
        .alias("s_oof"),
        (F.sum("__n").over(w) - F.col("__n")).alias("n_oof"))


def oof_global_sums(df: DataFrame, fold: str, y: str, k: int,
                    stats: DataFrame | None = None) -> DataFrame:
    """(fold, gs_oof, gn_oof): sum/count of ``y`` over all other folds; k rows.
    With ``stats`` (a ``group_fold_sums`` table) the fact is not read again."""
    if stats is not None:
        per = stats.groupBy(fold).agg(F.sum("__s").alias("__s"), F.sum("__n").alias("__n"))
    else:
        per = df.groupBy(fold).agg(F.sum(known(y)).alias("__s"), F.count(known(y)).alias("__n"))
    g = (per.withColumn("__t", F.explode(_other_folds(fold, k)))
         .groupBy("__t").agg(F.sum("__s").alias("gs_oof"), F.sum("__n").alias("gn_oof"))
         .withColumnRenamed("__t", fold))
    return broadcast_bounded(g, k)


def oof_predict(df: DataFrame, fold: str = "fold", y: str = "y", by="g",
                k: int = 5, out: str = "pred") -> DataFrame:
    """R3: predict each row by the mean of ``y`` over rows of its ``by`` group
    in the other folds; when the group has no such rows, the mean of ``y``
    over all rows of the other folds. Never uses the row's own fold."""
    return oof_encode(df, col=by, y=y, fold=fold, k=k, m=None, out=out)


def oof_encode(df: DataFrame, col="g", y: str = "y", fold: str = "fold", k: int = 5,
               m: float | None = 20.0, out: str | None = None,
               stats: DataFrame | None = None) -> DataFrame:
    """D15: out-of-fold target encoding ``(S + m*G) / (N + m)``.

    S, N: sum and count of ``y`` for the row's category in the other folds;
    G: mean of ``y`` over all other folds. ``m=None`` gives the plain
    out-of-fold group mean with fallback to G (R3). ``stats``: learn from this
    table (``group_fold_sums``, of other rows) instead of ``df``, which then needs
    no target.
    """
    by = _cols(col)
    out = out or (f"{by[0]}_te" if m is not None else "pred")
    if stats is not None:
        # rows may have a (group, fold) that the table lacks: give each group all folds
        check_folds(stats, fold, k)
        every = F.array(*[F.lit(t).cast(stats.schema[fold].dataType) for t in range(k)])
        zero = stats.select(*by).distinct().select(
            *by, F.explode(every).alias(fold), F.lit(None).cast("double").alias("__s"),
            F.lit(0).cast("bigint").alias("__n"))
        st = materialize(stats.unionByName(zero).groupBy(*by, fold).agg(
            F.sum("__s").alias("__s"), F.sum("__n").alias("__n")))
    else:
        # a row without a fold (null key) trains nothing
        st = materialize(group_fold_sums(df.where(F.col(fold).isNotNull()), fold, y, by))
        check_folds(st, fold, k)
    # the window keeps one row per (group, fold): the stats' size is its size
    sums = broadcast_sized(oof_group_sums(df, fold, y, by, stats=st), table_bytes(st))
    glob = oof_global_sums(df, fold, y, k, stats=st)
    j = df.join(sums, on=[*by, fold], how="left").join(glob, on=fold, how="left")
    g_mean = safe_div("gs_oof", "gn_oof")
    s = F.coalesce(F.col("s_oof"), F.lit(0.0))
    n = F.coalesce(F.col("n_oof"), F.lit(0)).cast("double")
    if m is None:
        pred = F.coalesce(safe_div(s, n), g_mean)
    else:
        pred = F.coalesce(safe_div(s + F.lit(float(m)) * g_mean, n + F.lit(float(m))), g_mean)
    return j.withColumn(out, pred).drop("s_oof", "n_oof", "gs_oof", "gn_oof")


def oof_encode_many(df: DataFrame, cols, y: str = "y", fold: str = "fold", k: int = 5,
                    m: float | None = 20.0, suffix: str = "_te") -> DataFrame:
    """D15 for several categorical columns from one scan of the fact: one
    aggregate with a grouping set (column, fold) per column gives every
    column's per-fold sums at once; each column is then encoded as in
    ``oof_encode`` with its own measured join back."""
    cols = list(cols)
    sets = [[c, fold] for c in cols]
    st = df.where(F.col(fold).isNotNull()).groupingSets(sets, *cols, fold).agg(
        F.sum(known(y)).alias("__s"), F.count(known(y)).alias("__n"),
        *[F.grouping(c).alias(f"__g_{c}") for c in cols])
    st = materialize(st)
    check_folds(st, fold, k)
    n_st = table_bytes(st)   # an upper bound on every column's (value, fold) table
    per_col = {c: st.where(F.col(f"__g_{c}") == 0).select(c, fold, "__s", "__n") for c in cols}
    glob = oof_global_sums(df, fold, y, k, stats=per_col[cols[0]])
    out = df.join(glob, on=fold, how="left")
    g_mean = safe_div("gs_oof", "gn_oof")
    for c in cols:
        sums = oof_group_sums(df, fold, y, c, stats=per_col[c]).select(
            c, fold, F.col("s_oof").alias("__so"), F.col("n_oof").alias("__no"))
        out = out.join(broadcast_sized(sums, n_st), on=[c, fold], how="left")
        s = F.coalesce(F.col("__so"), F.lit(0.0))
        n = F.coalesce(F.col("__no"), F.lit(0)).cast("double")
        if m is None:
            te = F.coalesce(safe_div(s, n), g_mean)
        else:
            te = F.coalesce(safe_div(s + F.lit(float(m)) * g_mean, n + F.lit(float(m))), g_mean)
        out = out.withColumn(f"{c}{suffix}", te).drop("__so", "__no")
    return out.drop("gs_oof", "gn_oof")


def oof_predict_kinds(df: DataFrame, folds: dict[str, str], y: str = "y", by="g", k: int = 5
                      ) -> DataFrame:
    """R3 for several fold columns at once (``folds``: name -> column), one
    ``pred_<name>`` each: one aggregate with a grouping set per fold column, and
    one scoring pass."""
    by = _cols(by)
    cols = list(folds.values())
    st = materialize(df.groupingSets([[*by, f] for f in cols], *by, *cols).agg(
        F.sum(known(y)).alias("__s"), F.count(known(y)).alias("__n"),
        *[F.grouping(f).alias(f"__g_{f}") for f in cols]))
    size = table_bytes(st)
    out = df
    for name, f in folds.items():
        own = st.where((F.col(f"__g_{f}") == 0) & F.col(f).isNotNull()).select(*by, f, "__s", "__n")
        check_folds(own, f, k)
        sums = oof_group_sums(df, f, y, by, stats=own).select(
            *by, f, F.col("s_oof").alias("__so"), F.col("n_oof").alias("__no"))
        out = (out.join(broadcast_sized(sums, size), on=[*by, f], how="left")
               .join(oof_global_sums(df, f, y, k, stats=own), on=f, how="left")
               .withColumn(f"pred_{name}", F.coalesce(safe_div("__so", "__no"),
                                                      safe_div("gs_oof", "gn_oof")))
               .drop("__so", "__no", "gs_oof", "gn_oof"))
    return out


def oof_with_holdout(df: DataFrame, hold: str, fold: str = "fold", y: str = "y", by="g", k: int = 5,
                     out: str = "pred") -> DataFrame:
    """R3 and R5 in one: rows without the flag ``hold`` are predicted out of
    fold, rows with it from all rows without it; neither trains on itself. One
    aggregate and one scoring pass: held-out rows get a fold number of their own
    that trains nothing, so "all other folds" is all training rows for them.
    Rows with neither flag nor fold train nothing and get a null pred."""
    num = F.when(F.col(hold), F.lit(k)).otherwise(F.col(fold))
    target = F.when(~F.col(hold), known(y))
    scored = oof_encode(df.withColumn("__hf", num.cast("bigint")).withColumn("__hy", target),
                        col=by, y="__hy", fold="__hf", k=k + 1, m=None, out=out)
    return scored.drop("__hf", "__hy")


def oof_median(df: DataFrame, fold: str = "fold", y: str = "y", by="g", k: int = 5,
               out: str = "pred", method: str = "exact", sketch_k: int = 2000) -> DataFrame:
    """D16: out-of-fold group median (the constant minimising absolute error),
    falling back to the out-of-fold global median.

    Medians do not subtract, so each training value must reach the k-1 folds
    it trains.

    ``method="sketch"``: one KLL sketch per (group, fold) is aggregated map-side, and only the sketches are
    replicated to the k-1 folds they train and merged; the rows are read
    once and never replicated, and every buffer has a bounded size. Sketches
    are approximate and their last digits depend on the merge order.

    ``method="exact"`` (the default): ``exact_quantiles`` in fold mode:
    brackets from sketches, counts per fold, no row replicated.
    """
    by = _cols(by)
    base = df.withColumn(y, known(y)).where(F.col(y).isNotNull() & F.col(fold).isNotNull())
    if method == "exact":
        # one search: all rows together are one more group
        both = base.select(fold, y, *by, F.explode(F.array(F.lit(False), F.lit(True))).alias("__all"))
        both = both.select(fold, y, "__all", *[F.when(~F.col("__all"), F.col(c)).alias(c) for c in by])
        q = materialize(exact_quantiles(both, y, [0.5], by=["__all", *by], fold=fold, k=k, out="__q").select(
            "__all", *by, fold, F.col("__q")[0].alias("__gm")))
        grp = q.where("not __all").drop("__all")
        glob = q.where("__all").select(fold, F.col("__gm").alias("__glob"))
    elif method == "sketch":
        sk = base.groupBy(*by, fold).agg(
            F.kll_sketch_agg_double(F.col(y), F.lit(sketch_k)).alias("__sk"))
        sk = materialize(sk)
        check_folds(sk, fold, k)
        rep = sk.withColumn("__t", F.explode(_other_folds(fold, k)))
        grp = (rep.groupBy(*by, "__t").agg(F.kll_merge_agg_double("__sk").alias("__sk"))
               .select(*by, F.col("__t").alias(fold),
                       F.kll_sketch_get_quantile_double("__sk", F.lit(0.5)).alias("__gm")))
        gsk = sk.groupBy(fold).agg(F.kll_merge_agg_double("__sk").alias("__sk"))
        glob = (gsk.withColumn("__t", F.explode(_other_folds(fold, k)))
                .groupBy("__t").agg(F.kll_merge_agg_double("__sk").alias("__sk"))
                .select(F.col("__t").alias(fold),
                        F.kll_sketch_get_quantile_double("__sk", F.lit(0.5)).alias("__glob")))
    else:
        raise ValueError(f"unknown method {method!r}")
    glob = broadcast_bounded(glob, k)
    grp = broadcast_if_small(grp) if method == "exact" else broadcast_checked(grp)
    j = df.join(grp, on=[*by, fold], how="left").join(glob, on=fold, how="left")
    return j.withColumn(out, F.coalesce("__gm", "__glob")).drop("__gm", "__glob")


def nested_encoded_ols(df: DataFrame, col, y: str = "y", fold: str = "fold", k: int = 5,
                       m: float = 20.0, out: str = "pred") -> DataFrame:
    """Out-of-fold least squares of ``y`` on the target encoding of ``col``,
    without a leak from the encoding into the model.

    The model that scores fold t is fitted on rows of the other folds; the
    encoding of such a row of fold f leaves out f *and* t, since with t it would
    hold targets of the rows to be scored. A row of fold t is scored with the
    encoding from all other folds. Encoding and model need nothing but the sums
    per (category, fold): one aggregate, and a table of k^2 rows per category.
    """
    by = _cols(col)
    st = materialize(group_fold_sums(df.where(F.col(fold).isNotNull()), fold, y, by)
                     .select(F.struct(*by).alias("__g"), F.col(fold).alias("__f"), "__s", "__n")
                     .withColumn("__s", F.coalesce("__s", F.lit(0.0))))
    check_folds(st, "__f", k)
    # sums over the folds other than the own and the target one
    own = Window.partitionBy("__g").orderBy("__f").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    everyone = st.select("__g", "__f", "__s", "__n", F.collect_list(
        F.struct("__f", "__s", "__n")).over(own).alias("__all"))
    pairs = everyone.withColumn("__t", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).select(
        "*", F.filter("__all", lambda r: (r["__f"] != F.col("__f")) & (r["__f"] != F.col("__t"))
                      ).alias("__rest"))
    total = (st.groupBy("__f").agg(F.sum("__s").alias("__s"), F.sum("__n").alias("__n"))
             .agg(F.collect_list(F.struct("__f", "__s", "__n"))).first()[0])  # k rows
    def mean(skip: set) -> float | None:
        n = sum(r["__n"] for r in total if r["__f"] not in skip)
        return sum(r["__s"] for r in total if r["__f"] not in skip) / n if n else None
    spark = df.sparkSession
    glob = broadcast_bounded(spark.createDataFrame(
        [(f, t, mean({f, t})) for f in range(k) for t in range(k)],
        "__f bigint, __t int, __m double"), k * k)

    def add(field: str):
        zero = F.lit(0.0) if field == "__s" else F.lit(0).cast("bigint")
        return F.aggregate("__rest", zero, lambda acc, r: acc + r[field])

    enc = safe_div(add("__s") + F.lit(float(m)) * F.col("__m"), add("__n") + F.lit(float(m)))
    coded = pairs.join(glob, ["__f", "__t"]).withColumn("__x", F.coalesce(enc, F.col("__m")))
    # Moments of (x, y) over the rows of each training set: x is one value per
    # (category, fold, target), so the sums give them; centred on the mean of x.
    train = materialize(coded.where("__f <> __t and __n > 0").select("__t", "__x", "__s", "__n"))
    centre = train.groupBy("__t").agg((F.sum(F.col("__x") * F.col("__n")) / F.sum("__n")).alias("__mx"),
                                      (F.sum("__s") / F.sum("__n")).alias("__my"))
    d = F.col("__x") - F.col("__mx")
    line = train.join(broadcast_bounded(centre, k), "__t").groupBy("__t", "__mx", "__my").agg(
        F.sum(d * (F.col("__s") - F.col("__n") * F.col("__my"))).alias("__xy"),
        F.sum(d * d * F.col("__n")).alias("__xx"))
    slope = F.coalesce(safe_div("__xy", "__xx"), F.lit(0.0))
    line = broadcast_bounded(line.select(F.col("__t").cast("bigint").alias(fold), slope.alias("__b1"),
                                         (F.col("__my") - slope * F.col("__mx")).alias("__b0")), k)
    scored = oof_encode(df, col=by, y=y, fold=fold, k=k, m=m, out="__te").join(line, fold, "left")
    return scored.withColumn(out, F.col("__b0") + F.col("__b1") * F.col("__te")).drop(
        "__te", "__b0", "__b1")
