"""Features: enrich a fact with dimension attributes (D9), fill missing values
(D11), one-hot and label index (D12), ratios (D13), z-score and quantile bins
(D14).

Statistics that feed a model (medians, means, cut points) are fitted on the
``fit_on`` rows (the training fold) and applied to ``df``, so nothing leaks
from scored rows into their own features.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outfold.functions.safe import known, safe_div
from outfold.operators.checks import check_unique
from outfold.operators.folds import check_folds
from outfold.operators.joins import broadcast_bounded, broadcast_checked, materialize
from outfold.operators.quantiles import SKETCH_K, exact_quantiles, quantile_agg


class DimensionKeyError(ValueError):
    pass


def enrich(fact: DataFrame, dim: DataFrame, key, how: str = "left",
           check: bool = True) -> DataFrame:
    """Attach dimension columns to every fact row.

    With ``check`` the dimension key is verified unique first (one aggregate
    over the dimension), so the join can never multiply fact rows. No
    broadcast hint: Catalyst broadcasts a dimension estimated under the
    threshold, AQE one measured under it, and a large dimension is joined by
    sort-merge with skewed keys split.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if check and check_unique(dim, keys).limit(1).count():
        raise DimensionKeyError(f"dimension key {keys} is not unique")
    return fact.join(dim, on=keys, how=how)


def impute(df: DataFrame, cols, by=None, stat: str = "median", fit_on: DataFrame | None = None,
           exact: bool = True, flag_suffix: str = "_was_null", fold: str | None = None,
           k: int | None = None) -> DataFrame:
    """Fill nulls in ``cols`` with the ``by`` group's median (or mean) fitted
    on ``fit_on`` (default ``df``), falling back to the overall statistic;
    add a ``<col>_was_null`` flag per column. NaN teaches nothing and is kept.

    With ``fold``/``k`` the statistics are out of fold: a row of fold t is
    filled from the rows of the other folds only, so imputed values feeding a
    cross-validated model carry nothing from the row's own fold.

    All columns are handled together: the fit rows are unpivoted to
    (column, value), so one statistic per (column, group) and one per column
    come from a single search each (exact medians by ``exact_quantiles``,
    never a whole group in one task; ``exact=False`` uses
    ``percentile_approx``), and the group table is pivoted back to one row
    per group for a single measured join.
    """
    cols = [cols] if isinstance(cols, str) else list(cols)
    fit = fit_on if fit_on is not None else df
    if stat not in ("median", "mean"):
        raise ValueError(f"unknown stat {stat!r}")
    if fold is not None and not k:
        raise ValueError("k is required with fold")
    by = [] if by is None else ([by] if isinstance(by, str) else list(by))
    fk = [fold] if fold is not None else []
    long = fit.select(*by, *fk, F.inline(F.array(*[
        F.struct(F.lit(c).alias("__col"), known(c).alias("__x")) for c in cols])))
    if fold is not None:
        long = long.where(F.col(fold).isNotNull())

    def stats(keys):
        """(keys, [fold], __v): the statistic per key (per target fold)."""
        if fold is not None and stat == "mean":
            per = long.groupBy(*keys, fold).agg(F.sum("__x").alias("__s"), F.count("__x").alias("__n"))
            tot = per.groupBy(*keys).agg(F.sum("__s").alias("__ts"), F.sum("__n").alias("__tn"))
            t = tot.withColumn(fold, F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                          F.lit(k - 1).cast("bigint"))))
            t = t.join(per, on=[*keys, fold], how="left")
            return t.select(*keys, fold, safe_div(
                F.col("__ts") - F.coalesce("__s", F.lit(0.0)),
                F.col("__tn") - F.coalesce("__n", F.lit(0))).alias("__v"))
        if stat == "mean":
            return long.groupBy(*keys).agg(F.avg("__x").alias("__v"))
        if exact:
            return exact_quantiles(long, "__x", [0.5], by=keys, fold=fold, k=k, out="__q").select(
                *keys, *fk, F.col("__q")[0].alias("__v"))
        if fold is not None:  # sketches of the folds, merged over the others
            sk = long.where(F.col("__x").isNotNull()).groupBy(*keys, fold).agg(
                F.kll_sketch_agg_double("__x", F.lit(SKETCH_K)).alias("__sk"))
            other = F.filter(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint")),
                             lambda t: t != F.col(fold))
            return (sk.withColumn("__t", F.explode(other)).groupBy(*keys, "__t")
                    .agg(F.kll_merge_agg_double("__sk").alias("__sk"))
                    .select(*keys, F.col("__t").alias(fold),
                            F.kll_sketch_get_quantile_double("__sk", F.lit(0.5)).alias("__v")))
        return long.groupBy(*keys).agg(
            quantile_agg(F.col("__x"), [0.5], exact=False)[0].alias("__v"))

    def wide(t, keys, pre):
        """One row per ``keys`` with a ``<pre><col>`` column per column."""
        return t.groupBy(*keys).pivot("__col", cols).agg(F.first("__v")).select(
            *keys, *[F.col(c).alias(f"{pre}{c}") for c in cols])

    out = df
    for c in cols:
        out = out.withColumn(f"{c}{flag_suffix}", F.col(c).isNull())
    if by and exact and stat == "median":
        # one search: all rows of a column are one more group
        both = long.select("__col", "__x", *by, *fk, F.explode(F.array(F.lit(False), F.lit(True))).alias("__all"))
        both = both.select("__col", "__x", "__all", *fk, *[F.when(~F.col("__all"), F.col(c)).alias(c) for c in by])
        found = materialize(exact_quantiles(
            both, "__x", [0.5], by=["__col", "__all", *by], fold=fold, k=k, out="__q").select(
            "__col", "__all", *by, *fk, F.col("__q")[0].alias("__v")))
        glob, fills = found.where("__all").drop("__all", *by), found.where("not __all").drop("__all")
    else:
        glob, fills = stats(["__col"]), (stats(["__col", *by]) if by else None)
    glob = materialize(wide(glob, fk, "__glob_"))
    if fold is not None:
        out = out.join(broadcast_bounded(glob, k), on=fold, how="left")
    if by:
        out = out.join(broadcast_checked(wide(fills, [*by, *fk], "__fill_")),
                       on=[*by, *fk], how="left")
    for c in cols:
        fill = [F.col(f"__fill_{c}")] if by else []
        g = F.col(f"__glob_{c}") if fold is not None else glob.select(f"__glob_{c}").scalar()
        out = out.withColumn(c, F.coalesce(F.col(c).cast("double"), *fill, g))
    drop = ([f"__fill_{c}" for c in cols] if by else []) + \
           ([f"__glob_{c}" for c in cols] if fold is not None else [])
    return out.drop(*drop)


def category_values(df: DataFrame, col: str, max_values: int = 1000) -> list:
    """Distinct values of a categorical column. More than ``max_values`` raise:
    each value becomes a column of the plan. List the values to choose some, or
    use ``label_index``, which has no such bound."""
    vals = df.select(col).where(F.col(col).isNotNull()).distinct().limit(max_values + 1).collect()
    if len(vals) > max_values:
        raise ValueError(f"{col} has more than {max_values} values")
    return sorted(r[0] for r in vals)


def one_hot(df: DataFrame, col: str, values=None, prefix: str | None = None,
            max_values: int = 1000) -> DataFrame:
    """One 0/1 int column per listed value; a null or unlisted value is all zeros."""
    values = list(values) if values is not None else category_values(df, col, max_values)
    prefix = prefix or col
    return df.select("*", *[F.when(F.col(col) == F.lit(v), 1).otherwise(0).alias(f"{prefix}_{v}")
                            for v in values])


def label_index(df: DataFrame, col: str, out: str | None = None, fit_on: DataFrame | None = None
                ) -> DataFrame:
    """Index categories 0, 1, ... by (frequency desc, value asc) on ``fit_on``;
    unseen or null categories get null. Any number of categories: they are
    dealt out in order by a range partitioning, numbered inside each partition,
    and shifted by the partitions' prefix sums; the index is joined back by
    broadcast only if its measured size allows."""
    out = out or f"{col}_idx"
    fit = fit_on if fit_on is not None else df
    freq = fit.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("__c"))
    # a table, so that its partitions are the same in both uses below
    dealt = materialize(freq.repartitionByRange(F.col("__c").desc(), F.col(col).asc())
                        .withColumn("__p", F.spark_partition_id()))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("__p").agg(F.count(F.lit(1)).alias("__n")).select(
        "__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))  # one row per partition
    inside = Window.partitionBy("__p").orderBy(F.col("__c").desc(), F.col(col).asc())
    idx = dealt.withColumn("__i", F.row_number().over(inside)).join(sizes, "__p").select(
        col, (F.col("__off") + F.col("__i") - 1).cast("int").alias(out))
    return df.join(broadcast_checked(idx), on=col, how="left")


def ratio(df: DataFrame, num: str, den: str, name: str | None = None) -> DataFrame:
    """``num / den`` with null for a zero or null divisor."""
    return df.withColumn(name or f"{num}_per_{den}", safe_div(num, den))


def zscore(df: DataFrame, cols, fit_on: DataFrame | None = None, suffix: str = "_z",
           fold: str | None = None, k: int | None = None) -> DataFrame:
    """``(x - mean) / sd`` with mean and sample sd fitted on ``fit_on``;
    the statistics are scalar subqueries over one aggregate.

    With ``fold``/``k`` a row of fold t is scaled by the mean and sd of the
    other folds' rows: per fold, sums of values centred on the overall mean
    (k rows, one aggregate) are combined over the other folds and joined
    back on the fold (a table of k rows).
    """
    cols = [cols] if isinstance(cols, str) else list(cols)
    fit = fit_on if fit_on is not None else df
    out = df
    if fold is None:
        for c in cols:
            mean = fit.agg(F.avg(c)).scalar()
            sd = fit.agg(F.stddev_samp(c)).scalar()
            out = out.withColumn(f"{c}{suffix}", safe_div(F.col(c) - mean, sd))
        return out
    if not k:
        raise ValueError("k is required with fold")
    # per-fold count, mean and sample variance (stable aggregates), combined
    # over the other folds in a table of k rows
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.count(known(c)).alias(f"__n{i}"), F.avg(known(c)).alias(f"__a{i}"),
                 F.var_pop(known(c)).alias(f"__v{i}")]
    per = materialize(fit.where(F.col(fold).isNotNull()).groupBy(fold).agg(*aggs))
    check_folds(per, fold, k)
    other = F.filter(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint")),
                     lambda t: t != F.col(fold))
    train = per.withColumn("__t", F.explode(other))
    sums = train.groupBy("__t").agg(
        *[F.sum(f"__n{i}").alias(f"__tn{i}") for i in range(len(cols))],
        *[safe_div(F.sum(F.col(f"__n{i}") * F.col(f"__a{i}")), F.sum(f"__n{i}").cast("double"))
          .alias(f"__m{i}") for i in range(len(cols))])
    tr = train.join(broadcast_bounded(sums, k), "__t").groupBy("__t").agg(
        *[F.first(f"__m{i}").alias(f"__m{i}") for i in range(len(cols))],
        *[F.sqrt(safe_div(F.sum(F.col(f"__n{i}") * (F.col(f"__v{i}") + F.pow(
            F.col(f"__a{i}") - F.col(f"__m{i}"), F.lit(2.0)))), (F.first(f"__tn{i}") - 1).cast("double")))
          .alias(f"__sd{i}") for i in range(len(cols))])
    sel = [F.col("__t").alias(fold), *[f"__{m}{i}" for i in range(len(cols)) for m in ("m", "sd")]]
    stats = broadcast_bounded(tr.select(*sel), k)
    out = out.join(stats, on=fold, how="left")
    for i, c in enumerate(cols):
        out = out.withColumn(f"{c}{suffix}", safe_div(F.col(c) - F.col(f"__m{i}"), F.col(f"__sd{i}")))
    return out.drop(*[f"__m{i}" for i in range(len(cols))], *[f"__sd{i}" for i in range(len(cols))])


def quantile_cuts(fit: DataFrame, col: str, n: int, exact: bool = True):
    """Scalar column: the n-1 cut points at 1/n, ..., (n-1)/n."""
    probs = [i / n for i in range(1, n)]
    if exact:
        return exact_quantiles(fit, col, probs, out="__q").select("__q").scalar()
    return fit.agg(quantile_agg(F.col(col).cast("double"), probs, exact=False)).scalar()


def qbin(df: DataFrame, col: str, n: int, fit_on: DataFrame | None = None,
         out: str | None = None, exact: bool = True) -> DataFrame:
    """Quantile bin 0..n-1: the number of cut points strictly below the value
    (a value equal to a cut point stays in the lower bin). Cut points come
    from one aggregate; each row is binned by comparisons, no sort and no
    single-partition ``ntile``."""
    fit = fit_on if fit_on is not None else df
    cuts = quantile_cuts(fit, col, n, exact)
    x = F.col(col)
    b = F.lit(0)
    for i in range(n - 1):
        b = b + (x > cuts[i]).cast("int")
    return df.withColumn(out or f"{col}_bin", F.when(x.isNotNull(), b))
