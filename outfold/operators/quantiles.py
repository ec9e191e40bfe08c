"""Quantiles with the semantics of SQL ``percentile`` / ``quantile_cont``
(linear interpolation between order statistics).

``exact_quantiles`` finds order statistics by brackets from sketches instead of
collecting a group's values into one buffer. Each wanted rank (a *state*) looks
in one open interval of values, at first all of them. A pass merges bounded KLL
sketches of that interval, takes two cut points a little below and above the
rank, and counts the rows below, at, between and above the cut points in one
map-side-combined aggregate. Either the rank falls on a cut point, which is its
value, or on an open interval that leaves both cut points out, so every pass
makes progress whatever the spread of the values: ties, outliers and infinities
are values like any others. Intervals of at most ``work`` rows are ranked row by
row. The algorithm is the same for groups of any size; ``work`` only bounds what
one task ranks.

With ``fold``/``k`` the groups are training sets: the quantile for target fold t
is over the rows of the other folds. Counts and sketches are kept per fold, the
training count is the sum over the other folds, and no row is replicated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outfold.operators.joins import join_hot, materialize

#: Cut points are taken among GRID + 1 evenly ranked quantiles of an interval, at
#: least BRACKET of its rows below and above the wanted rank; BRACKET is several
#: times the sketch's rank error at SKETCH_K.
GRID = 200
BRACKET = 0.01
SKETCH_K = 2000


def quantile_agg(x: Column, probs, exact: bool = True, accuracy: int = 10000) -> Column:
    """Aggregate expression returning an array of quantiles of ``x``.

    ``exact``: Spark's ``percentile``, whose buffer is a map of distinct value
    to count; fine for groups known to be small. ``exact=False``:
    ``percentile_approx``, a bounded sketch with rank error ``1/accuracy``.
    For exact quantiles of large or skewed groups use ``exact_quantiles``.
    """
    probs = [float(p) for p in probs]
    if exact:
        return F.percentile(x, F.array(*[F.lit(p) for p in probs]))
    return F.percentile_approx(x, F.array(*[F.lit(p) for p in probs]), accuracy).cast("array<double>")


def _cell(x: Column, cuts: Column) -> Column:
    """Place of ``x`` among sorted cut points: 2i+1 at cut i, even between."""
    return 2 * F.size(F.filter(cuts, lambda c: c < x)) + F.array_contains(cuts, x).cast("int")


def _pos(value: Column, cuts: Column, missing: Column) -> Column:
    return F.when(value.isNull(), missing).otherwise(
        2 * F.array_position(cuts, value).cast("int") - 1)


def exact_quantiles(df: DataFrame, x: str, probs, by=(), fold: str | None = None,
                    k: int | None = None, work: int = 200_000, out: str = "q") -> DataFrame:
    """Exact quantiles of ``x`` per ``by`` group (per (by, target fold) with
    ``fold``/``k``): one row per non-empty group with ``out`` an array of
    doubles in the order of ``probs``. Nulls and NaN are ignored; rows without
    a fold train nothing; a null group is a group of its own.

    In fold mode the result has a column named ``fold`` holding the target
    fold t; its quantiles are over the group's rows with fold != t. A fold
    outside 0..k-1 raises ValueError.
    """
    by = [by] if isinstance(by, str) else list(by)
    probs = [float(p) for p in probs]
    folded = fold is not None
    if folded and not k:
        raise ValueError("k is required with fold")
    targets = k if folded else 1
    # A struct as the key matches null to null in joins.
    # Without ``by`` it is 0, but no literal: joins on a literal become nested loops.
    group = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.pmod(F.hash(x), F.lit(1)).alias("__one"))
    own = F.col(fold).cast("bigint") if folded else F.lit(-1).cast("bigint")
    rows = df.select(group.alias("__g"), own.alias("__f"),
                     (F.col(x).cast("double") + F.lit(0.0)).alias("__x")
                     ).where("__x is not null and not isnan(__x) and __f is not null")

    sketch = F.kll_sketch_agg_double("__x", F.lit(SKETCH_K)).alias("__sk")
    cells = materialize(rows.groupBy("__g", "__f").agg(F.lit(0).alias("__i"), F.count(F.lit(1)).alias("__c")))
    low, high, total, largest = cells.groupBy("__g").agg(
        F.min("__f").alias("a"), F.max("__f").alias("z"), F.sum("__c").alias("n")).agg(
        F.min("a"), F.max("z"), F.sum("n"), F.max("n")).first()
    if folded and low is not None and (low < 0 or high >= k):
        raise ValueError(f"folds {low}..{high} are not in 0..{k - 1}")
    heavy = max(1, total or 0)
    # Without a group above ``work`` no interval is cut, and no pass is needed.
    cutting = (largest or 0) > work
    keep = materialize if cutting else (lambda df: df)
    if cutting:
        cells = materialize(rows.groupBy("__g", "__f").agg(
            F.lit(0).alias("__i"), F.count(F.lit(1)).alias("__c"), sketch))

    sizes = cells.withColumn("__t", F.explode(F.sequence(F.lit(0), F.lit(targets - 1)))).where(
        "__f <> __t").groupBy("__g", "__t").agg(F.sum("__c").alias("__n"))
    spec = keep(sizes.select("__g", "__t", "__n", F.posexplode(F.array(
        *[F.lit(p) * (F.col("__n") - 1) for p in probs])).alias("__q", "__at")).select(
        "__g", "__t", "__n", "__q", "__at", F.floor("__at").cast("bigint").alias("__rlo"),
        F.ceil("__at").cast("bigint").alias("__rhi")))
    none = F.lit(None).cast("double")
    # __rel: the rank inside the interval (__lo, __hi), of __in rows.
    states = keep(spec.select(
        "__g", "__t", "__n", F.explode(F.array("__rlo", "__rhi")).alias("__r")).distinct().select(
        "__g", "__t", "__r", F.col("__r").alias("__rel"), F.col("__n").alias("__in"),
        F.lit(0).alias("__i"), none.alias("__lo"), none.alias("__hi"), none.alias("__v")))

    # The states of one interval differ in their training rows; they go on together.
    peak = F.max("__in").over(Window.partitionBy("__g", "__lo", "__hi"))
    while cutting:
        seeking = states.where("__v is null").withColumn("__peak", peak)
        wide = seeking.where(F.col("__peak") > work).drop("__peak")
        if wide.isEmpty():
            break
        share = F.col("__rel") / F.greatest(F.col("__in") - 1, F.lit(1))
        merged = wide.join(cells.drop("__c"), ["__g", "__i"]).where("__f <> __t").groupBy(
            "__g", "__t", "__r").agg(F.kll_merge_agg_double("__sk").alias("__sk"))
        grid = F.kll_sketch_get_quantile_double("__sk", F.array(
            *[F.lit(i / GRID) for i in range(GRID + 1)]))
        lower = F.greatest(F.floor((share - BRACKET) * GRID), F.lit(0)).cast("int")
        upper = F.least(F.ceil((share + BRACKET) * GRID), F.lit(GRID)).cast("int")
        wide = materialize(wide.join(merged, ["__g", "__t", "__r"]).withColumn("__grid", grid)
                           .withColumn("__ab", F.array(F.get("__grid", lower), F.get("__grid", upper)))
                           .drop("__sk", "__grid"))
        cuts = materialize(wide.groupBy("__g").agg(F.array_sort(F.array_distinct(F.flatten(
            F.collect_list(F.filter(F.concat("__ab", F.array("__lo", "__hi")),
                                    lambda v: v.isNotNull()))))).alias("__cuts"),
            F.max("__in").alias("__size")))
        placed = join_hot(rows, cuts, "__g", "__size", heavy)
        cells = materialize(placed.withColumn("__i", _cell(F.col("__x"), F.col("__cuts")))
                            .groupBy("__g", "__f", "__i").agg(F.count(F.lit(1)).alias("__c"), sketch))
        inside = (F.col("__i") > _pos(F.col("__lo"), F.col("__cuts"), F.lit(-1))) & \
            (F.col("__i") < _pos(F.col("__hi"), F.col("__cuts"), 2 * F.size("__cuts") + 1))
        key = ["__g", "__t", "__r"]
        counts = (wide.drop("__i", "__ab").join(cuts.drop("__size"), "__g").join(cells.drop("__sk"), "__g")
                  .where("__f <> __t").where(inside)
                  .groupBy(*key, "__i").agg(
                      F.sum("__c").alias("__in"),
                      *[F.first(c).alias(c) for c in ("__rel", "__lo", "__hi", "__cuts")]))
        # a few cells of one state, not rows
        before = Window.partitionBy(*key).orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)
        half = F.expr("__i div 2")
        odd = F.col("__i") % 2 == 1
        found = (counts.withColumn("__b", F.coalesce(F.sum("__in").over(before), F.lit(0)))
                 .where("__b <= __rel and __rel < __b + __in")
                 .select(*key, (F.col("__rel") - F.col("__b")).alias("__rel"), "__in", "__i",
                         F.when(~odd, F.get("__cuts", half - 1)).alias("__lo"),
                         F.when(~odd, F.get("__cuts", half)).alias("__hi"),
                         F.when(odd, F.get("__cuts", half)).alias("__v")))
        states = materialize(states.where("__v is not null")
                             .unionByName(seeking.where(F.col("__peak") <= work).drop("__peak"))
                             .unionByName(found))

    left = states.where("__v is null")
    if cutting:
        # The open intervals of a group are equal or apart, so all their ends
        # together cut the rows into just these intervals.
        cuts = left.groupBy("__g").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(
            F.filter(F.array("__lo", "__hi"), lambda v: v.isNotNull()))))).alias("__cuts"),
            F.max("__in").alias("__size"))
        left = left.join(cuts.drop("__size"), "__g").withColumn(
            "__i", _pos(F.col("__lo"), F.col("__cuts"), F.lit(-1)) + 1)
        cuts = materialize(cuts.join(left.groupBy("__g").agg(F.collect_set("__i").alias("__is")), "__g"))
        inner = join_hot(rows, cuts, "__g", "__size", heavy).withColumn(
            "__i", _cell(F.col("__x"), F.col("__cuts"))).where(F.array_contains("__is", F.col("__i")))
    else:
        inner = rows.withColumn("__i", F.lit(0))  # one open interval a group
    wanted = left.groupBy("__g", "__i").agg(F.collect_list(F.struct("__t", "__r", "__rel")).alias("__want"))
    per_fold = [F.count(F.when(F.col("__f") == i, 1)).alias(f"__c{i}") for i in range(k)] if folded else []
    values = inner.groupBy("__g", "__i", "__x").agg(F.count(F.lit(1)).alias("__c"), *per_fold)
    # one interval of about ``work`` rows at most
    upto = Window.partitionBy("__g", "__i").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    names = ["__c", *[f"__c{i}" for i in range(k if folded else 0)]]
    values = values.select("__g", "__i", "__x", *names,
                           *[F.sum(c).over(upto).alias(f"{c}_end") for c in names])

    def of_target(suffix: str, t: Column) -> Column:
        every = F.col(f"__c{suffix}")
        if not folded:
            return every
        return every - F.element_at(F.array(*[F.col(f"__c{i}{suffix}") for i in range(k)]), t + 1)

    def holds(s: Column) -> Column:
        end = of_target("_end", s["__t"])
        return (s["__rel"] < end) & (s["__rel"] >= end - of_target("", s["__t"]))

    ranked = values.join(wanted, ["__g", "__i"]).select(
        "__g", "__x", F.inline(F.filter("__want", holds))).select(
        "__g", "__t", "__r", F.col("__x").alias("__v"))
    vals = states.where("__v is not null").select("__g", "__t", "__r", "__v").unionByName(ranked)
    vals = vals.groupBy("__g", "__t").agg(
        F.map_from_entries(F.collect_list(F.struct("__r", "__v"))).alias("__m"))  # two a quantile
    q = spec.join(vals, ["__g", "__t"]).withColumn("__vlo", F.element_at("__m", F.col("__rlo"))).withColumn(
        "__vhi", F.element_at("__m", F.col("__rhi"))).drop("__m")
    # Interpolate as Spark's percentile does; equal ends stay as they are (also infinite ones).
    value = F.when(F.col("__vlo") == F.col("__vhi"), F.col("__vlo")).otherwise(
        (F.col("__rhi") - F.col("__at")) * F.col("__vlo")
        + (F.col("__at") - F.col("__rlo")) * F.col("__vhi"))
    res = q.groupBy("__g", "__t").agg(F.array_sort(F.collect_list(
        F.struct("__q", value.alias("v")))).alias("__qs"))
    target = [F.col("__t").cast("bigint").alias(fold)] if folded else []
    return res.select(*[F.col("__g")[c].alias(c) for c in by], *target,
                      F.transform("__qs", lambda s: s["v"]).alias(out))
