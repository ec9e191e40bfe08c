"""Table checks: exact integer casts (D1), key uniqueness (D2), domain rules
(D3), rules whose bounds depend on a category (D4) and orphan keys (D10).

Each check is one aggregate (partial on the map side) or one join; rule sets
are evaluated together in a single pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outfold.functions.safe import exact_int, is_whole
from outfold.operators.joins import broadcast_bounded

# The layout types, in the order they first appear in the
# layout-attribute table, and the per-type ranges observed there (type:
# aisle_width_avg, one_way_ratio, layout_compactness, intersection_count),
# as lo-hi pairs.
LAYOUT_TYPES = ("narrow", "grid", "hybrid", "hub_spoke")
LAYOUT_TYPE_BOUNDS = {
    "narrow": {"aisle_width_avg": (1.50, 2.50), "one_way_ratio": (0.3041, 0.7922),
               "layout_compactness": (0.7013, 0.9977), "intersection_count": (10, 35)},
    "grid": {"aisle_width_avg": (2.04, 3.99), "one_way_ratio": (0.0017, 0.2943),
             "layout_compactness": (0.5088, 0.7992), "intersection_count": (15, 60)},
    "hybrid": {"aisle_width_avg": (1.80, 3.49), "one_way_ratio": (0.1075, 0.4858),
               "layout_compactness": (0.4093, 0.6960), "intersection_count": (20, 50)},
    "hub_spoke": {"aisle_width_avg": (2.51, 4.00), "one_way_ratio": (0.0079, 0.1940),
                  "layout_compactness": (0.3057, 0.5939), "intersection_count": (5, 25)},
}


def cast_exact(df: DataFrame, cols, to: str = "int", strict: bool = False) -> DataFrame:
    """Replace each double column in ``cols`` by its integer value; a value
    that is not whole (``34.5``) becomes null, or raises when ``strict``."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    if strict:
        bad = inexact_counts(df, cols).where("n_bad > 0").collect()
        if bad:
            raise ValueError(f"not whole numbers: {[(r['column'], r['n_bad']) for r in bad]}")
    for c in cols:
        df = df.withColumn(c, exact_int(c, to))
    return df


def inexact_counts(df: DataFrame, cols, to: str = "int") -> DataFrame:
    """Per column: (column, n_rows, n_null, n_whole, n_bad, sum_int) in one pass."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    aggs, structs = [], []
    for i, c in enumerate(cols):
        aggs += [F.count(F.when(F.col(c).isNull(), 1)).alias(f"nn{i}"),
                 F.count(F.when(is_whole(c), 1)).alias(f"nw{i}"),
                 F.count(F.when(~is_whole(c), 1)).alias(f"nb{i}"),
                 F.sum(exact_int(c, to).cast("bigint")).alias(f"s{i}")]
        structs.append(F.struct(F.lit(c).alias("column"), F.col("__n").alias("n_rows"),
                                F.col(f"nn{i}").alias("n_null"), F.col(f"nw{i}").alias("n_whole"),
                                F.col(f"nb{i}").alias("n_bad"), F.col(f"s{i}").alias("sum_int")))
    wide = df.agg(F.count(F.lit(1)).alias("__n"), *aggs)
    return wide.select(F.inline(F.array(*structs)))


def check_unique(df: DataFrame, key) -> DataFrame:
    """Keys that occur more than once: (key..., n)."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


# Rule builders: each returns (name, condition); a row breaks a rule when the
# condition is false. A null condition passes, as in an SQL CHECK; use
# ``not_null`` to forbid nulls.

def not_null(c: str):
    return (f"{c}_not_null", f"{c} IS NOT NULL")


def positive(c: str):
    return (f"{c}_positive", f"{c} > 0")


def ratio(c: str):
    return (f"{c}_ratio", f"{c} BETWEEN 0 AND 1")


def between(c: str, lo, hi):
    return (f"{c}_between", f"{c} BETWEEN {lo!r} AND {hi!r}")


def allowed(c: str, values):
    vals = ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)
    return (f"{c}_allowed", f"{c} IN ({vals})")


def layout_rules():
    """The domain rules of the layout-attribute table."""
    nums = ["aisle_width_avg", "intersection_count", "one_way_ratio", "pack_station_count",
            "charger_count", "layout_compactness", "zone_dispersion", "robot_total",
            "building_age_years", "floor_area_sqm", "ceiling_height_m",
            "fire_sprinkler_count", "emergency_exit_count"]
    rules = [not_null("layout_id"), allowed("layout_type", LAYOUT_TYPES)]
    rules += [positive(c) for c in nums]
    rules += [ratio(c) for c in ("one_way_ratio", "layout_compactness", "zone_dispersion")]
    return rules


def check_rules(df: DataFrame, rules) -> DataFrame:
    """(rule, n_rows, n_bad) for every rule, all counted in one aggregate.

    ``rules`` is a list of (name, SQL condition) or (name, Column).
    """
    aggs, structs = [], []
    for i, (name, cond) in enumerate(rules):
        c: Column = F.expr(cond) if isinstance(cond, str) else cond
        aggs.append(F.count(F.when(~c, 1)).alias(f"b{i}"))
        structs.append(F.struct(F.lit(name).alias("rule"), F.col("__n").alias("n_rows"),
                                F.col(f"b{i}").alias("n_bad")))
    wide = df.agg(F.count(F.lit(1)).alias("__n"), *aggs)
    return wide.select(F.inline(F.array(*structs)))


def check_ranges_by(df: DataFrame, by: str, col: str, bounds) -> DataFrame:
    """Per category: (by, n_rows, n_bad, n_unbounded, min, max) where a row is
    bad when ``col`` is outside its category's [lo, hi].

    ``bounds`` maps category -> (lo, hi); it is a parameter, so its size is
    known and it is broadcast. Categories without bounds are counted as
    unbounded, never as bad.
    """
    spark = df.sparkSession
    src = df.schema[col].dataType
    num = T.DoubleType() if not isinstance(src, T.NumericType) else src
    schema = T.StructType([T.StructField(by, df.schema[by].dataType),
                           T.StructField("__lo", num), T.StructField("__hi", num)])
    rows = [(k, lo, hi) for k, (lo, hi) in bounds.items()]
    if isinstance(num, T.IntegralType):
        rows = [(k, int(lo), int(hi)) for k, lo, hi in rows]
    else:
        rows = [(k, float(lo), float(hi)) for k, lo, hi in rows]
    bdf = broadcast_bounded(spark.createDataFrame(rows, schema), len(rows))
    j = df.select(by, col).join(bdf, by, "left")
    out_of = (F.col(col) < F.col("__lo")) | (F.col(col) > F.col("__hi"))
    return j.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(out_of, 1)).alias("n_bad"),
        F.count(F.when(F.col("__lo").isNull(), 1)).alias("n_unbounded"),
        F.min(col).alias("min"), F.max(col).alias("max"))


def orphans(fact: DataFrame, dim: DataFrame, key, dim_key=None) -> DataFrame:
    """Fact rows whose key is absent from the dimension (a left anti join;
    null keys are orphans too)."""
    keys = [key] if isinstance(key, str) else list(key)
    dkeys = keys if dim_key is None else ([dim_key] if isinstance(dim_key, str) else list(dim_key))
    d = dim.select(*[F.col(a).alias(b) for a, b in zip(dkeys, keys)])
    return fact.join(d, on=keys, how="left_anti")


def fit_ranges(df: DataFrame, by: str, cols) -> dict:
    """Bounds for ``check_ranges_by`` learned from trusted rows: column ->
    {category: (min, max)}. One aggregate; one row per category reaches the
    driver, as the bounds are a parameter of the check."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    rows = df.where(F.col(by).isNotNull()).groupBy(by).agg(
        *[f(c).alias(f"{f.__name__}_{c}") for c in cols for f in (F.min, F.max)]).collect()
    return {c: {r[by]: (r[f"min_{c}"], r[f"max_{c}"]) for r in rows} for c in cols}
