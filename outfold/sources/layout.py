"""The layout-attribute table: a checked load (flow A: R1, D1, D3, D4).

``read_layouts`` scans the header CSV with the fixed schema, turns the counts
written as ``N.0`` into integers, and ``layout_report`` evaluates the domain
rules and the per-type ranges together, one row per rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outfold.operators import checks as ch
from outfold.sources.tables import LAYOUT_SCHEMA, LAYOUT_WHOLE_COUNTS, read_table


def read_layouts(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Typed layout table; counts become int (null when not whole, or an
    error with ``strict``)."""
    df = read_table(spark, path, LAYOUT_SCHEMA, strict=strict)
    return ch.cast_exact(df, list(LAYOUT_WHOLE_COUNTS), strict=strict)


def layout_report(df: DataFrame) -> DataFrame:
    """(rule, n_rows, n_bad) for the domain rules, the key's uniqueness and
    every per-type range, all from two aggregates over the table."""
    rules = list(ch.layout_rules())
    for t, cols in ch.LAYOUT_TYPE_BOUNDS.items():
        for c, (lo, hi) in cols.items():
            rules.append((f"{c}_range_{t}", F.when(F.col("layout_type") == t,
                                                  F.col(c).between(lo, hi))))
    base = ch.check_rules(df, rules)
    dups = ch.check_unique(df, "layout_id").agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("n_bad"))
    n = df.agg(F.count(F.lit(1))).scalar()
    uniq = dups.select(F.lit("layout_id_unique").alias("rule"), n.alias("n_rows"), "n_bad")
    return base.unionByName(uniq)
