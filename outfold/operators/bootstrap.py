"""Intervals for scores and for their gap (D23, R4, R5) by Poisson bootstrap.

In replicate b every unit (a row, or all rows of one cluster) counts w times, w
drawn from Poisson(1) by a hash of its key and b: no sampling pass, no state,
the same draws on every run and with any partitioning. A unit's key is hashed
once; replicate b maps it by (a_b * h + c_b) mod p, a pairwise independent
family. All replicates come from one aggregate, one row a task and replicate.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outfold.functions.folds import hash32
from outfold.functions.safe import abs_err, safe_div
from outfold.operators.joins import materialize

PRIME = (1 << 31) - 1
#: Draws below the i-th of these are i or less: Poisson(1) on 0..PRIME-1.
STEPS = [math.floor(PRIME * sum(math.exp(-1) / math.factorial(j) for j in range(i + 1))) for i in range(10)]


def _maps(replicate: int) -> tuple[int, int]:
    """a_b and c_b of a replicate."""
    a, c = (int(hashlib.md5(f"{tag}:{replicate}".encode()).hexdigest()[:8], 16) for tag in "ac")
    return a % (PRIME - 1) + 1, c % PRIME


def poisson_weight(unit: Column, a: Column, c: Column) -> Column:
    """How often the unit with this 32-bit hash counts under the map (a, c)."""
    draw = (a * (unit % PRIME) + c) % PRIME
    w = F.lit(0)
    for s in STEPS:
        w = w + (draw >= s).cast("int")
    return w


def poisson_weight_sql(unit: str, replicate: str) -> str:
    """The same weight in DuckDB SQL, for oracles."""
    def h(tag: str) -> str:
        return f"CAST('0x' || substr(md5('{tag}:' || CAST({replicate} AS VARCHAR)), 1, 8) AS BIGINT)"
    draw = f"((({h('a')} % {PRIME - 1} + 1) * ({unit} % {PRIME}) + {h('c')} % {PRIME}) % {PRIME})"
    return "(" + " + ".join(f"CAST({draw} >= {s} AS INTEGER)" for s in STEPS) + ")"


def replicates(scored: DataFrame, unit, second=None, y: str = "y", pred: str = "pred", b: int = 200,
               clustered: bool = False) -> DataFrame:
    """(b, mae_a, mae_b, gap, gap_pct) for replicates 1..b; mae_b of the rows with
    the flag ``second`` (without one, null). ``unit``: the key column or columns
    that are drawn. ``clustered``: many rows share a unit; their errors are added
    up before they are drawn, so a hot unit costs one row a task.

    Rows that cannot be scored take no part. Rows with a null unit are one unit
    together. A replicate without any row of a kind has a null score."""
    flag = F.lit(False) if second is None else F.coalesce(second, F.lit(False))
    cols = [unit] if isinstance(unit, (str, Column)) else list(unit)
    cols = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols]
    rows = scored.select(hash32(cols).alias("__h"), flag.alias("__s"), abs_err(y, pred).alias("__e")).where(
        "__e is not null")
    one = F.lit(1).cast("long")
    if clustered:
        rows = rows.groupBy("__h", "__s").agg(F.sum("__e").alias("__e"), F.count(F.lit(1)).alias("__n"))
    else:
        rows = rows.withColumn("__n", one)
    maps = F.array(*[F.struct(F.lit(i).alias("b"), *[F.lit(v).cast("long").alias(n) for n, v in zip(
        ("a", "c"), _maps(i), strict=True)]) for i in range(1, int(b) + 1)])
    drawn = rows.select("*", F.inline(maps)).select("*", poisson_weight(
        F.col("__h"), F.col("a"), F.col("c")).alias("__w"))

    def mean(kind: Column) -> Column:
        return safe_div(F.sum(F.when(kind, F.col("__w") * F.col("__e"))),
                        F.sum(F.when(kind, F.col("__w") * F.col("__n"))).cast("double"))

    each = drawn.groupBy("b").agg(mean(~F.col("__s")).alias("mae_a"), mean(F.col("__s")).alias("mae_b"))
    each = each.withColumn("gap", F.col("mae_b") - F.col("mae_a"))
    return each.withColumn("gap_pct", safe_div(100.0 * F.col("gap"), F.col("mae_a")))


def gap_interval(scored: DataFrame, unit, second=None, y: str = "y", pred: str = "pred", b: int = 200,
                 level: float = 0.95, clustered: bool = False) -> DataFrame:
    """One row a measure (mae_a, mae_b, gap, gap_pct): ``estimate`` over all rows,
    ``low`` and ``high`` (percentiles of the replicates), ``se`` and ``n_replicates``;
    see ``replicates``. A gap whose interval holds 0 may be chance. An empty input
    gives null measures."""
    if not 0 < level < 1 or b < 2:
        raise ValueError("need 0 < level < 1 and b >= 2")
    flag = F.lit(False) if second is None else F.coalesce(second, F.lit(False))
    err = abs_err(y, pred)
    point = scored.agg(F.avg(F.when(~flag, err)).alias("mae_a"), F.avg(F.when(flag, err)).alias("mae_b"))
    point = point.withColumn("gap", F.col("mae_b") - F.col("mae_a"))
    point = point.withColumn("gap_pct", safe_div(100.0 * F.col("gap"), F.col("mae_a")))
    names = ["mae_a", "mae_b", "gap", "gap_pct"]

    def long(df: DataFrame, value: str) -> DataFrame:
        return df.select(F.inline(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).alias(value))
                                            for n in names])))

    # b rows a measure, a parameter
    each = long(materialize(replicates(scored, unit, second, y, pred, b, clustered)), "__v")
    tail = (1 - level) / 2
    spread = each.groupBy("measure").agg(
        F.percentile("__v", F.array(F.lit(tail), F.lit(1 - tail))).alias("__q"),
        F.stddev("__v").alias("se"), F.count("__v").alias("n_replicates"))
    return long(point, "estimate").join(spread, "measure", "left").select(
        "measure", "estimate", F.col("__q")[0].alias("low"), F.col("__q")[1].alias("high"), "se",
        F.coalesce("n_replicates", F.lit(0)).alias("n_replicates"))
