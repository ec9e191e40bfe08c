"""Which segments hold the error (D22): the worst slices of a scored table.

A slice is a set of rows that agree in some attributes (``status = F and
segment = BUILDING``). Slices form a lattice: each condition added makes a slice
smaller. It is walked level by level, one aggregate a level, and a slice is
counted only if all slices one condition shorter were large enough and if none of
them proves, by an upper bound, that it cannot reach the result. The rows are read
twice: for single conditions, and for their distinct combinations of
conditions that count, from which all further levels are summed.

The support is a share of the scored rows, so an attribute has at most
``1 / support`` slices that count and a level at most that many for each set of
attributes. Only these reach the driver or are broadcast; values of an attribute
that are rarer never leave the executors, however many there are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outfold.functions.safe import abs_err
from outfold.operators.joins import broadcast_bounded, materialize

EXACT = "decimal(38,9)"


@dataclass(frozen=True)
class Total:
    """The scored rows as a whole, and how a slice of them is judged."""

    n: int
    mae: float
    least: int
    alpha: float

    def score(self, n: float, err: float) -> float:
        """Weighs how much worse the slice is than all rows against how small it
        is; all rows together score 0."""
        return self.alpha * (err / n / self.mae - 1) - (1 - self.alpha) * (self.n / n - 1)

    def bound(self, n: int, err: float, worst: float) -> float:
        """The best score that any slice can have that lies in slices of at most
        ``n`` rows, an error sum of at most ``err`` and no error above ``worst``.

        With s rows, the error sum is at most min(err, s * worst): up to
        err / worst rows the score rises with s, from there it is a constant plus
        a multiple of 1 / s, so the best lies at an end of one of the two ranges."""
        if n < self.least:
            return -math.inf
        turn = min(max(err / worst, self.least), n) if worst > 0 else n
        return max(self.score(s, min(err, s * worst)) for s in (self.least, turn, n))


def _count(rows: DataFrame, by) -> DataFrame:
    """Sums are exact decimals, so no slice depends on the partitioning."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_err").cast(EXACT)).alias("err"),
                                 F.max("_err").alias("worst"))


def _merge(counts: DataFrame, by) -> DataFrame:
    return counts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("err").alias("err"), F.max("worst").alias("worst"))


def worst_slices(df: DataFrame, attributes, y: str = "y", pred: str = "pred", depth: int = 2,
                 support: float = 0.01, alpha: float = 0.95, top: int = 20) -> DataFrame:
    """The ``top`` slices of at most ``depth`` conditions by score, best first
    (ties: fewer conditions, then the conditions themselves):
    (rank, level, slice, n_rows, mae, score).

    ``slice`` lists its conditions as (attribute, value) in the order of
    ``attributes``; values are given as strings, a null is a value of its own. A
    slice needs ``support`` of the scored rows and an error above the average
    (score above 0). Rows without a target or prediction are left out. Numeric
    attributes are to be binned first (``features.qbin``). Without a scored row or
    without any error there is no slice."""
    names = list(attributes)
    if len(set(names)) != len(names) or not names:
        raise ValueError("attributes must be given, each once")
    if not 0 < support <= 1 or not 0 < alpha <= 1:
        raise ValueError("support and alpha lie above 0 and at most at 1")
    spark = df.sparkSession
    rows = df.select(*[F.col(f"`{a}`").cast("string").alias(f"_a{i}") for i, a in enumerate(names)],
                     abs_err(y, pred).alias("_err")).where("_err is not null")
    # one condition, all attributes in one aggregate
    single = materialize(_count(rows.select("_err", F.inline(F.array(*[
        F.struct(F.lit(i).alias("at"), F.col(f"_a{i}").alias("value")) for i in range(len(names))]))),
        ["at", "value"]))
    n, err = single.where("at = 0").agg(F.sum("n"), F.sum("err")).first()
    found: list[tuple] = []
    if n and err:
        total = Total(n, float(err) / n, max(1, math.ceil(support * n)), alpha)
        found = _walk(spark, rows, single, names, total, depth, top)
    schema = ("rank int, level int, slice array<struct<attribute: string, value: string>>, "
              "n_rows long, mae double, score double")
    return spark.createDataFrame(
        [(i + 1, len(c), list(c), m, float(e) / m, s) for i, (s, c, m, e) in enumerate(found)], schema)


def _walk(spark, rows: DataFrame, single: DataFrame, names: list[str], total: Total, depth: int,
          top: int) -> list[tuple]:
    p = len(names)
    most = math.ceil(total.n / total.least)
    level = {}  # items of a slice -> (n, err, worst); an item is a number for (attribute, value)
    items: list[tuple[int, str | None]] = []
    kept = single.where(F.col("n") >= total.least)
    for r in sorted(kept.collect(), key=lambda r: (r["at"], r["value"] is not None, r["value"] or "")):
        level[(len(items),)] = (r["n"], float(r["err"]), r["worst"])
        items.append((r["at"], r["value"]))
    # each row's item in each attribute, null where its value is too rare; rows with
    # the same items are one from here on
    numbered = rows
    for i in range(p):
        own = [(k, v) for k, (at, v) in enumerate(items) if at == i]
        table = spark.createDataFrame(own, T.StructType([
            T.StructField(f"_i{i}", T.IntegerType()), T.StructField(f"_v{i}", T.StringType())]))
        table = broadcast_bounded(table, most)
        numbered = numbered.join(table, F.col(f"_a{i}").eqNullSafe(F.col(f"_v{i}")), "left").drop(f"_v{i}", f"_a{i}")
    base = materialize(_count(numbered, [f"_i{i}" for i in range(p)])) if depth > 1 else None

    best: list[tuple] = []
    for size in range(1, depth + 1):
        for key, (n, err, _) in level.items():
            s = total.score(n, err)
            if s > 0:
                best.append((s, key, n, err))
        best.sort(key=lambda b: (-b[0], len(b[1]), b[1]))
        del best[top:]
        bar = best[-1][0] if len(best) == top else 0.0
        if size == depth:
            break
        wanted = _extend(level, items, total, bar, size + 1)
        if not wanted:
            break
        sets = sorted({tuple(items[k][0] for k in key) for key in wanted})
        schema = T.StructType([T.StructField("key", T.ArrayType(T.IntegerType()))])
        table = broadcast_bounded(spark.createDataFrame([(list(k),) for k in wanted], schema), len(wanted))
        each = base.select("n", "err", "worst", F.explode(F.array(*[
            F.array(*[F.col(f"_i{i}") for i in s]) for s in sets])).alias("key"))
        counted = _merge(each.join(table, "key"), ["key"]).where(F.col("n") >= total.least)
        level = {tuple(r["key"]): (r["n"], float(r["err"]), r["worst"]) for r in counted.collect()}
    return [(s, tuple((names[items[k][0]], items[k][1]) for k in key), n, err) for s, key, n, err in best]


def _extend(level: dict, items: list, total: Total, bar: float, size: int) -> list[tuple]:
    """Slices with one more condition, all of whose parents are in ``level`` and
    none of whose parents bounds their score below ``bar``."""
    heads: dict[tuple, list[int]] = {}
    for key in level:
        heads.setdefault(key[:-1], []).append(key[-1])
    out = []
    for head, tails in heads.items():
        for a, b in combinations(sorted(tails), 2):
            if items[a][0] == items[b][0]:
                continue
            key = (*head, a, b)
            parents = [level.get(k) for k in combinations(key, size - 1)]
            if all(parents):
                n, err, worst = (min(x) for x in zip(*parents, strict=True))
                limit = total.bound(n, err, worst)
                if limit > 0 and limit >= bar - 1e-12 * max(1.0, abs(bar)):
                    out.append(key)
    return out
