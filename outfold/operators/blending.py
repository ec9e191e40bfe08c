"""Blends with the weight that minimises the absolute error exactly (D24).

sum |y - ((1 - w) c + w p)| is convex and piecewise linear in w; its least w is
the weighted median of (y - c) / (p - c) with weights |p - c|, held in 0..1. The
median is found by a distributed search: a pass adds up weights in equal bins of
an interval, the next goes on in the bin that holds half of the weight, from the
smallest to the largest value in it, until that is one value. No row is moved;
bins x searches rows reach the driver.

``greedy`` builds a blend of many predictions: each step searches the best weight
of every candidate at once and takes the one that lowers the error most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outfold.functions.safe import col_, known, safe_div

BINS = 1024


def weighted_medians(points: DataFrame, count: int, bins: int = BINS) -> list[float | None]:
    """For each j < ``count`` the weighted median of ``r`` held in 0..1: the
    smallest r so that rows up to it hold half of the weight ``d``. ``points``:
    (j, r, d), d > 0; None for a j without rows."""
    inside = (F.col("r") > 0) & (F.col("r") < 1)
    ends = {r["j"]: r for r in points.groupBy("j").agg(
        F.sum("d").alias("all"), F.sum(F.when(F.col("r") <= 0, F.col("d"))).alias("low"),
        F.sum(F.when(F.col("r") >= 1, F.col("d"))).alias("high")).collect()}
    out: list[float | None] = [None] * count
    seek = {}  # j -> (half, weight before the interval, smallest, largest)
    for j, e in ends.items():
        half, low, high = e["all"] / 2, e["low"] or 0.0, e["high"] or 0.0
        if low >= half:
            out[j] = 0.0
        elif e["all"] - high < half:
            out[j] = 1.0
        else:
            seek[j] = (half, low, 0.0, 1.0)
    while seek:
        def of(i: int) -> Column:
            cases = F.lit(None).cast("double")
            for j, s in seek.items():
                cases = F.when(F.col("j") == j, F.lit(s[i])).otherwise(cases)
            return cases

        lo, hi = of(2), of(3)
        cell = F.least(F.lit(bins - 1), F.floor((F.col("r") - lo) / (hi - lo) * bins)).cast("int")
        cells = points.where(inside & (F.col("r") >= lo) & (F.col("r") <= hi)).groupBy(
            "j", cell.alias("b")).agg(F.sum("d").alias("d"), F.min("r").alias("a"), F.max("r").alias("z"))
        found: dict[int, list] = {}
        for r in cells.collect():
            found.setdefault(r["j"], []).append(r)
        for j, rows in found.items():
            half, before = seek[j][:2]
            rows.sort(key=lambda r: r["b"])
            for r in rows:
                if before + r["d"] >= half or r is rows[-1]:
                    break
                before += r["d"]
            if r["a"] == r["z"]:
                out[j] = r["a"]
                del seek[j]
            else:
                seek[j] = (half, before, r["a"], r["z"])
        for j in set(seek) - set(found):  # half of the weight lies at 1 and beyond
            out[j] = 1.0
            del seek[j]
    return out


def _weights(df: DataFrame, current: Column, candidates, y: Column, use: Column) -> list[float]:
    """The best weight of each candidate beside ``current``; 0 where they are equal."""
    each = []
    for j, p in enumerate(candidates):
        d = p - current
        each.append(F.struct(F.lit(j).alias("j"), safe_div(y - current, d).alias("r"), F.abs(d).alias("d")))
    points = df.where(use).select(F.inline(F.array(*each))).where("d > 0 and not isnan(r)")
    return [0.0 if w is None else w for w in weighted_medians(points, len(each))]


def _usable(y: str, preds) -> Column:
    use = known(y).isNotNull()
    for p in preds:
        use = use & known(p).isNotNull()
    return use


def blend_exact(df: DataFrame, p1: str, p2: str, y: str = "y") -> DataFrame:
    """One row: the ``w`` in 0..1 with the least MAE of ``w*p1 + (1-w)*p2`` (the
    smallest such), that ``mae`` and ``n_scored``. Rows where y or a prediction
    is null or NaN are not scored; without a scored row w is 0 and mae null."""
    use = _usable(y, [p1, p2])
    w = _weights(df, known(p2), [known(p1)], known(y), use)[0]
    err = F.abs(known(y) - (F.lit(w) * known(p1) + F.lit(1.0 - w) * known(p2)))
    return df.agg(F.avg(F.when(use, err)).alias("mae"), F.count(F.when(use, 1)).alias("n_scored")).select(
        F.lit(w).alias("w"), "mae", "n_scored")


def mix(preds, weights) -> Column:
    """The blend as a column; null where a prediction with a weight is."""
    out = F.lit(0.0)
    for p, w in zip(preds, weights, strict=True):
        if w:
            out = out + F.lit(float(w)) * col_(p)
    return out


def greedy(df: DataFrame, preds, y: str = "y", steps: int = 10, least_gain: float = 0.0
           ) -> list[tuple[str, list[float], float]]:
    """Forward selection: (prediction added, weights of all predictions, MAE) after
    each step. The first step takes the best single prediction; each later one
    mixes in the prediction, at its exact best weight, that lowers the MAE most
    (ties to the first). It ends after ``steps`` or when the MAE falls by no more
    than ``least_gain``. The weights sum to 1; ``mix`` applies them to any rows,
    such as held-out ones. No scored row: no step."""
    preds = list(preds)
    use, target = _usable(y, preds), known(y)

    def scores(mixed: list[Column]) -> list[float | None]:
        return list(df.where(use).agg(*[F.avg(F.abs(target - m)) for m in mixed]).first())

    first = scores([known(p) for p in preds])
    if first[0] is None:
        return []
    at = min(range(len(preds)), key=lambda j: (first[j], j))
    weights = [float(j == at) for j in range(len(preds))]
    out = [(preds[at], weights, first[at])]
    while len(out) < steps:
        current = mix([known(p) for p in preds], weights)
        best = _weights(df, current, [known(p) for p in preds], target, use)
        tried = [[(1 - w) * v + w * (i == j) for i, v in enumerate(weights)] for j, w in enumerate(best)]
        maes = scores([mix([known(p) for p in preds], t) for t in tried])
        at = min(range(len(preds)), key=lambda j: (maes[j], j))
        if not maes[at] < out[-1][2] - least_gain:
            break
        weights = tried[at]
        out.append((preds[at], weights, maes[at]))
    return out
