"""Out-of-fold least absolute deviations (D17): the linear model that has the
least MAE on the other folds, with a proof of how near to the least it is.

All folds' models are fitted together over one written table. Reweighted least
squares come first: each round adds up, in one aggregate, the weighted moments of
every model (weight 1 / |residual|), k rows of O(p^2) sums. Then the fit is made
exact. Rows far from a model's plane keep the sign of their residual, so together
they are one linear term; the rows near it, a bounded number, come to the driver,
where the least point of "linear term + near rows" is found at a vertex. As
s * r <= |r| for any sign s, that least value bounds the true one from below, and
the difference is the gap reported. Rows whose sign was wrong join the near ones
in the next try, until the gap is closed or the tries are used up.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outfold.functions.safe import known
from outfold.operators.folds import check_folds
from outfold.operators.holdout import HOLD_SEED, split_holdout
from outfold.operators.joins import broadcast_bounded, materialize
from outfold.operators.models import _merge, _moments, fold_moments, linear, solve

#: Rows near the plane that a model brings to the driver, about, and at most twice as many.
NEAR = 20_000
#: Weighted rounds, and tries to make a model exact.
ROUNDS, TRIES = 12, 12
#: Steps of the residual's size, in powers of two, by which the near rows are chosen.
STEPS = 8


@dataclass
class Fit:
    """A fitted model: intercept and coefficients, MAE on its ``n`` training rows,
    and how far above the least possible MAE that is at most, relative to it."""
    coefs: list[float]
    mae: float
    n: int
    gap: float


def _line(r: np.ndarray, q: np.ndarray, c: np.ndarray, start: float) -> tuple[float, int, bool]:
    """Least point of sum c |r - t q| + (linear) along t > 0, with slope ``start`` at
    0: (t, row that is hit, whether the slope turns there). Row -1: no row ahead."""
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(q != 0, r / q, np.nan)
    ahead = np.flatnonzero(t > 0)
    if not len(ahead):
        return 0.0, -1, False
    ahead = ahead[np.argsort(t[ahead], kind="stable")]
    slope = start + np.cumsum(2 * c[ahead] * np.abs(q[ahead]))
    turn = np.flatnonzero(slope >= 0)
    i = ahead[turn[0] if len(turn) else -1]
    return float(t[i]), int(i), bool(len(turn))


def least_point(z: np.ndarray, y: np.ndarray, c: np.ndarray, g: np.ndarray, b: np.ndarray,
                max_steps: int = 10_000) -> tuple[np.ndarray, bool]:
    """The b with the least sum c |y - z b| - g b, from a first b, and whether it is
    the least (else the sum falls without end, as the rows are too few). Moves from
    vertex to vertex: a row leaves the ones met exactly if that lowers the sum, and
    the line search says which row takes its place. Ties are parted by a tiny shift of y."""
    p = z.shape[1]
    given, y = y, y + 1e-11 * np.random.default_rng(1).uniform(-1, 1, len(y))
    met: list[int] = []

    def state() -> tuple[np.ndarray, np.ndarray]:
        r = y - z @ b
        r[met] = 0.0
        return r, -(z.T @ (c * np.sign(r))) - g

    while len(met) < p:  # to a first vertex
        r, grad = state()
        free = np.linalg.svd(z[met])[2][len(met):] if met else np.eye(p)
        d = -free.T @ (free @ grad)
        if np.abs(d).max() <= 1e-12 * max(1.0, np.abs(grad).max()):
            d = free[0]
        d = d / np.linalg.norm(d)
        q = z @ d
        q[np.abs(q) < 1e-12] = 0.0
        q[met] = 0.0
        t, i, _ = _line(r, q, c, float(grad @ d))
        if i < 0:
            t, i, _ = _line(r, -q, c, float(-grad @ d))
            d = -d
        if i < 0:
            return b, False
        b = b + t * d
        met.append(i)
    for _ in range(max_steps):
        b = np.linalg.solve(z[met], y[met])
        r, grad = state()
        force = np.linalg.solve(z[met].T, grad)
        over = np.abs(force) - c[met]
        j = int(np.argmax(over))
        if over[j] <= 1e-9 * max(1.0, np.abs(grad).max()):
            return np.linalg.solve(z[met], given[met]), True
        unit = np.zeros(p)
        unit[j] = -np.sign(force[j])
        d = np.linalg.solve(z[met], unit)
        q = z @ d
        q[np.abs(q) < 1e-12 * np.abs(q).max()] = 0.0
        q[met] = 0.0
        t, i, turns = _line(r, q, c, float(-over[j]))
        if i < 0:
            return b, False
        met[j] = i
        if not turns:
            return np.linalg.solve(z[met], y[met]), False
    return b, False


class _Scale:
    """Columns with mean 0 and deviation 1, without those that others determine."""

    def __init__(self, moments: list, xs: list[str], y: str):
        p = len(xs)
        n, mean, com = _merge(moments, p + 1)
        dev = np.sqrt(np.maximum(np.diag(com) / n, 0))
        self.p, self.mean, self.dev = p, mean, np.where(dev > 0, dev, 1.0)
        corr = com / n / np.outer(self.dev, self.dev)
        self.use: list[int] = []
        for j in range(p):
            if dev[j] <= 1e-12 * max(1.0, abs(mean[j])):
                continue
            own = corr[np.ix_(self.use, self.use)]
            to = corr[self.use, j]
            if 1 - (to @ np.linalg.solve(own, to) if self.use else 0.0) > 1e-9:
                self.use.append(j)
        self.z = [F.lit(1.0)] + [(F.col(xs[j]) - F.lit(float(mean[j]))) / F.lit(float(self.dev[j]))
                                 for j in self.use]
        self.y = (F.col(y) - F.lit(float(mean[p]))) / F.lit(float(self.dev[p]))

    def scaled(self, coefs: list[float]) -> np.ndarray:
        """Intercept and the kept coefficients in the scale's units."""
        mid = coefs[0] + sum(b * m for b, m in zip(coefs[1:], self.mean, strict=False)) - self.mean[self.p]
        return np.array([mid, *(coefs[1 + j] * self.dev[j] for j in self.use)]) / self.dev[self.p]

    def plain(self, b: np.ndarray) -> list[float]:
        out = [0.0] * (self.p + 1)
        out[0] = self.mean[self.p] + self.dev[self.p] * b[0]
        for j, v in zip(self.use, b[1:], strict=True):
            out[1 + j] = v * self.dev[self.p] / self.dev[j]
            out[0] -= out[1 + j] * self.mean[j]
        return [float(v) for v in out]


def _residual(b: np.ndarray, names: list[str]) -> Column:
    fit = F.lit(float(b[0]))
    for v, c in zip(b[1:], names[1:], strict=True):
        fit = fit + F.lit(float(v)) * F.col(c)
    return F.col("v") - fit


def _per_model(rows: DataFrame, fields: dict[int, list[Column]]) -> DataFrame:
    """Each row once for every model that it trains, with that model's ``fields``."""
    each = F.array(*[F.when(F.col("f") != t, F.struct(F.lit(t).alias("t"), *cols))
                     for t, cols in fields.items()])
    return rows.select("*", F.inline(F.filter(each, lambda s: s.isNotNull())))


def _weighted(rows: DataFrame, names: list[str], b: dict[int, np.ndarray]
              ) -> tuple[dict[int, np.ndarray], dict[int, float]]:
    """One round for the models in ``b``: next coefficients, and the sum of
    absolute residuals of the ones given."""
    p = len(names)
    w = F.lit(1.0) / F.greatest(F.abs("r"), F.lit(1e-6))
    sums = [F.sum(w * F.col(names[i]) * F.col(names[j])).alias(f"s_{i}_{j}")
            for i in range(p) for j in range(i, p)]
    sums += [F.sum(w * F.col(c) * F.col("v")).alias(f"s_{i}") for i, c in enumerate(names)]
    got = _per_model(rows, {t: [_residual(v, names).alias("r")] for t, v in b.items()}).groupBy("t").agg(
        F.sum(F.abs("r")).alias("e"), *sums).collect()  # k rows
    step, err = {}, {}
    for r in got:
        lhs = np.array([[r[f"s_{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
        step[r["t"]] = np.linalg.lstsq(lhs, np.array([r[f"s_{i}"] for i in range(p)]), rcond=None)[0]
        err[r["t"]] = r["e"]
    return step, err


def _bands(rows: DataFrame, names: list[str], b: dict[int, np.ndarray], near: int) -> dict[int, float]:
    """The residual's size up to which each model has about ``near`` rows."""
    size = F.floor(F.log2(F.greatest(F.abs("r"), F.lit(1e-18))) * STEPS)
    got = _per_model(rows, {t: [_residual(v, names).alias("r")] for t, v in b.items()}).groupBy(
        "t", size.alias("s")).agg(F.count(F.lit(1)).alias("c")).collect()  # a few hundred for each model
    out = {}
    for t in b:
        total, top = 0, None
        for s, c in sorted((r["s"], r["c"]) for r in got if r["t"] == t):
            if total and total + c > near:
                break
            total, top = total + c, s
        out[t] = 0.0 if top is None else 2.0 ** ((top + 1) / STEPS)
    return out


class _Search:
    """What is known of one model on the way to its least point."""

    def __init__(self, b: np.ndarray):
        self.best, self.err, self.low = b, np.inf, 0.0
        self.tried: list[np.ndarray] = []
        self.band = 0.0
        self.crowded = False  # more rows than the driver takes stand at the plane

    def gap(self) -> float:
        return (self.err - self.low) / self.err if self.err > 0 else 0.0


def _try(rows: DataFrame, names: list[str], open_: dict[int, _Search], near: int) -> set[int]:
    """One try for the models in ``open_``; those with too many near rows are
    returned: they begin again around their best point."""
    p = len(names)
    fields = {}
    for t, s in open_.items():
        every = [_residual(b, names) for b in s.tried]
        far = F.abs(every[0]) > F.lit(s.band)
        for r in every[1:]:
            far = far & (F.signum(r) == F.signum(every[0]))
        fields[t] = [F.signum(every[0]).alias("s"), F.abs(every[-1]).alias("e"), far.alias("far")]
    spread = _per_model(rows, fields)
    far = F.when(F.col("far"), F.col("s")).otherwise(0.0)
    sums = {r["t"]: r for r in spread.groupBy("t").agg(
        F.sum("e").alias("e"), F.sum(far * F.col("v")).alias("y"),
        F.count(F.when(~F.col("far"), 1)).alias("near"),
        *[F.sum(far * F.col(c)).alias(f"g_{i}") for i, c in enumerate(names)]).collect()}  # k rows
    full, ready, many = set(), [], []
    for t, s in open_.items():
        if sums[t]["e"] < s.err:
            s.err, s.best = sums[t]["e"], s.tried[-1]
        if s.gap() <= 1e-9:
            continue
        if sums[t]["near"] <= 2 * near:
            ready.append(t)
        elif len(s.tried) > 1:
            full.add(t)
        else:
            many.append(t)
    points = spread.where(~F.col("far")).groupBy("t", "v", *names).agg(F.count(F.lit(1)).alias("c"))
    if many:  # equal rows are one point
        for r in points.where(F.col("t").isin(many)).groupBy("t").count().collect():
            if r["count"] <= 2 * near:
                ready.append(r["t"])
            else:
                open_[r["t"]].crowded = True
    if ready:
        points = points.where(F.col("t").isin(ready)).toArrow()  # at most 2 * near for each model
        model = points.column("t").to_numpy()
        z = np.stack([points.column(c).to_numpy() for c in names], axis=1)
        y, c = points.column("v").to_numpy(), points.column("c").to_numpy().astype(float)
        for t in ready:
            own = np.lexsort((y, model))
            own = own[model[own] == t]
            s, g = open_[t], np.array([sums[t][f"g_{i}"] for i in range(p)])
            b, least = least_point(z[own], y[own], c[own], g, s.best)
            if least:
                low = (c[own] * np.abs(y[own] - z[own] @ b)).sum() + sums[t]["y"] - g @ b
                s.low = max(s.low, float(low))
            s.tried.append(b)
    return full


def fit(df: DataFrame, fold: str, y: str, xs, models, k: int, near: int = NEAR, rounds: int = ROUNDS,
        tries: int = TRIES, tol: float = 1e-9) -> dict[int, Fit]:
    """A model for each t in ``models``, trained on the complete rows (a fold, no
    null or NaN in y or any x) whose fold is not t; none for a t without such rows.
    Ends when every gap is at most ``tol`` or after ``tries``; a model with more than
    twice ``near`` different rows at its plane stays as the weighted rounds left it,
    and its gap says so. A feature that is
    constant or determined by earlier ones gets the coefficient 0."""
    xs = list(xs)
    rows = df.select(F.col(fold).cast("bigint").alias("f"), known(y).alias("y"),
                     *[known(c).alias(f"x{i}") for i, c in enumerate(xs)])
    xs = [f"x{i}" for i in range(len(xs))]
    rows = materialize(rows.dropna())
    moments = materialize(fold_moments(rows, "f", "y", xs))
    check_folds(moments, "f", k)
    moments = moments.collect()  # k rows
    first = {t: solve([r for r in moments if r["f"] != t], len(xs)) for t in models}
    first = {t: b for t, b in first.items() if b is not None}
    if not first:
        return {}
    scale = _Scale([_moments(r, len(xs) + 1) for r in moments], xs, "y")
    names = [f"z{i}" for i in range(len(scale.z))]
    rows = rows.select("f", scale.y.alias("v"), *[c.alias(n) for c, n in zip(scale.z, names, strict=True)])

    search = {t: _Search(scale.scaled(b)) for t, b in first.items()}
    at, last = {t: s.best for t, s in search.items()}, {}
    for _ in range(rounds):
        step, err = _weighted(rows, names, at)
        for t, e in err.items():
            if e < search[t].err:
                search[t].err, search[t].best = e, at[t]
        at = {t: step[t] for t in at if not last.get(t, np.inf) - err[t] <= 1e-5 * err[t]}
        last = err
        if not at:
            break

    again = set(search)  # models whose near rows are chosen anew
    for _ in range(tries):
        if again:
            for t, h in _bands(rows, names, {t: search[t].best for t in again}, near).items():
                search[t].band, search[t].tried = h, [search[t].best]
        open_ = {t: s for t, s in search.items() if s.gap() > tol and not s.crowded}
        if not open_:
            break
        again = _try(rows, names, open_, near)
    size = {t: sum(r["n"] for r in moments if r["f"] != t) for t in search}
    unit = float(scale.dev[scale.p])
    return {t: Fit(scale.plain(s.best), s.err * unit / size[t], size[t], s.gap()) for t, s in search.items()}


def oof_lad(df: DataFrame, fold: str = "fold", y: str = "y", xs=("x",), k: int = 5,
            out: str = "pred", **how) -> DataFrame:
    """Out-of-fold least absolute deviations: each row is predicted by the model
    with the least MAE on the other folds. Rows with a null or NaN feature, without
    a fold, or without any training row get a null pred; a fold outside 0..k-1
    raises ValueError. ``how``: see ``fit``."""
    return predict(df, fit(df, fold, y, xs, range(k), k, **how), fold, xs, k, out)


def predict(df: DataFrame, fits: dict[int, Fit], fold: str, xs, k: int, out: str = "pred") -> DataFrame:
    """Every row with the prediction of its fold's model."""
    table = broadcast_bounded(df.sparkSession.createDataFrame(
        [(t, f.coefs) for t, f in fits.items()], T.StructType([
            T.StructField(fold, T.LongType()), T.StructField("__b", T.ArrayType(T.DoubleType()))])), k)
    pred = F.col("__b")[0]
    for i, c in enumerate(xs):
        pred = pred + F.col("__b")[i + 1] * known(c)
    return df.join(table, on=fold, how="left").withColumn(out, pred).drop("__b")


def holdout_lad(df: DataFrame, key, y: str, xs, parts: int = 10, seed: str = HOLD_SEED,
                out: str = "pred", **how) -> DataFrame:
    """The held-out part with the model of the other parts: the held-out form of ``oof_lad``."""
    flagged = split_holdout(df, key, parts, seed, "__hold")
    fits = fit(flagged.withColumn("__f", F.when(F.col("__hold"), 0).otherwise(1)), "__f", y, xs, [0], 2, **how)
    return flagged.where("__hold").drop("__hold").withColumn(
        out, linear(fits[0].coefs if 0 in fits else None, list(xs)))
