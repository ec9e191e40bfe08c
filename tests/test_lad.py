"""Least absolute deviations: against every line through two rows, and edge cases."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from outfold.operators import lad

SCHEMA = "id long, x double, z double, y double, fold long"


def rows_of(n, k, seed, ties=False):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, z = rng.gauss(0, 3), rng.gauss(5, 1)
        if ties:
            x, z = float(round(x)), float(round(z))
        y = 4 * x - 2 * z + rng.choice([-1, 1]) * rng.expovariate(0.3)
        out.append((i, x, z, float(round(y)) if ties else y, i % k))
    return out


def least_mae(points):
    """The least MAE over all planes through as many rows as there are coefficients."""
    a = np.array([[1.0, *r[:-1]] for r in points])
    y = np.array([r[-1] for r in points])
    best = np.inf
    for pick in itertools.combinations(range(len(points)), a.shape[1]):
        m = a[list(pick)]
        if abs(np.linalg.det(m)) > 1e-9:
            best = min(best, np.abs(y - a @ np.linalg.solve(m, y[list(pick)])).mean())
    return best


@pytest.mark.parametrize("near", [6, 1000])
@pytest.mark.parametrize("ties", [False, True])
def test_least_of_all_planes(spark, near, ties):
    data = rows_of(45, 3, 11, ties)
    df = spark.createDataFrame(data, SCHEMA)
    fits = lad.fit(df, "fold", "y", ["x", "z"], range(3), 3, near=near, tries=30)
    for t, f in fits.items():
        train = [(r[1], r[2], r[3]) for r in data if r[4] != t]
        assert f.n == len(train)
        err = [abs(y - f.coefs[0] - f.coefs[1] * x - f.coefs[2] * z) for x, z, y in train]
        assert f.mae == pytest.approx(np.mean(err), rel=1e-9)
        least = least_mae(train)
        assert f.mae >= least * (1 - 1e-9)
        assert f.mae * (1 - f.gap) <= least * (1 + 1e-9)  # the bound is one
        if near == 1000:
            assert f.gap <= 1e-9 and f.mae == pytest.approx(least, rel=1e-8)


def test_many_rows_with_few_near_ones(spark):
    data = rows_of(20_000, 4, 5)
    df = spark.createDataFrame(data, SCHEMA).repartition(6)
    fits = lad.fit(df, "fold", "y", ["x", "z"], range(4), 4, near=500)
    whole = lad.fit(df, "fold", "y", ["x", "z"], range(4), 4, near=100_000)
    for t in range(4):
        assert fits[t].gap <= 1e-9
        assert fits[t].mae == pytest.approx(whole[t].mae, rel=1e-8)
        assert fits[t].coefs == pytest.approx(whole[t].coefs, abs=1e-6)


def test_outliers_do_not_move_the_fit(spark):
    data = [(i, float(i), 0.0, 2.0 * i + 1 if i % 5 else 1e7, i % 2) for i in range(200)]
    r = lad.oof_lad(spark.createDataFrame(data, SCHEMA), xs=["x"], k=2)
    for row in r.collect():
        assert row["pred"] == pytest.approx(2.0 * row["x"] + 1, abs=1e-6)


def test_constant_and_dependent_features(spark):
    data = [(i, float(i % 17), 0.0, 3.0 * (i % 17) + (i % 3), i % 2) for i in range(300)]
    df = spark.createDataFrame(data, SCHEMA).withColumn("twice", 2 * F.col("x"))
    fits = lad.fit(df, "fold", "y", ["x", "z", "twice"], range(2), 2)
    for f in fits.values():
        assert f.gap <= 1e-9 and f.coefs[2] == f.coefs[3] == 0.0


def test_awkward_rows(spark):
    nan = float("nan")
    data = [(0, 1.0, 0.0, 2.0, 0), (1, 2.0, 0.0, 4.0, 1), (2, 3.0, 0.0, 6.0, 0), (3, 4.0, 0.0, 8.0, 1),
            (4, None, 0.0, 9.0, 0), (5, nan, 0.0, 9.0, 1), (6, 5.0, 0.0, None, 0), (7, 6.0, 0.0, nan, 1),
            (8, 7.0, 0.0, 1e9, None)]
    got = {r["id"]: r["pred"] for r in lad.oof_lad(spark.createDataFrame(data, SCHEMA), k=2).collect()}
    assert len(got) == 9 and got[4] is None and got[5] is None and got[8] is None
    for i, want in [(0, 2), (1, 4), (2, 6), (3, 8), (6, 10), (7, 12)]:
        assert got[i] == pytest.approx(want, abs=1e-6)


def test_no_rows_one_fold_and_wrong_folds(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert lad.fit(empty, "fold", "y", ["x"], range(3), 3) == {}
    assert lad.oof_lad(empty, k=3).count() == 0
    one = spark.createDataFrame([(0, 1.0, 0.0, 2.0, 0), (1, 2.0, 0.0, 3.0, 0)], SCHEMA)
    assert [r["pred"] for r in lad.oof_lad(one, k=1).collect()] == [None, None]
    with pytest.raises(ValueError):
        lad.oof_lad(spark.createDataFrame([(0, 1.0, 0.0, 2.0, 5)], SCHEMA), k=3)


def test_equal_targets_and_a_crowded_plane(spark):
    flat = spark.createDataFrame([(i, float(i), 0.0, 7.0, i % 2) for i in range(50)], SCHEMA)
    assert {round(r["pred"], 9) for r in lad.oof_lad(flat, k=2).collect()} == {7.0}
    # every row stands exactly as far from the plane: more of them than may be taken
    split = spark.createDataFrame(
        [(i, float(i // 4), 0.0, float(i // 4) + (1 if i // 2 % 2 else -1), i % 2) for i in range(4000)], SCHEMA)
    for f in lad.fit(split, "fold", "y", ["x"], range(2), 2, near=20).values():
        assert f.mae == pytest.approx(1.0, rel=1e-3) and 0 <= f.gap <= 1


def test_held_out_form(spark):
    data = rows_of(2000, 2, 9)
    df = spark.createDataFrame(data, SCHEMA)
    r = lad.holdout_lad(df, "id", "y", ["x", "z"])
    held = {x["id"]: x["pred"] for x in r.collect()}
    assert 100 < len(held) < 320
    f = lad.fit(df.withColumn("f", F.when(F.col("id").isin(list(held)), 0).otherwise(1)), "f", "y",
                ["x", "z"], [0], 2)[0]
    for i, x, z, _, _ in data:
        if i in held:
            assert held[i] == pytest.approx(f.coefs[0] + f.coefs[1] * x + f.coefs[2] * z, abs=1e-9)
