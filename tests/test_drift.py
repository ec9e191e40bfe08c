"""Two-sample distances against direct sums."""

import math
import random

import pytest

from outfold.operators.drift import drift

SCHEMA = "part boolean, x double, z long"


def direct(a, b):
    values = sorted(set(a) | set(b))
    gap = [abs(sum(v <= w for v in a) / len(a) - sum(v <= w for v in b) / len(b)) for w in values]
    area = sum(g * (w - v) for g, v, w in zip(gap, values, values[1:], strict=False))
    return max(gap), area


@pytest.mark.parametrize("partitions", [1, 7])
def test_against_direct_sums(spark, partitions):
    rng = random.Random(3)
    rows = [(rng.random() < 0.3, rng.choice([None, float("nan"), 4.0, 4.0, rng.gauss(0, 2)]), rng.randrange(9))
            for _ in range(600)] + [(None, 1.0, 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r["column"]: r for r in drift(df, "part", ["x", "z"], partitions).collect()}
    for i, c in ((1, "x"), (2, "z")):
        side = {p: [float(r[i]) for r in rows if r[0] is p and r[i] is not None and not math.isnan(r[i])]
                for p in (True, False)}
        ks, area = direct(side[True], side[False])
        r = got[c]
        assert (r["n_in"], r["n_out"]) == (len(side[True]), len(side[False]))
        assert r["ks"] == pytest.approx(ks, abs=1e-12) and r["wasserstein"] == pytest.approx(area, abs=1e-9)
        at = [sum(v <= r["ks_at"] for v in side[p]) / len(side[p]) for p in (True, False)]
        assert abs(at[0] - at[1]) == pytest.approx(ks, abs=1e-12)


def test_shift_equal_parts_and_empty_sides(spark):
    rows = [(p, float(i + 5 * p), 7) for i in range(100) for p in (True, False)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["column"]: r for r in drift(df, "part", ["x", "z"]).collect()}
    assert got["x"]["wasserstein"] == pytest.approx(5) and got["x"]["ks"] == pytest.approx(0.05)
    assert got["z"]["ks"] == 0 and got["z"]["wasserstein"] == 0
    one = drift(df.where("part"), "part", ["x"]).collect()[0]
    assert (one["n_in"], one["n_out"], one["ks"], one["ks_at"], one["wasserstein"]) == (100, 0, None, None, None)
    assert drift(df.limit(0), "part", ["x"]).count() == 0
