"""Bootstrap intervals and exact blends, against direct computation."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from outfold.operators import blending as bl
from outfold.operators import bootstrap as bs

SCHEMA = "id long, c string, y double, pred double, held boolean"


def scored(spark, n=400, shift=0.0, seed=1):
    rng = random.Random(seed)
    rows = [(i, f"c{i % 20}", rng.gauss(0, 1) + (shift if i % 4 == 0 else 0), 0.0, i % 4 == 0) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA), rows


def test_weights_are_poisson():
    rng = np.random.default_rng(1)
    unit = rng.integers(0, 1 << 32, 4000)
    w = np.zeros((50, 4000), int)
    for b in range(1, 51):
        a, c = bs._maps(b)
        draw = (a * (unit % bs.PRIME) + c) % bs.PRIME
        w[b - 1] = sum((draw >= s).astype(int) for s in bs.STEPS)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.03
    assert abs(np.mean(w == 0) - math.exp(-1)) < 0.01
    assert abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.06


def test_interval_is_near_the_normal_one(spark):
    df, rows = scored(spark)
    r = {x["measure"]: x for x in bs.gap_interval(df, "id", F.col("held"), b=300).collect()}
    a = np.array([abs(x[2]) for x in rows if not x[4]])
    assert r["mae_a"]["estimate"] == pytest.approx(a.mean())
    assert r["mae_a"]["se"] == pytest.approx(a.std() / math.sqrt(len(a)), rel=0.2)
    assert r["gap"]["low"] < 0 < r["gap"]["high"] and r["gap"]["n_replicates"] == 300  # no gap but chance
    far = {x["measure"]: x for x in bs.gap_interval(scored(spark, shift=3.0)[0], "id", F.col("held")).collect()}
    assert far["gap"]["low"] > 0


def test_clusters_widen_the_interval(spark):
    rng = random.Random(2)
    level = {f"c{i}": rng.choice([0.1, 5.0]) for i in range(20)}
    rows = [(i, f"c{i % 20}", level[f"c{i % 20}"], 0.0, False) for i in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA)
    se = {c: bs.gap_interval(df, u, clustered=c).where("measure = 'mae_a'").first()["se"]
          for c, u in ((False, "id"), (True, "c"))}
    assert se[True] > 4 * se[False]
    same = [bs.replicates(d, "c", clustered=True).orderBy("b").collect() for d in (df, df.repartition(7))]
    assert all(x["mae_a"] == pytest.approx(y["mae_a"]) for x, y in zip(*same))
    # adding up a cluster first changes nothing
    direct = bs.replicates(df, "c").orderBy("b").collect()
    assert all(x["mae_a"] == pytest.approx(y["mae_a"]) for x, y in zip(same[0], direct))


def test_interval_of_nothing_and_of_nulls(spark):
    df, _ = scored(spark, 20)
    empty = {x["measure"]: x for x in bs.gap_interval(df.limit(0), "id", F.col("held")).collect()}
    assert len(empty) == 4 and all(x["estimate"] is None and x["low"] is None for x in empty.values())
    some = df.withColumn("y", F.when(F.col("id") > 3, F.col("y"))).withColumn("id", F.lit(None).cast("long"))
    r = {x["measure"]: x for x in bs.gap_interval(some, "id").collect()}
    assert r["mae_a"]["se"] == pytest.approx(0, abs=1e-9)  # one unit: all rows or none
    assert r["gap"]["estimate"] is None


def test_gap_interval_rejects(spark):
    df, _ = scored(spark, 8)
    with pytest.raises(ValueError):
        bs.gap_interval(df, "id", level=1.0)


def brute_weight(rows):
    """The least w in 0..1 among all kinks of the error."""
    rows = [r for r in rows if all(v is not None and not math.isnan(v) for v in r)]

    def err(w):
        return sum(abs(y - (w * p + (1 - w) * q)) for y, p, q in rows)

    kinks = {0.0, 1.0} | {(y - q) / (p - q) for y, p, q in rows if p != q}
    return min((w for w in kinks if 0 <= w <= 1), key=lambda w: (round(err(w), 9), w)), err


@pytest.mark.parametrize("bins", [2, 7, 1024])
@pytest.mark.parametrize("seed", range(4))
def test_blend_weight_is_the_exact_minimum(spark, monkeypatch, bins, seed):
    rng = random.Random(seed)
    vals = [0.0, 1.0, 2.0, 2.5] if seed == 3 else None  # ties
    pick = (lambda: rng.choice(vals)) if vals else (lambda: rng.gauss(0, 1))
    rows = []
    for _ in range(60):
        p, q = pick(), pick()
        rows.append((0.3 * p + 0.7 * q + 0.2 * pick(), p, q))
    rows += [(None, 1.0, 2.0), (1.0, float("nan"), 0.0), (1.0, None, 0.0), (1.0, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "y double, p double, q double")
    monkeypatch.setattr(bl.weighted_medians, "__defaults__", (bins,))
    r = bl.blend_exact(df, "p", "q").first()
    w, err = brute_weight(rows)
    assert err(r["w"]) == pytest.approx(err(w)) and r["n_scored"] == 61
    assert r["mae"] == pytest.approx(err(w) / 61)


def test_blend_weight_at_the_ends(spark):
    rows = [(float(i), float(i) + 0.5, float(i) - 0.1 * (i + 1)) for i in range(20)]
    df = spark.createDataFrame(rows, "y double, p double, q double")
    for a, b in (("p", "q"), ("q", "p")):
        r = bl.blend_exact(df, a, b).first()
        w, err = brute_weight([(y, *((p, q) if a == "p" else (q, p))) for y, p, q in rows])
        assert err(r["w"]) == pytest.approx(err(w))
    same = bl.blend_exact(df, "y", "q").first()
    assert (same["w"], same["mae"]) == (1.0, pytest.approx(0, abs=1e-9))
    assert bl.blend_exact(df, "p", "p").first()["w"] == 0.0
    assert bl.blend_exact(df.limit(0), "p", "q").first()["mae"] is None


def test_greedy_selection_lowers_the_error(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(200):
        a, b, c = (rng.gauss(0, 1) for _ in range(3))
        rows.append((0.5 * a + 0.3 * b, a, b, c))
    df = spark.createDataFrame(rows, "y double, a double, b double, c double")
    steps = bl.greedy(df, ["c", "a", "b"], steps=6)
    maes = [m for _, _, m in steps]
    assert steps[0][0] == "a" and steps[1][0] == "b" and maes == sorted(maes, reverse=True)
    assert all(sum(w) == pytest.approx(1) and min(w) >= 0 for _, w, _ in steps)
    last = df.select(F.avg(F.abs(F.col("y") - bl.mix(["c", "a", "b"], steps[-1][1])))).first()[0]
    assert last == pytest.approx(maes[-1])
    # no single mixture with one candidate beats the step taken
    _, w, best = steps[1]
    for j, name in enumerate("cab"):
        for k in range(101):
            x = k / 100
            mae = np.mean([abs(r[0] - ((1 - x) * r[1] + x * dict(a=r[1], b=r[2], c=r[3])[name])) for r in rows])
            assert best <= mae + 1e-12
    assert bl.greedy(df.limit(0), ["a", "b"]) == []
