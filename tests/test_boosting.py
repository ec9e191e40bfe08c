"""Trees grown for all folds together: against a direct build, and edge cases."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from outfold.operators import boosting as bo

SCHEMA = "id long, x double, z double, y double, fold long"


def rows_of(n, k, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, z = rng.choice([None, float("nan"), *[float(v) for v in range(10)]]), float(rng.randrange(6))
        known = x is not None and not math.isnan(x)
        out.append((i, x, z, (10 * x if known else -30) + z * z + rng.random(), i % k))
    return out


def grow(rows, edges, rounds, depth, rate, least):
    """One model of one fold, row by row."""
    def bin_of(v, cuts):
        return 0 if v is None or math.isnan(v) else 1 + sum(c < v for c in cuts)

    data = [([bin_of(r[1], edges[0]), bin_of(r[2], edges[1])], r[3]) for r in rows]
    base = statistics.median(y for _, y in data)
    pred, trees = [base] * len(data), []
    for _ in range(rounds):
        splits, node = {}, [0] * len(data)
        for level in range(depth):
            for at in range(1 << level):
                mine = [i for i in range(len(data)) if node[i] == at]
                sign = {i: (data[i][1] > pred[i]) - (data[i][1] < pred[i]) for i in mine}
                best = (sum(sign.values()) ** 2 / len(mine) if mine else 0, None, None)
                for j in range(2):
                    for cut in range(len(edges[j]) + 2):
                        left = [i for i in mine if data[i][0][j] <= cut]
                        right = [i for i in mine if data[i][0][j] > cut]
                        if len(left) < least or len(right) < least:
                            continue
                        gain = (sum(sign[i] for i in left) ** 2 / len(left)
                                + sum(sign[i] for i in right) ** 2 / len(right))
                        if gain > best[0]:
                            best = (gain, j, cut)
                splits[level, at] = best[1:]
            node = [2 * n + (splits[level, n][0] is not None
                             and data[i][0][splits[level, n][0]] > splits[level, n][1]) for i, n in enumerate(node)]
        value = {n: statistics.median(data[i][1] - pred[i] for i in range(len(data)) if node[i] == n)
                 for n in set(node)}
        pred = [p + rate * value[n] for p, n in zip(pred, node)]
        trees.append((splits, value))

    def score(r):
        bins, out = [bin_of(r[1], edges[0]), bin_of(r[2], edges[1])], base
        for splits, value in trees:
            n = 0
            for level in range(depth):
                j, cut = splits[level, n]
                n = 2 * n + (j is not None and bins[j] > cut)
            out += rate * value.get(n, 0.0)
        return out
    return score


@pytest.mark.parametrize("refresh", [2, 8])
def test_grown_together_equals_one_by_one(spark, monkeypatch, refresh):
    monkeypatch.setattr(bo, "REFRESH", refresh)
    k, rows = 3, rows_of(240, 3)
    edges = [[1.0, 3.0, 5.0, 7.0], [1.0, 3.0]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r["id"]: r["pred"] for r in bo.oof_boost(
        df, xs=["x", "z"], k=k, rounds=5, depth=2, rate=0.5, least_rows=5, edges=edges, leaf="exact").collect()}
    for t in range(k):
        score = grow([r for r in rows if r[4] != t], edges, 5, 2, 0.5, 5)
        for r in rows:
            if r[4] == t:
                assert got[r[0]] == pytest.approx(score(r))


def test_nothing_of_a_row_reaches_its_prediction(spark):
    rows = rows_of(90, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    options = dict(xs=["x", "z"], k=3, rounds=2, depth=2, least_rows=3, edges=[[2.0, 5.0], [2.0]])
    a = {r["id"]: r["pred"] for r in bo.oof_boost(df, **options).collect()}
    other = df.withColumn("y", F.when(F.col("fold") == 1, F.col("y") * -7).otherwise(F.col("y")))
    b = {r["id"]: r["pred"] for r in bo.oof_boost(other, **options).collect()}
    assert all(a[r[0]] == b[r[0]] for r in rows if r[4] == 1)
    assert any(a[r[0]] != b[r[0]] for r in rows if r[4] != 1)


def test_saved_model_scores_later_rows_alike(spark, tmp_path):
    df = spark.createDataFrame(rows_of(90, 3), SCHEMA)
    m = bo.fit(df, "fold", "y", ["x", "z"], 4, rounds=3, depth=2, least_rows=3)
    m.save(spark, str(tmp_path / "model"))
    again = bo.Boosted.load(spark, str(tmp_path / "model"))
    for which in (0, 3):
        a, b = (sorted((r["id"], r["pred"]) for r in bo.predict(df, v, F.lit(which)).collect()) for v in (m, again))
        assert a == b


def test_held_out_form_uses_all_other_rows(spark):
    rows = rows_of(120, 3)
    df = spark.createDataFrame(rows, SCHEMA).drop("fold")
    got = bo.holdout_boost(df, "id", "y", ["x", "z"], parts=3, rounds=3, depth=2, rate=0.5, least_rows=5,
                           edges=[[2.0, 5.0], [2.0]], leaf="exact").collect()
    held = {r["id"] for r in got}
    score = grow([r for r in rows if r[0] not in held], [[2.0, 5.0], [2.0]], 3, 2, 0.5, 5)
    assert held and all(r["pred"] == pytest.approx(score((r["id"], r["x"], r["z"]))) for r in got)


def test_edge_cases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert bo.oof_boost(empty, xs=["x"], k=2, rounds=1, depth=1).count() == 0
    same = spark.createDataFrame([(i, None, 1.0, 4.0, i % 2) for i in range(50)], SCHEMA)
    assert {r["pred"] for r in bo.oof_boost(same, xs=["x", "z"], k=2, rounds=2, depth=2).collect()} == {4.0}
    far = spark.createDataFrame([(i, 1.0, 1.0, float("inf") if i == 3 else float(i), i % 2) for i in range(9)], SCHEMA)
    assert all(np.isfinite(r["pred"]) for r in bo.oof_boost(far, xs=["x"], k=2, rounds=1, depth=1).collect())
    with pytest.raises(ValueError):
        bo.fit(same, "fold", "y", ["x"], 2, depth=0)


@pytest.mark.parametrize("refresh", [1, 8])
def test_scans_by_level_equal_scans_by_cell(spark, monkeypatch, refresh):
    df = spark.createDataFrame(rows_of(240, 3), SCHEMA).repartition(3)
    options = dict(xs=["x", "z"], k=3, rounds=4, depth=2, rate=0.5, least_rows=5, edges=[[1.0, 5.0], [1.0, 3.0]])
    by_cell = {leaf: bo.fit(df, "fold", "y", leaf=leaf, **options) for leaf in ("exact", "mean")}
    monkeypatch.setattr(bo, "CELLS", 1)
    monkeypatch.setattr(bo, "REFRESH", refresh)
    for leaf, a in by_cell.items():
        b = bo.fit(df, "fold", "y", leaf=leaf, **options)
        for one, two in zip(a.trees, b.trees, strict=True):
            assert (one[0] == two[0]).all() and (one[1] == two[1]).all() and one[2] == pytest.approx(two[2])


def test_a_round_scans_once_for_all_levels(spark, monkeypatch):
    """It took a scan a level before, and one row each to Python."""
    seen = []
    run = type(spark.range(0)).mapInArrow
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, *a, **b: seen.append(1) or run(self, *a, **b))
    df = spark.createDataFrame(rows_of(240, 3), SCHEMA)
    bo.fit(df, "fold", "y", ["x", "z"], 3, rounds=2, depth=4, leaf="mean")
    one = len(seen)
    bo.fit(df, "fold", "y", ["x", "z"], 3, rounds=5, depth=4, leaf="mean")
    assert len(seen) - one == one + 3


@pytest.mark.parametrize("last", [0, 50, 100_000])
def test_exact_medians_of_odd_values(spark, monkeypatch, last):
    monkeypatch.setattr(bo, "LAST", last)
    rng = random.Random(5)
    odd = [0.0, -0.0, 5e-324, -5e-324, 1e300, -1e300, 0.1, 0.1 + 1e-16, 7.0, 7.0]
    groups = [[rng.choice(odd) if rng.random() < 0.3 else rng.gauss(0, 10 ** rng.randrange(-3, 9)) for _ in range(n)]
              for n in (1, 2, 7, 400, 401)] + [[], [4.0] * 300, [1.0, 1.0, 2.0, 2.0]]
    df = spark.createDataFrame([(c, v) for c, g in enumerate(groups) for v in g], "c long, r double").repartition(3)

    def scan(batches):
        for b in batches:
            yield b.column("c").to_numpy(), b.column("r").to_numpy()
    got = bo._exact_medians(df, scan, len(groups))
    assert all(np.isnan(v) if not g else v == statistics.median(g) for v, g in zip(got, groups))


def test_sketched_medians_of_long_chunks(spark):
    """Values that stand for others in the sketch, and left over ones, both count."""
    df = spark.range(40_000, numPartitions=1).selectExpr("id % 3 c", "cast(pow(id, 1.5) as double) r")

    def scan(batches):
        import pyarrow as pa
        t = pa.Table.from_batches(list(batches))
        yield t.column("c").to_numpy(), t.column("r").to_numpy()
    got = bo._sketched_medians(df, scan, 4)
    assert np.isnan(got[3]) and all(abs(v ** (2 / 3) - 20_000) < 200 for v in got[:3])


def test_gbt_boosts_as_spark_ml_does(spark):
    """With the same split candidates (ten values), the same predictions."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    from outfold.operators import models as mo
    rng = random.Random(3)
    rows = [(i, float(rng.randrange(10)), float(rng.randrange(4)), rng.gauss(0, 1), i % 3) for i in range(400)]
    rows = [(i, x, z, 10 * x + z * z + e, f) for i, x, z, e, f in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["id"]: r["pred"] for r in mo.oof_gbt(df, xs=["x", "z"], k=3, max_iter=4, max_depth=3).collect()}
    vectors = VectorAssembler(inputCols=["x", "z"], outputCol="v").transform(df)
    for t in range(3):
        ml = GBTRegressor(featuresCol="v", labelCol="y", lossType="absolute", maxIter=4, maxDepth=3, seed=7)
        for r in ml.fit(vectors.where(F.col("fold") != t)).transform(vectors.where(F.col("fold") == t)).collect():
            assert got[r["id"]] == pytest.approx(r["prediction"])


def test_gbt_takes_a_few_jobs_a_round(spark):
    """They were a number of jobs for each fold and level."""
    from outfold.operators import models as mo
    df = spark.createDataFrame(rows_of(200, 5), SCHEMA).localCheckpoint()

    def jobs(rounds):
        last = lambda: max(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
        spark.range(10).count()
        before = last()
        mo.oof_gbt(df, xs=["x", "z"], k=5, max_iter=rounds, max_depth=5)
        return last() - before
    assert jobs(7) - jobs(2) <= 15
