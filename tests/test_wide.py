"""Block moments against numpy, and least squares over many features."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from outfold.operators import gram, models
from outfold.operators import profile as pr


def frame(spark, n, p, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) + 1e6 * (np.arange(p) % 3 == 0)
    fold = rng.integers(0, 3, n)
    df = spark.createDataFrame([(int(f), *map(float, r)) for f, r in zip(fold, x, strict=True)],
                               "fold long, " + ", ".join(f"x{i} double" for i in range(p)))
    return df, x, fold


@pytest.mark.parametrize("partitions,fan_in,block", [(1, 64, 128), (9, 2, 3), (7, 3, 5)])
def test_moments(spark, partitions, fan_in, block):
    df, x, fold = frame(spark, 300, 11)
    got = gram.wide_moments(df.repartition(partitions), [f"x{i}" for i in range(11)], "fold", block, fan_in)
    assert sorted(got) == [0, 1, 2]
    for f, (n, mean, cov) in got.items():
        own = x[fold == f]
        assert n == len(own) and np.allclose(mean, own.mean(axis=0), rtol=1e-12)
        assert np.allclose(cov, np.cov(own.T, bias=True), atol=1e-7) and np.array_equal(cov, cov.T)


def test_incomplete_rows_and_empty(spark):
    df = spark.createDataFrame(
        [(0, 1.0, 2.0), (0, 3.0, 5.0), (0, None, 1.0), (0, float("nan"), 1.0), (None, 9.0, 9.0),
         (1, float("inf"), 1.0)], "fold long, a double, b double")
    got = gram.wide_moments(df, ["a", "b"], "fold")
    assert list(got) == [0] and got[0][0] == 2 and got[0][1].tolist() == [2.0, 3.5]
    assert gram.wide_moments(df.limit(0), ["a", "b"]) == {}
    assert gram.wide_corr(df.limit(0), ["a", "b"]).first()["r"] is None
    flat = df.withColumn("a", F.lit(1e9 / 3))
    assert gram.wide_corr(flat, ["a", "b"]).first()["r"] is None


def test_corr_is_sql_corr(spark):
    df, x, _ = frame(spark, 200, 6, 3)
    cols = [f"x{i}" for i in range(6)]
    blocks = {(r["a"], r["b"]): r["r"] for r in pr.corr_pairs(df, cols, method="blocks").collect()}
    plain = {(r["a"], r["b"]): r["r"] for r in pr.corr_pairs(df, cols).collect()}
    assert blocks.keys() == plain.keys()
    assert all(abs(blocks[k] - plain[k]) < 1e-7 for k in plain)


def test_wide_least_squares(spark, monkeypatch):
    p = models.WIDE + 20
    df, x, fold = frame(spark, 400, p, 4)
    xs = [f"x{i}" for i in range(p)]
    df = df.withColumn("y", sum((F.col(c) * (i % 5) for i, c in enumerate(xs)), F.rand(7)))
    wide = models.oof_ols(df, k=3, xs=xs).agg(F.avg(F.abs(F.col("y") - F.col("pred")))).first()[0]
    assert wide < 0.5  # the noise lies in 0..1
    with pytest.raises(ValueError):
        models.oof_ols(df, k=2, xs=xs)
    few = [f"x{i}" for i in range(4)]
    a = models.oof_ols(df, k=3, xs=few).select("x0", "pred").toPandas().sort_values("x0")
    monkeypatch.setattr(models, "WIDE", 2)
    b = models.oof_ols(df, k=3, xs=few).select("x0", "pred").toPandas().sort_values("x0")
    assert np.allclose(a["pred"], b["pred"], rtol=1e-6)
