"""One contract for all out-of-fold and held-out operators: every row is kept; a
row without a fold gets a null prediction and trains nothing; a null or NaN
target trains nothing and is counted as missing; a fold outside 0..k-1 raises;
k = 1 predicts nothing. And what may be broadcast is measured, not guessed."""

import math

import pytest
from pyspark.sql import functions as F

from outfold.operators import boosting as bo
from outfold.operators import holdout as ho
from outfold.operators import joins
from outfold.operators import lad
from outfold.operators import metrics as me
from outfold.operators import models as mo
from outfold.operators import oof

K = 3
OOF = {
    "mean": lambda d, k: oof.oof_predict(d, by="g", k=k),
    "encode": lambda d, k: oof.oof_encode(d, col="g", k=k, m=5.0, out="pred"),
    "many": lambda d, k: oof.oof_encode_many(d, ["g"], k=k, m=5.0).withColumnRenamed("g_te", "pred"),
    "median": lambda d, k: oof.oof_median(d, by="g", k=k),
    "sketch": lambda d, k: oof.oof_median(d, by="g", k=k, method="sketch"),
    "ols": lambda d, k: mo.oof_ols(d, xs=["x"], k=k),
    "lad": lambda d, k: lad.oof_lad(d, xs=["x"], k=k),
    "gbt": lambda d, k: mo.oof_gbt(d, xs=["x"], k=k, max_iter=1, max_depth=1),
    "boost": lambda d, k: bo.oof_boost(d, xs=["x"], k=k, rounds=2, depth=2, least_rows=2),
    "nested": lambda d, k: oof.nested_encoded_ols(d, "g", k=k, m=5.0),
    "kinds": lambda d, k: oof.oof_predict_kinds(d, {"a": "fold"}, by="g", k=k).withColumnRenamed("pred_a", "pred"),
}
SCHEMA = "id long, g string, x double, y double, fold long"


@pytest.fixture(scope="module")
def rows():
    out = [(i, "ab"[i % 2], float(i % 7), float(i % 5) + i % 2, i % K) for i in range(60)]
    out += [(100, "a", 1.0, 3.0, None), (101, None, 1.0, 3.0, 0), (102, "a", 1.0, None, 1),
            (103, "b", 1.0, float("nan"), 2), (104, "new", 1.0, 2.0, 0)]
    return out


@pytest.mark.parametrize("name", OOF)
def test_every_row_is_kept_and_counted(spark, rows, name):
    got = {r["id"]: r for r in OOF[name](spark.createDataFrame(rows, SCHEMA), K).collect()}
    assert sorted(got) == sorted(r[0] for r in rows)
    assert got[100]["pred"] is None
    assert all(got[i]["pred"] is not None and math.isfinite(got[i]["pred"]) for i in got if i != 100)
    score = me.mae(OOF[name](spark.createDataFrame(rows, SCHEMA), K)).first()
    assert (score["n_scored"], score["n_missing"]) == (len(rows) - 3, 3)
    assert math.isfinite(score["mae"])
    # what trains nothing changes no prediction
    plain = [r for r in rows if r[0] not in (100, 102, 103)]
    base = {r["id"]: r["pred"] for r in OOF[name](spark.createDataFrame(plain, SCHEMA), K).collect()}
    if name != "gbt":  # its split candidates are sampled from the partitions
        assert all(got[i]["pred"] == pytest.approx(p) for i, p in base.items())


@pytest.mark.parametrize("name", OOF)
def test_fold_outside_k_raises(spark, rows, name):
    with pytest.raises(ValueError):
        OOF[name](spark.createDataFrame(rows, SCHEMA), K - 1).collect()


@pytest.mark.parametrize("name", OOF)
def test_one_fold_predicts_nothing(spark, name):
    df = spark.createDataFrame([(i, "a", 1.0, 2.0, 0) for i in range(8)], SCHEMA)
    assert [r["pred"] for r in OOF[name](df, 1).collect()] == [None] * 8


@pytest.mark.parametrize("fit", [
    lambda d: ho.holdout_predict(d, "id", "y", "g", parts=2),
    lambda d: ho.holdout_encode(d, "id", "y", "g", parts=2),
    lambda d: ho.holdout_linear(d, "id", "y", ["x"], parts=2),
    lambda d: lad.holdout_lad(d, "id", "y", ["x"], parts=2),
    lambda d: bo.holdout_boost(d, "id", "y", ["x"], parts=2, rounds=1, depth=1)])
def test_holdout_parts_hold_every_row_once(spark, rows, fit):
    df = spark.createDataFrame([*rows, (None, "a", 1.0, 1.0, 0)], SCHEMA)
    held = {r["id"] for r in ho.split_holdout(df, "id", 2).where("is_holdout").collect()}
    train = {r["id"] for r in ho.split_holdout(df, "id", 2).where("not is_holdout").collect()}
    assert held | train == {r[0] for r in rows} | {None} and None in train and not held & train
    got = fit(df).collect()
    assert {r["id"] for r in got} == held
    assert all(r["pred"] is not None and math.isfinite(r["pred"]) for r in got)


def test_oof_with_holdout_equals_both_parts(spark, rows):
    df = spark.createDataFrame([r for r in rows if r[4] is not None], SCHEMA)
    df = ho.split_holdout(df, "id", 4, col="hold")
    both = {r["id"]: r["pred"] for r in oof.oof_with_holdout(df, "hold", by="g", k=K).collect()}
    for part in (oof.oof_predict(df.where("not hold"), by="g", k=K),
                 ho.holdout_predict(df, "id", "y", "g", parts=4)):
        for r in part.collect():
            assert both[r["id"]] == (None if r["pred"] is None else pytest.approx(r["pred"]))


def test_blend_of_three(spark):
    df = spark.createDataFrame([(1.0, 0.0, 2.0, 9.0), (2.0, 1.0, 3.0, 9.0), (None, 1.0, 1.0, 1.0)],
                               "y double, a double, b double, c double")
    out = me.blend_many(df, ["a", "b", "c"], steps=4)
    assert out.count() == 15
    best = out.where("best").first()
    assert best["weights"] == [0.5, 0.5, 0.0] and best["mae"] == 0 and best["n_scored"] == 2


def test_broadcast_by_measured_size(spark):
    wide = joins.materialize(spark.range(2000).select(F.repeat(F.lit("x"), 20_000).alias("g"), "id"))
    slim = joins.materialize(spark.range(20).select(F.col("id").cast("string").alias("g"), "id"))
    assert joins.table_bytes(wide) > 38_000_000 and joins.table_bytes(slim) < 1024
    hint = "strategy=broadcast"
    plan = lambda d: d._jdf.queryExecution().analyzed().toString()
    assert hint not in plan(joins.broadcast_if_small(wide))
    assert hint in plan(joins.broadcast_if_small(slim))
    nested = joins.materialize(spark.range(10).select(F.array_repeat(F.lit("y"), 100_000).alias("g")))
    assert joins.table_bytes(nested) > 1_000_000


def test_label_index_of_many_categories(spark):
    from outfold.operators import features as fe
    df = spark.range(3000).select((F.col("id") % 1500).cast("string").alias("c"))
    got = fe.label_index(df, "c").distinct().collect()
    want = sorted({str(i) for i in range(1500)})
    assert {r["c"]: r["c_idx"] for r in got} == {c: i for i, c in enumerate(want)}


def test_fit_ranges(spark):
    from outfold.operators import checks as ch
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), (None, 9.0)], "t string, x double")
    bounds = ch.fit_ranges(df, "t", "x")
    assert bounds == {"x": {"a": (1.0, 3.0), "b": (5.0, 5.0)}}
    assert {r["n_bad"] for r in ch.check_ranges_by(df, "t", "x", bounds["x"]).collect()} == {0}


def test_sink_leaves_nothing_behind(spark, tmp_path):
    import os

    from outfold.sources import sinks
    target = str(tmp_path / "out")
    bad = spark.createDataFrame([(1, 0.5), (1, 0.6)], "id long, pred double")
    with pytest.raises(sinks.SinkCheckError):
        sinks.write_predictions(bad, target, "id")
    assert os.listdir(tmp_path) == []
    good = bad.dropDuplicates(["id"])
    assert sinks.write_predictions(good, target, "id")["rows"] == 1
    with pytest.raises(FileExistsError):
        sinks.write_predictions(good, target, "id")
    assert sinks.write_predictions(good, target, "id", mode="overwrite")["rows"] == 1
    assert os.listdir(tmp_path) == ["out"]
