"""Invariants and edge cases of the out-of-fold operators."""

import pytest
from conftest import SF01
from pyspark.sql import functions as F

from outfold.operators import folds as fo
from outfold.operators import metrics as me
from outfold.operators import oof
from outfold.plans.catalog import K, orders_fact


@pytest.fixture(scope="module")
def fact(spark):
    return orders_fact(spark, SF01).cache()


def test_every_row_in_exactly_one_fold(fact):
    r = fact.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"),
                 F.min("fold").alias("lo"), F.max("fold").alias("hi"),
                 F.count(F.when(F.col("fold").isNull(), 1)).alias("nulls")).first()
    assert r["n"] == r["ids"] == 15000
    assert (r["lo"], r["hi"], r["nulls"]) == (0, K - 1, 0)


def test_fold_sizes_match_probe(fact):
    sizes = {r["fold"]: r["n_rows"] for r in fo.fold_sizes(fact).collect()}
    assert sizes == {0: 3013, 1: 2957, 2: 2976, 3: 3098, 4: 2956}


def test_own_fold_y_never_changes_own_prediction(fact):
    """Changing every y of fold 0 must leave every fold-0 prediction as it was
    (a row's own y, and its fold-mates', never reach its prediction)."""
    base = oof.oof_predict(fact, by="g", k=K).select("id", "fold", "pred")
    moved = fact.withColumn("y", F.when(F.col("fold") == 0, F.col("y") * 10 + 7)
                            .otherwise(F.col("y")))
    new = oof.oof_predict(moved, by="g", k=K).select("id", F.col("pred").alias("pred2"))
    j = base.join(new, "id")
    assert j.where("fold = 0 AND abs(pred - pred2) > 1e-6").count() == 0
    assert j.where("fold <> 0 AND abs(pred - pred2) > 1e-6").count() > 0


def test_pooled_mae_is_weighted_mean_of_fold_maes(fact):
    pred = oof.oof_predict(fact, by="g", k=K)
    pooled = me.mae(pred).first()["mae"]
    per = me.mae_by_fold(pred).collect()
    weighted = sum(r["mae"] * r["n_scored"] for r in per) / sum(r["n_scored"] for r in per)
    assert pooled == pytest.approx(weighted, rel=1e-12)
    plain = sum(r["mae"] for r in per) / len(per)
    assert per[0]["mean_fold_mae"] == pytest.approx(plain, rel=1e-12)


def test_partitioning_does_not_change_results(fact):
    a = me.mae(oof.oof_predict(fact.repartition(1), by="g", k=K)).first()["mae"]
    b = me.mae(oof.oof_predict(fact.repartition(200), by="g", k=K)).first()["mae"]
    assert round(a, 6) == round(b, 6) == 124745.804755


def test_empty_input(spark, fact):
    empty = fact.limit(0)
    r = me.mae(oof.oof_predict(empty, by="g", k=K)).first()
    assert r["mae"] is None and r["n_scored"] == 0 and r["n_missing"] == 0


def test_k1_has_no_training_rows(fact):
    one = fact.withColumn("fold", F.lit(0).cast("bigint"))
    r = me.mae(oof.oof_predict(one, by="g", k=1)).first()
    assert r["mae"] is None and r["n_missing"] == 15000


def test_category_in_one_fold_falls_back_to_global(spark):
    rows = [(1, "a", 10.0, 0), (2, "a", 20.0, 1), (3, "b", 100.0, 0), (4, "a", 30.0, 2)]
    df = spark.createDataFrame(rows, "id long, g string, y double, fold long")
    p = {r["id"]: r["pred"] for r in oof.oof_predict(df, by="g", k=3).collect()}
    assert p[3] == pytest.approx((20.0 + 30.0) / 2)   # global mean of folds 1, 2
    assert p[1] == pytest.approx((20.0 + 30.0) / 2)   # group a in folds 1, 2
    assert p[2] == pytest.approx((10.0 + 30.0) / 2)


def test_null_y_is_counted_not_scored(spark):
    rows = [(1, "a", None, 0), (2, "a", 20.0, 1), (3, "a", 40.0, 0), (4, "a", 30.0, 1)]
    df = spark.createDataFrame(rows, "id long, g string, y double, fold long")
    p = oof.oof_predict(df, by="g", k=2)
    got = {r["id"]: r["pred"] for r in p.collect()}
    assert got[2] == pytest.approx(40.0)   # fold 0 has one non-null y
    r = me.mae(p).first()
    assert r["n_scored"] == 3 and r["n_missing"] == 1


def test_null_category_uses_global_fallback(spark):
    rows = [(1, None, 10.0, 0), (2, None, 20.0, 1), (3, "a", 40.0, 1)]
    df = spark.createDataFrame(rows, "id long, g string, y double, fold long")
    got = {r["id"]: r["pred"] for r in oof.oof_predict(df, by="g", k=2).collect()}
    assert got[1] == pytest.approx(30.0)


def test_leak_unique_id_as_category(fact):
    """A unique id as category has no out-of-fold rows: every prediction must
    be the fallback (an in-fold mean would give MAE 0)."""
    by_id = oof.oof_predict(fact.withColumn("cat", F.col("id")), by="cat", k=K, out="p_id")
    fallback = oof.oof_global_sums(fact, "fold", "y", K).select(
        "fold", (F.col("gs_oof") / F.col("gn_oof")).alias("fb"))
    j = by_id.join(fallback, "fold")
    assert j.where(F.abs(F.col("p_id") - F.col("fb")) > 1e-9).count() == 0
    assert me.mae(by_id, pred="p_id").first()["mae"] > 1000


def test_encode_smoothing_limits(fact):
    big = oof.oof_encode(fact, col="g", k=K, m=1e12, out="te").select("id", "te")
    fb = oof.oof_global_sums(fact, "fold", "y", K).select(
        "fold", (F.col("gs_oof") / F.col("gn_oof")).alias("fb"))
    j = fact.join(big, "id").join(fb, "fold")
    assert j.where(F.abs(F.col("te") - F.col("fb")) > 1e-3).count() == 0
    zero = oof.oof_encode(fact, col="g", k=K, m=0.0, out="te").select("id", "te")
    plain = oof.oof_predict(fact, by="g", k=K).select("id", "pred")
    assert zero.join(plain, "id").where(F.abs(F.col("te") - F.col("pred")) > 1e-6).count() == 0


def test_median_sketch_close_to_exact(fact):
    ex = me.mae(oof.oof_median(fact, by="g", k=K, method="exact")).first()["mae"]
    sk = me.mae(oof.oof_median(fact, by="g", k=K, method="sketch")).first()["mae"]
    assert ex == pytest.approx(124826.615178, abs=1e-6)
    assert sk == pytest.approx(ex, rel=2e-3)


def test_median_matches_brute_force(spark):
    import numpy as np
    rows = [(i, "ab"[i % 2], float((i * 37) % 11), i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, g string, y double, fold long")
    got = {r["id"]: r["pred"] for r in oof.oof_median(df, by="g", k=3, method="exact").collect()}
    for i, g, _, f in rows:
        want = np.median([y for (_, gg, y, ff) in rows if gg == g and ff != f])
        assert got[i] == pytest.approx(want)


def test_group_fold_keeps_groups_together(spark):
    from outfold.plans.registry import table
    li = fo.assign_group_fold(table(spark, SF01, "lineitem"), "l_partkey", K)
    per = li.groupBy("l_partkey").agg(F.count_distinct("fold").alias("nf"))
    assert per.agg(F.max("nf")).first()[0] == 1


def test_strat_fold_balanced_and_bucket_invariant(spark):
    from outfold.plans.registry import table
    c = table(spark, SF01, "customer").select("c_custkey", "c_mktsegment")
    a = fo.assign_strat_fold(c, "c_mktsegment", "c_custkey", K, buckets=37)
    b = fo.assign_strat_fold(c, "c_mktsegment", "c_custkey", K, buckets=1)
    diff = a.join(b.withColumnRenamed("fold", "fold_b"), ["c_custkey", "c_mktsegment"]) \
        .where("fold <> fold_b").count()
    assert diff == 0
    sizes = a.groupBy("c_mktsegment", "fold").count() \
        .groupBy("c_mktsegment").agg((F.max("count") - F.min("count")).alias("spread"))
    assert sizes.agg(F.max("spread")).first()[0] <= 1


def test_fold_seed_changes_assignment(fact):
    s = fo.assign_fold(fact.select("id"), "id", K, seed="other", out="f2")
    moved = s.join(fact.select("id", "fold"), "id").where("fold <> f2").count()
    assert 0.7 * 15000 < moved < 0.9 * 15000


def test_linear_matches_brute_force(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    n = 200
    x1, x2 = rng.normal(size=n), rng.normal(size=n) * 100 + 5000
    y = 3 * x1 - 0.02 * x2 + rng.normal(size=n)
    rows = [(i, float(x1[i]), float(x2[i]), float(y[i]), i % 4) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, x1 double, x2 double, y double, fold long")
    from outfold.operators.models import oof_ols
    got = {r["id"]: r["pred"] for r in oof_ols(df, xs=["x1", "x2"], k=4).collect()}
    for f in range(4):
        tr = [r for r in rows if r[4] != f]
        X = np.array([[1.0, r[1], r[2]] for r in tr])
        beta = np.linalg.lstsq(X, np.array([r[3] for r in tr]), rcond=None)[0]
        for r in rows:
            if r[4] == f:
                assert got[r[0]] == pytest.approx(beta @ [1.0, r[1], r[2]], rel=1e-7, abs=1e-7)


def test_encode_many_equals_one_at_a_time(spark, fact):
    f = fact.withColumn("g2", F.concat_ws("-", "g", "status"))
    many = oof.oof_encode_many(f, ["g", "g2"], k=K, m=5.0).select("id", "g_te", "g2_te")
    one = oof.oof_encode(f, col="g", k=K, m=5.0, out="a").select("id", "a")
    two = oof.oof_encode(f, col="g2", k=K, m=5.0, out="b").select("id", "b")
    j = many.join(one, "id").join(two, "id")
    assert j.count() == 15000
    assert j.where("abs(g_te - a) > 1e-6 OR abs(g2_te - b) > 1e-6").count() == 0


def test_exact_mae_is_partition_independent(fact):
    p = oof.oof_predict(fact, by="g", k=K).cache()
    vals = {me.mae(p.repartition(n), exact=True).first()["mae"] for n in (1, 7, 64)}
    assert len(vals) == 1
    assert round(vals.pop(), 6) == 124745.804755


def test_xxhash_folds_are_balanced_and_stable(spark, fact):
    a = fo.assign_fold(fact.select("id"), "id", K, method="xxhash64", out="f2")
    b = fo.assign_fold(fact.select("id").repartition(13), "id", K, method="xxhash64", out="f3")
    j = a.join(b, "id")
    assert j.where("f2 <> f3").count() == 0
    sizes = [r["count"] for r in a.groupBy("f2").count().collect()]
    assert len(sizes) == K and min(sizes) > 0.18 * 15000


def test_row_without_fold_trains_nothing(spark):
    rows = [(1, "a", 10.0), (2, "a", 20.0), (None, "a", 1000.0), (4, "a", 30.0), (5, "a", 40.0)]
    df = fo.assign_fold(spark.createDataFrame(rows, "id long, g string, y double"), "id", 2)
    base = fo.assign_fold(spark.createDataFrame([r for r in rows if r[0] is not None],
                                                "id long, g string, y double"), "id", 2)
    for fn in (lambda d: oof.oof_predict(d, by="g", k=2),
               lambda d: oof.oof_median(d, by="g", k=2, method="exact"),
               lambda d: oof.oof_encode_many(d, ["g"], k=2, m=None, suffix="_p")
               .withColumnRenamed("g_p", "pred")):
        with_null = {r["id"]: r["pred"] for r in fn(df).collect()}
        without = {r["id"]: r["pred"] for r in fn(base).collect()}
        assert with_null.pop(None) is None
        assert with_null == pytest.approx(without)
