"""A hot group holding a third of all rows: results must not change when the
model tables are too big to broadcast (shuffle joins with AQE skew
splitting) or when quantiles must be refined instead of collected."""

import pytest
from conftest import SF01
from pyspark.sql import functions as F

from outfold.operators import folds as fo
from outfold.operators import metrics as me
from outfold.operators import oof
from outfold.operators.quantiles import exact_quantiles
from outfold.plans.catalog import K, orders_fact


@pytest.fixture(scope="module")
def hot(spark):
    f = orders_fact(spark, SF01)
    return f.withColumn("g", F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.col("g"))).cache()


def test_hot_group_oof_mean_same_without_broadcast(spark, hot):
    a = me.mae(oof.oof_predict(hot, by="g", k=K)).first()["mae"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        df = oof.oof_predict(hot, by="g", k=K)
        b = me.mae(df).first()["mae"]
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan
    assert a == pytest.approx(b, rel=1e-12)


def test_hot_group_exact_median_refined(hot):
    rep = hot.withColumn("t", F.explode(F.filter(
        F.sequence(F.lit(0).cast("bigint"), F.lit(K - 1).cast("bigint")),
        lambda t: t != F.col("fold"))))
    ref = rep.groupBy("g", "t").agg(F.percentile("y", F.lit(0.5)).alias("r"))
    got = exact_quantiles(hot, "y", [0.5], by="g", fold="fold", k=K, work=500)
    j = got.join(ref.withColumnRenamed("t", "fold"), ["g", "fold"])
    assert j.count() == 30 and j.where("q[0] <> r").count() == 0


def test_hot_stratum_folds_balanced(hot):
    s = fo.assign_strat_fold(hot, "g", "id", K, buckets=16)
    sizes = s.where("g = 'HOT'").groupBy("fold").count().collect()
    counts = sorted(r["count"] for r in sizes)
    assert len(counts) == K and counts[-1] - counts[0] <= 1 and sum(counts) == 5000
