"""exact_quantiles against Spark's percentile (the semantics to match), with
several passes forced by tiny working sizes."""

import pytest
from conftest import SF01
from pyspark.sql import functions as F

from outfold.functions.folds import fold_col
from outfold.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
WORK = [200_000, 10, 100, 1]


@pytest.fixture(scope="module")
def orders(spark):
    o = spark.read.parquet(f"{SF01}/orders.parquet")
    return o.withColumn("fold", fold_col("o_orderkey", 5)).cache()


def _pct(df, x, probs):
    return F.percentile(x, F.array(*[F.lit(p) for p in probs]))


@pytest.mark.parametrize("work", WORK[:3])
def test_global(orders, work):
    ref = orders.agg(_pct(orders, "o_totalprice", PROBS)).first()[0]
    got = exact_quantiles(orders, "o_totalprice", PROBS, work=work).first()["q"]
    assert got == ref


@pytest.mark.parametrize("work", WORK[:2])
def test_by_group_with_ties(orders, work):
    # o_custkey has many repeated values per priority: ties at cut points
    ref = orders.groupBy("o_orderpriority").agg(_pct(orders, "o_custkey", [0.5, 0.3]).alias("r"))
    got = exact_quantiles(orders, "o_custkey", [0.5, 0.3], by="o_orderpriority",
                          work=work)
    j = got.join(ref, "o_orderpriority")
    assert j.count() == 5 and j.where("q <> r").count() == 0


@pytest.mark.parametrize("work", [WORK[0], WORK[1], WORK[3]])
def test_fold_mode_matches_replicated_percentile(orders, work):
    rep = orders.withColumn("t", F.explode(F.filter(
        F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint")), lambda t: t != F.col("fold"))))
    ref = rep.groupBy("o_orderpriority", "t").agg(F.percentile("o_totalprice", F.lit(0.5)).alias("r"))
    got = exact_quantiles(orders, "o_totalprice", [0.5], by="o_orderpriority", fold="fold", k=5,
                          work=work)
    j = got.join(ref.withColumnRenamed("t", "fold"), ["o_orderpriority", "fold"])
    assert j.count() == 25 and j.where("q[0] <> r").count() == 0


def test_empty_and_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, float("nan"))], "g int, x double")
    assert exact_quantiles(df, "x", [0.5]).count() == 0
    df2 = spark.createDataFrame([(1, 5.0), (1, None), (2, 7.0)], "g int, x double")
    got = {r["g"]: r["q"][0] for r in exact_quantiles(df2, "x", [0.5], by="g").collect()}
    assert got == {1: 5.0, 2: 7.0}


def test_constant_group(spark):
    df = spark.createDataFrame([(3.0,)] * 50, "x double")
    assert exact_quantiles(df, "x", [0.1, 0.9], work=1).first()["q"] == [3.0, 3.0]


@pytest.mark.parametrize("work", [5, 100_000])
def test_null_group_and_infinities(spark, work):
    inf = float("inf")
    rows = [(g, float(i * i % 97)) for g in ("a", None) for i in range(400)]
    rows += [("a", inf), (None, -inf), ("a", None), (None, float("nan"))] + [("i", inf)] * 30 + [("i", -inf)] * 31
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: r["q"] for r in exact_quantiles(df, "x", [0.0, 0.25, 0.5, 1.0], by="g", work=work).collect()}
    for g in ("a", None, "i"):
        xs = sorted(x for h, x in rows if h == g and x is not None and x == x)
        want = []
        for p in (0.0, 0.25, 0.5, 1.0):
            at = p * (len(xs) - 1)
            lo, hi = xs[int(at)], xs[-int(-at // 1)]
            want.append(lo if lo == hi else lo + (at % 1) * (hi - lo))
        assert got[g] == pytest.approx(want)


def test_fold_out_of_range_raises(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 5)], "x double, fold int")
    with pytest.raises(ValueError):
        exact_quantiles(df, "x", [0.5], fold="fold", k=5)


def test_hot_group_stays_in_place_without_broadcast(spark, monkeypatch):
    """With broadcasts off, the rows of a group of a third of the table are not
    shuffled by the group: the histogram's join has them on a broadcast side."""
    from outfold.operators import joins, quantiles
    df = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("g"),
        F.rand(3).alias("x"))
    want = df.where("g = 'hot'").agg(F.percentile("x", F.lit(0.5))).first()[0]
    plans = []
    plain = joins.join_hot

    def seen(*a):
        out = plain(*a)
        plans.append(out._jdf.queryExecution().optimizedPlan().toString())
        return out

    monkeypatch.setattr(quantiles, "join_hot", seen)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = exact_quantiles(df, "x", [0.5], by="g", work=500).where("g = 'hot'").first()["q"][0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))
    assert got == pytest.approx(want, abs=0)
    assert len(plans) >= 2 and all("Union" in p and "strategy=broadcast" in p for p in plans)
