"""States that grow batch by batch: one after the other equals all at once."""

import random

import pytest
from pyspark.sql import functions as F

from outfold.operators import oof
from outfold.operators import profile as pr
from outfold.operators import profile_state as ps
from outfold.operators.stored import StoredSums
from outfold.session import scratch_path
from outfold.sources import increments

SCHEMA = "id long, g string, fold long, y double"


def facts(spark, n=300):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "b", None, "only" if i == 7 else "c"]), rng.choice([0, 1, 2, None]),
             rng.choice([None, float("nan"), rng.uniform(-5, 5), 1e9 + rng.random()])) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def as_map(df, c="pred"):
    return {r["id"]: r[c] for r in df.collect()}


@pytest.mark.parametrize("m", [None, 5.0])
def test_batches_equal_one(spark, m):
    df = facts(spark)
    store = StoredSums(spark, scratch_path(spark, "s"), df.schema, "g")
    assert store.stats().count() == 0
    for b in range(3):
        store.add(df.where(F.col("id") % 3 == b), b)
    store.add(df.where("id % 3 = 1"), 1)  # replayed
    want = as_map(oof.oof_encode(df, col="g", fold="fold", k=3, m=m, out="pred"))
    got = as_map(store.predict(df, 3, m))
    assert got.keys() == want.keys()
    for i in want:
        assert got[i] == pytest.approx(want[i], rel=1e-12) if want[i] is not None else got[i] is None
    store.compact()
    assert increments.batches(spark, store.path) == (2, [])
    store.add(df, 1)  # part of the merged folder already
    assert as_map(store.predict(df, 3, m)) == got
    store.compact()
    assert as_map(store.predict(df, 3, m)) == got


def test_new_rows_and_cut_write(spark):
    df = facts(spark)
    store = StoredSums(spark, scratch_path(spark, "s"), df.schema, "g")
    store.add(df.where("fold = 0"), 0)
    new = spark.createDataFrame([(1, "a", 2), (2, "never", 1)], "id long, g string, fold long")
    got = as_map(store.predict(new, 3))
    mean = {r["g"]: r["m"] for r in df.where("fold = 0 and not isnan(y)").groupBy("g").agg(
        F.avg("y").alias("m")).collect()}
    assert got[1] == pytest.approx(mean["a"])
    assert got[2] == pytest.approx(df.where("fold = 0 and not isnan(y)").agg(F.avg("y")).first()[0])
    # a batch or merged folder without its success mark does not count
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    store.state(df).write.parquet(f"{store.path}/batch=1")
    store.state(df).write.parquet(f"{store.path}/merged=5")
    fs = hadoop(store.path).getFileSystem(spark._jsc.hadoopConfiguration())
    for d in ("batch=1", "merged=5"):
        fs.delete(hadoop(f"{store.path}/{d}/_SUCCESS"), False)
    assert increments.batches(spark, store.path) == (None, [0])
    with pytest.raises(ValueError):
        store.add(df.withColumn("fold", F.lit(7).cast("long")), 1)
        store.predict(new, 3).collect()


def test_stream_and_restart(spark):
    df = facts(spark)
    src, ckpt = scratch_path(spark, "src"), scratch_path(spark, "ckpt")
    store = StoredSums(spark, scratch_path(spark, "s"), df.schema, "g")

    def run():
        s = (spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1)
             .option("recursiveFileLookup", "true").parquet(src))
        store.follow(s, ckpt).awaitTermination()

    for b in range(2):
        df.where(F.col("id") % 3 == b).coalesce(1).write.parquet(f"{src}/f{b}")
    run()
    run()  # nothing new
    df.where("id % 3 = 2").coalesce(1).write.parquet(f"{src}/f2")
    run()
    assert increments.batches(spark, store.path) == (None, [0, 1, 2])
    want = as_map(oof.oof_encode(df, col="g", fold="fold", k=3, m=None, out="pred"))
    got = as_map(store.predict(df, 3))
    assert all(got[i] == pytest.approx(want[i], rel=1e-12) if want[i] is not None else got[i] is None for i in want)


def test_profile_states(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, float("nan"), 0.0, -0.0, 1e8 + rng.random()]), rng.randrange(5000), None)
            for i in range(20000)]
    df = spark.createDataFrame(rows, "id long, x double, k long, none double").repartition(6)
    store = ps.StoredProfile(spark, scratch_path(spark, "p"), ["x", "k", "none"])
    assert store.report().count() == 0
    for b in range(4):
        store.add(df.where(F.col("id") % 4 == b), b)
        if b == 2:
            store.compact()
    store.add(df.where("id < 0"), 4)  # an empty file
    got = {r["column"]: r for r in store.report().collect()}
    clean = df.withColumn("x", F.expr("nullif(x, double('nan'))"))
    want = {r["column"]: r for r in pr.profile(clean, ["x", "k", "none"], exact=True).collect()}
    for c, w in want.items():
        g = got[c]
        assert (g["n_rows"], g["n_null"], g["min"], g["max"]) == (w["n_rows"], w["n_null"], w["min"], w["max"])
        if w["mean"] is None:
            assert (g["mean"], g["sd"], g["median"], g["n_distinct"]) == (None, None, None, 0)
            continue
        assert g["mean"] == pytest.approx(w["mean"]) and g["sd"] == pytest.approx(w["sd"])
        assert abs(g["n_distinct"] - w["n_distinct"]) <= 0.03 * w["n_distinct"]
        for q, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
            v = clean.where(F.col(c).isNotNull())
            below, upto, n = v.agg(F.count(F.when(F.col(c) < g[q], 1)), F.count(F.when(F.col(c) <= g[q], 1)),
                                   F.count(c)).first()
            assert below / n - 0.01 <= p <= upto / n + 0.01
