"""Held-out scoring over a stream of several files, one per micro-batch: the
running state must end equal to the batch score, and a restart from the
checkpoint must not count a batch twice."""

from conftest import SF01
from pyspark.sql import functions as F

from outfold.operators import holdout as ho
from outfold.operators import metrics as me
from outfold.plans.catalog import orders_fact
from outfold.session import scratch_path
from outfold.streaming import scoring as st


def test_running_mae_over_batches_and_restart(spark):
    fact = ho.split_holdout(orders_fact(spark, SF01), "id", 10, col="hold")
    train = fact.where(~F.col("hold"))
    model, glob = ho.fit_group_mean(train, "y", "g")
    held = fact.where(F.col("hold")).drop("hold")
    want = me.mae(ho.score_group_mean(held, model, glob, "g")).first()

    src = scratch_path(spark, "arrivals")
    parts = held.withColumn("__p", F.col("id") % 4)
    for i in range(4):   # four files arriving one after another
        parts.where(F.col("__p") == i).drop("__p").coalesce(1).write.parquet(f"{src}/batch={i}")
    schema = held.schema
    out, ckpt = scratch_path(spark, "running"), scratch_path(spark, "ckpt")

    def run():
        stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
                  .option("recursiveFileLookup", "true").parquet(src))
        scored = st.score_stream(stream, model, glob, "g")
        q = st.run_running_mae(spark, scored, out, checkpoint=ckpt)
        q.awaitTermination()
        return q

    q = run()
    got = st.latest(spark, out).first()
    assert got["n_scored"] == want["n_scored"] == 1480
    assert round(got["mae"], 6) == round(want["mae"], 6)
    assert got["epoch"] >= 3          # at least four micro-batches ran
    assert q.lastProgress is not None

    run()                              # restart: nothing new, nothing counted twice
    again = st.latest(spark, out).first()
    assert again["n_scored"] == 1480


def test_running_mae_per_segment(spark):
    fact = ho.split_holdout(orders_fact(spark, SF01), "id", 10, col="hold")
    model, glob = ho.fit_group_mean(fact.where(~F.col("hold")), "y", "g")
    held = fact.where(F.col("hold")).drop("hold")
    want = {r["status"]: (r["n_scored"], round(r["mae"], 6)) for r in
            me.mae_by(ho.score_group_mean(held, model, glob, "g"), "status").collect()}
    src = scratch_path(spark, "arrivals-seg")
    held.coalesce(2).write.parquet(src)
    stream = spark.readStream.schema(held.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = scratch_path(spark, "running-seg")
    st.run_running_mae(spark, st.score_stream(stream, model, glob, "g"), out,
                       by="status").awaitTermination()
    got = {r["status"]: (r["n_scored"], round(r["mae"], 6)) for r in st.latest(spark, out).collect()}
    assert got == want
