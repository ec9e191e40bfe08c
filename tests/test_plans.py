"""Physical plan shape: what must hold for the plans to scale."""

import pytest
from conftest import SF01

from outfold.operators import metrics as me
from outfold.operators import oof
from outfold.plans.catalog import K, orders_fact
from outfold.plans.registry import entries


def _plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def _ancestors(plan: str, needle: str):
    """Operator names above every plan line containing ``needle``."""
    lines = plan.splitlines()

    def depth(ln):
        return len(ln) - len(ln.lstrip(" :+-|"))

    out = []
    for i, ln in enumerate(lines):
        if needle not in ln:
            continue
        d, anc = depth(ln), []
        for prev in reversed(lines[:i]):
            if depth(prev) < d:
                anc.append(prev.strip(" :+-|*"))
                d = depth(prev)
        out.append(anc)
    return out


def test_flagship_streams_fact_through_broadcast_joins(spark):
    plan = _plan(entries()["oof_mae"].build(spark, SF01))
    assert "SortMergeJoin" not in plan
    assert plan.count("BroadcastHashJoin") == 2
    # the fact is scanned from parquet once and streamed: no exchange above it
    # below the final one-row aggregate
    scans = _ancestors(plan, "FileScan parquet [o_")  # model tables are Parquet too
    assert len(scans) == 1
    above = scans[0]
    first_exchange = next(i for i, a in enumerate(above) if a.startswith("Exchange"))
    assert "SinglePartition" in above[first_exchange]
    assert any(a.startswith("BroadcastHashJoin") for a in above[:first_exchange])


@pytest.mark.parametrize("key", sorted(entries()))
def test_no_pairs_and_no_row_python(spark, key):
    plan = _plan(entries()[key].build(spark, SF01))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan, (key, bad)


def test_multi_column_groups(spark):
    """Grouping by two columns equals grouping by their concatenation."""
    from pyspark.sql import functions as F
    f = orders_fact(spark, SF01)
    two = oof.oof_predict(f, by=["g", "status"], k=K).select("id", "pred")
    one = oof.oof_predict(f.withColumn("gs", F.concat_ws("|", "g", "status")), by="gs", k=K)
    j = two.join(one.select("id", F.col("pred").alias("p1")), "id")
    assert j.count() == 15000
    assert j.where(F.abs(F.col("pred") - F.col("p1")) > 1e-6).count() == 0
    assert me.mae(one, pred="pred").first()["n_scored"] == 15000
