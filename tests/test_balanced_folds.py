"""Group folds of near equal size."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from outfold.operators import folds as fo


def sizes_of(rows):
    return Counter(r["fold"] for r in rows)


def test_skewed_groups_stay_whole_and_folds_are_even(spark):
    rng = random.Random(4)
    groups = ["hot"] * 2000 + ["warm"] * 900 + ["mild"] * 700 + [f"g{rng.randrange(900)}" for _ in range(6400)]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(groups)], "id long, g string")
    rows = fo.assign_balanced_group_fold(df.repartition(7), "g", 5, slots=256).collect()
    again = fo.assign_balanced_group_fold(df.coalesce(1), "g", 5, slots=256).collect()
    assert {r["id"]: r["fold"] for r in rows} == {r["id"]: r["fold"] for r in again}
    of = defaultdict(set)
    for r in rows:
        of[r["g"]].add(r["fold"])
    assert len(rows) == 10_000 and all(len(f) == 1 for f in of.values())
    n = sizes_of(rows)
    assert set(n) == {0, 1, 2, 3, 4} and max(n.values()) - min(n.values()) <= 40
    plain = sizes_of(fo.assign_group_fold(df, "g", 5).collect())
    assert max(plain.values()) - min(plain.values()) > 400


def test_two_heavy_groups(spark):
    df = spark.createDataFrame([("a",)] * 50 + [("b",)] * 50 + [("c",)] * 2, "g string")
    n = sizes_of(fo.assign_balanced_group_fold(df, "g", 2, slots=8).collect())
    assert sorted(n.values()) == [50, 52]


def test_null_groups_numbers_empty_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (None, "w")], "g long, __x string")
    got = fo.assign_balanced_group_fold(df, "g", 2).collect()
    fold = {r["__x"]: r["fold"] for r in got}
    assert len(got) == 4 and fold["w"] is None and fold["x"] == fold["y"] != fold["z"]
    assert fo.assign_balanced_group_fold(df.limit(0), "g", 2).count() == 0
    assert fo.assign_balanced_group_fold(df.where("g is null"), "g", 2).collect()[0]["fold"] is None
    with pytest.raises(ValueError):
        fo.assign_balanced_group_fold(df, "g", 0)


def test_rows_are_not_shuffled(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("g"))
    plan = fo.assign_balanced_group_fold(df, "g", 3)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


def test_packing():
    assert fo.pack_largest_first([5, 4, 3, 3], 2) == [0, 1, 1, 0]
    assert fo.pack_largest_first([], 2) == []
