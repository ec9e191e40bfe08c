"""Sources, sinks, checks and features on small generated fixtures.

The layout-attribute fixture is generated from its schema and per-type ranges
(FIXTURES.md F1); no row of the reference data is used.
"""

import random

import pytest
from pyspark.sql import functions as F

from outfold.operators import checks as ch
from outfold.operators import features as fe
from outfold.session import scratch_path
from outfold.sources import sinks, tables
from outfold.sources.tables import LAYOUT_SCHEMA, LAYOUT_WHOLE_COUNTS

TYPES = [("grid", 106), ("hybrid", 98), ("narrow", 50), ("hub_spoke", 46)]


def layout_rows(n=300, seed=11):
    rnd = random.Random(seed)
    kinds = [t for t, w in TYPES for _ in range(w)]
    rows = []
    for i in range(n):
        t = kinds[rnd.randrange(len(kinds))]
        b = ch.LAYOUT_TYPE_BOUNDS[t]
        rows.append([
            f"WH_{i + 1:03d}", t,
            round(rnd.uniform(*b["aisle_width_avg"]), 2),
            float(rnd.randint(*b["intersection_count"])),
            round(rnd.uniform(*b["one_way_ratio"]), 4),
            float(rnd.randint(1, 24)), float(rnd.randint(1, 18)),
            round(rnd.uniform(*b["layout_compactness"]), 4),
            round(rnd.uniform(0.1, 1.0), 4),
            rnd.randint(8, 100), rnd.randint(5, 50), rnd.randint(511, 9967),
            round(rnd.uniform(4.0, 14.8), 1), rnd.randint(10, 100), rnd.randint(2, 10)])
    return rows


def write_layout_csv(path, rows, header=None):
    import os
    os.makedirs(path, exist_ok=True)
    names = header or [f.name for f in LAYOUT_SCHEMA.fields]
    with open(f"{path}/part-0.csv", "w") as fh:
        fh.write(",".join(names) + "\n")
        for r in rows:
            fh.write(",".join(str(v) for v in r) + "\n")


@pytest.fixture(scope="module")
def layout_dir(spark):
    from outfold.session import local_path
    p = local_path(scratch_path(spark, "layout"))
    write_layout_csv(p, layout_rows())
    return p


def test_layout_scan_types_and_rules(spark, layout_dir):
    df = tables.read_table(spark, layout_dir, LAYOUT_SCHEMA)
    assert df.count() == 300
    assert dict(df.dtypes)["intersection_count"] == "double"
    ints = ch.cast_exact(df, list(LAYOUT_WHOLE_COUNTS), strict=True)
    assert dict(ints.dtypes)["charger_count"] == "int"
    bad = {r["rule"]: r["n_bad"] for r in ch.check_rules(df, ch.layout_rules()).collect()}
    assert set(bad.values()) == {0}
    for col in ("aisle_width_avg", "one_way_ratio", "layout_compactness", "intersection_count"):
        bounds = {t: v[col] for t, v in ch.LAYOUT_TYPE_BOUNDS.items()}
        r = ch.check_ranges_by(df, "layout_type", col, bounds).collect()
        assert sum(x["n_bad"] for x in r) == 0 and sum(x["n_unbounded"] for x in r) == 0
    assert ch.check_unique(df, "layout_id").count() == 0


def test_renamed_header_raises(spark):
    from outfold.session import local_path
    p = local_path(scratch_path(spark, "renamed"))
    names = [f.name for f in LAYOUT_SCHEMA.fields]
    names[3] = "crossings"
    write_layout_csv(p, layout_rows(5), header=names)
    with pytest.raises(Exception):
        tables.read_table(spark, p, LAYOUT_SCHEMA).collect()
    # the lenient reader accepts it silently, which is why strict is the default
    assert tables.read_table(spark, p, LAYOUT_SCHEMA, strict=False).count() == 5


def test_int_schema_on_whole_doubles_fails_fast(spark, layout_dir):
    from pyspark.sql import types as T
    bad = T.StructType([T.StructField(f.name, T.IntegerType()) if f.name in LAYOUT_WHOLE_COUNTS
                        else f for f in LAYOUT_SCHEMA.fields])
    with pytest.raises(Exception):
        tables.read_table(spark, layout_dir, bad).collect()


def test_cast_exact_flags_fraction(spark):
    df = spark.createDataFrame([(1, 34.0), (2, 34.5), (3, None)], "id int, c double")
    got = {r["id"]: r["c"] for r in ch.cast_exact(df, "c").collect()}
    assert got == {1: 34, 2: None, 3: None}
    r = ch.inexact_counts(df, "c").first()
    assert (r["n_rows"], r["n_null"], r["n_whole"], r["n_bad"], r["sum_int"]) == (3, 1, 1, 1, 34)
    with pytest.raises(ValueError):
        ch.cast_exact(df, "c", strict=True)


def test_sink_refuses_duplicate_and_null_keys(spark):
    dup = spark.createDataFrame([(1, 1.0), (1, 2.0)], "id long, pred double")
    with pytest.raises(sinks.SinkCheckError):
        sinks.write_predictions(dup, scratch_path(spark, "dup"), "id")
    nul = spark.createDataFrame([(None, 1.0), (2, 2.0)], "id long, pred double")
    with pytest.raises(sinks.SinkCheckError):
        sinks.write_predictions(nul, scratch_path(spark, "nul"), "id")
    ok = spark.createDataFrame([(1, 1.0), (2, 2.0)], "id long, pred double")
    with pytest.raises(sinks.SinkCheckError):
        sinks.write_predictions(ok, scratch_path(spark, "cnt"), "id", expected_rows=3)
    p = scratch_path(spark, "csv")
    assert sinks.write_predictions(ok, p, "id", fmt="csv")["rows"] == 2


def test_enrich_refuses_duplicate_dimension_key(spark):
    fact = spark.createDataFrame([(1, "a"), (2, "b"), (3, "z")], "id long, k string")
    dim = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    out = fe.enrich(fact, dim, "k")
    assert out.count() == 3 and out.where("v IS NULL").count() == 1
    dup = dim.union(spark.createDataFrame([("a", 9.0)], "k string, v double"))
    with pytest.raises(fe.DimensionKeyError):
        fe.enrich(fact, dup, "k")
    assert ch.orphans(fact, dim, "k").count() == 1


def test_ratio_zero_divisor_is_null(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 2.0), (None, 1.0)], "a double, b double")
    assert [r["r"] for r in fe.ratio(df, "a", "b", "r").collect()] == [None, 0.5, None]


def test_impute_uses_fit_rows_only(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", None), (3, "a", 100.0), (4, "b", None)],
                               "id int, g string, x double")
    fit = df.where("id <> 3")
    got = {r["id"]: (r["x"], r["x_was_null"]) for r in
           fe.impute(df, "x", by="g", fit_on=fit).collect()}
    assert got[2] == (1.0, True)          # median of fit rows of group a
    assert got[4] == (1.0, True)          # group b unseen: global median of fit rows
    assert got[3] == (100.0, False)


def test_qbin_edges_and_one_hot(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 9)], "x double")
    bins = [r["x_bin"] for r in fe.qbin(df, "x", 4).orderBy("x").collect()]
    assert bins == [0, 0, 1, 1, 2, 2, 3, 3]
    c = spark.createDataFrame([("u",), ("v",), (None,)], "c string")
    oh = fe.one_hot(c, "c").collect()
    assert [(r["c_u"], r["c_v"]) for r in oh] == [(1, 0), (0, 1), (0, 0)]
    with pytest.raises(ValueError):
        fe.one_hot(c, "c", max_values=1)


def test_label_index_order(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("c",), ("a",), ("b",)], "c string")
    got = {r["c"]: r["c_idx"] for r in fe.label_index(df, "c").collect()}
    assert got == {"b": 0, "a": 1, "c": 2}


def test_zscore_and_profile(spark):
    from outfold.operators import profile as pr
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 10]], "x double")
    z = [r["x_z"] for r in fe.zscore(df, "x").collect()]
    assert sum(z) == pytest.approx(0.0, abs=1e-12)
    p = pr.profile(df, ["x"]).first()
    assert (p["n_rows"], p["n_distinct"], p["median"], p["q1"], p["q3"]) == (5, 5, 3.0, 2.0, 4.0)
    pa = pr.profile(df, ["x"], exact=False).first()
    assert pa["median"] == 3.0


def test_layout_flow(spark, layout_dir):
    from outfold.sources.layout import layout_report, read_layouts
    df = read_layouts(spark, layout_dir)
    assert dict(df.dtypes)["pack_station_count"] == "int"
    rep = {r["rule"]: r["n_bad"] for r in layout_report(df).collect()}
    assert rep["layout_id_unique"] == 0 and set(rep.values()) == {0}
    assert len(rep) == 2 + 13 + 3 + 16 + 1


def test_corr_matrix_matches_agg(spark):
    from outfold.plans.registry import table
    from outfold.operators import profile as pr
    li = table(spark, "/root/testdata/sf0.01", "lineitem")
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    a = {(r["a"], r["b"]): r["r"] for r in pr.corr_pairs(li, cols).collect()}
    b = {(r["a"], r["b"]): r["r"] for r in pr.corr_pairs(li, cols, method="matrix").collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=1e-9)


def test_holdout_score_one_row(spark):
    from outfold.operators.holdout import holdout_score
    from outfold.plans.catalog import orders_fact
    r = holdout_score(orders_fact(spark, "/root/testdata/sf0.01"), "id", "y", "g").first()
    assert round(r["mae"], 6) == 122980.895302 and r["n_scored"] == 1480


def test_csv_to_parquet(spark, layout_dir):
    out = scratch_path(spark, "layout-pq")
    pq = tables.csv_to_parquet(spark, layout_dir, out, LAYOUT_SCHEMA)
    assert pq.count() == 300 and pq.schema == LAYOUT_SCHEMA


def test_impute_many_columns_and_mean(spark):
    df = spark.createDataFrame(
        [(1, "a", 1.0, None), (2, "a", None, 4.0), (3, "a", 3.0, 6.0), (4, "b", None, None),
         (5, "b", 7.0, 8.0)], "id int, g string, x double, z double")
    got = {r["id"]: (r["x"], r["z"]) for r in fe.impute(df, ["x", "z"], by="g").collect()}
    assert got[2] == (2.0, 4.0) and got[1] == (1.0, 5.0) and got[4] == (7.0, 8.0)
    glob = {r["id"]: (r["x"], r["z"]) for r in fe.impute(df, ["x", "z"]).collect()}
    assert glob[4] == (3.0, 6.0)
    mean = {r["id"]: r["x"] for r in fe.impute(df, ["x"], by="g", stat="mean").collect()}
    assert mean[2] == 2.0 and mean[4] == 7.0


@pytest.mark.parametrize("stat", ["median", "mean"])
def test_impute_out_of_fold(spark, stat):
    import numpy as np
    rows = [(i, "ab"[i % 2], None if i % 5 == 0 else float((i * 7) % 13), i % 3) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, g string, x double, fold long")
    got = {r["id"]: r["x"] for r in fe.impute(df, "x", by="g", stat=stat, fold="fold", k=3).collect()}
    agg = np.median if stat == "median" else np.mean
    for i, g, x, f in rows:
        if x is not None:
            assert got[i] == x
            continue
        grp = [v for (_, gg, v, ff) in rows if gg == g and ff != f and v is not None]
        allv = [v for (_, _, v, ff) in rows if ff != f and v is not None]
        assert got[i] == pytest.approx(agg(grp) if grp else agg(allv))


def test_zscore_out_of_fold_brute_force(spark):
    import numpy as np
    rows = [(i, float((i * 37) % 101), i % 4) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, x double, fold long")
    got = {r["id"]: r["x_z"] for r in fe.zscore(df, "x", fold="fold", k=4).collect()}
    for i, x, f in rows:
        other = np.array([v for (_, v, ff) in rows if ff != f])
        assert got[i] == pytest.approx((x - other.mean()) / other.std(ddof=1), rel=1e-9)


def test_profile_and_corr_default_to_numeric_columns(spark):
    from outfold.operators import profile as pr
    df = spark.createDataFrame([(1, 2.0, "a"), (2, 4.5, "b"), (3, 5.0, "a")], "i int, x double, s string")
    cols = [r["column"] for r in pr.profile(df).collect()]
    assert sorted(cols) == ["i", "x"]
    pairs = [(r["a"], r["b"]) for r in pr.corr_pairs(df).collect()]
    assert pairs == [("i", "x")]
