"""Property tests against brute force on random small tables."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from outfold.operators import oof
from outfold.operators.quantiles import exact_quantiles

SETTINGS = settings(max_examples=12, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])

rows_st = st.lists(
    st.tuples(st.sampled_from(["a", "b", "c", None]),
              st.one_of(st.none(), st.integers(-50, 50).map(float)),
              st.integers(0, 2)),
    min_size=1, max_size=40)


def _frame(spark, rows):
    data = [(i, g, y, f) for i, (g, y, f) in enumerate(rows)]
    return data, spark.createDataFrame(data, "id long, g string, y double, fold long")


def _mean(v):
    v = [x for x in v if x is not None]
    return sum(v) / len(v) if v else None


@SETTINGS
@given(rows=rows_st, m=st.sampled_from([None, 0.0, 3.0]))
def test_oof_encode_matches_brute_force(spark, rows, m):
    data, df = _frame(spark, rows)
    got = {r["id"]: r["p"] for r in oof.oof_encode(df, col="g", k=3, m=m, out="p").collect()}
    for i, g, _, f in data:
        other = [y for (_, _, y, ff) in data if ff != f]
        gm = _mean(other)
        grp = [y for (_, gg, y, ff) in data if ff != f and g is not None and gg == g and y is not None]
        if m is None:
            want = (sum(grp) / len(grp)) if grp else gm
        else:
            want = None if gm is None else (sum(grp) + m * gm) / (len(grp) + m) if (len(grp) + m) else gm
        if want is None:
            assert got[i] is None
        else:
            assert got[i] == pytest.approx(want, rel=1e-9, abs=1e-9)


@SETTINGS
@given(rows=rows_st)
def test_oof_median_matches_brute_force(spark, rows):
    data, df = _frame(spark, rows)
    got = {r["id"]: r["p"] for r in
           oof.oof_median(df, by="g", k=3, method="exact", out="p").collect()}
    for i, g, _, f in data:
        grp = [y for (_, gg, y, ff) in data if ff != f and g is not None and gg == g and y is not None]
        glob = [y for (_, _, y, ff) in data if ff != f and y is not None]
        want = np.median(grp) if grp else (np.median(glob) if glob else None)
        if want is None:
            assert got[i] is None
        else:
            assert got[i] == pytest.approx(want)


@SETTINGS
@given(vals=st.lists(st.integers(-1000, 1000).map(lambda v: v / 8), min_size=1, max_size=60),
       probs=st.lists(st.floats(0, 1), min_size=1, max_size=4),
       work=st.sampled_from([1, 5, 1000]))
def test_exact_quantiles_match_numpy(spark, vals, probs, work):
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = exact_quantiles(df, "x", probs, work=work).first()["q"]
    want = np.quantile(np.array(vals), probs, method="linear")
    assert got == pytest.approx(list(want), rel=1e-12, abs=1e-12)
