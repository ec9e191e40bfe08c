"""The slice lattice against every slice counted one by one."""

import math
import random
from itertools import combinations

import pytest

from outfold.operators import slices
from outfold.operators.slices import Total, worst_slices

SCHEMA = "a string, b long, c string, d string, y double, pred double"


def rows(n=600, seed=5):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = rng.choice("pqr"), rng.choice([1, 2, None]), rng.choice("xyz")
        err = rng.expovariate(1) * (4 if (a, b) == ("p", None) else 1) * (3 if (b, c) == (2, "x") else 1)
        out.append((a, b, c, f"only-{i}", err, 0.0))
    return out + [("p", 1, "x", None, None, 1.0), ("p", 1, "x", None, float("nan"), 1.0), ("q", 2, "y", "", 3.0, None)]


def brute(rs, names, depth, support, alpha, top):
    at = {"a": 0, "b": 1, "c": 2, "d": 3}
    rs = [r for r in rs if r[4] is not None and r[4] == r[4] and r[5] is not None]
    n, mae = len(rs), sum(abs(r[4] - r[5]) for r in rs) / len(rs)
    found = []
    for size in range(1, depth + 1):
        for cols in combinations(names, size):
            groups = {}
            for r in rs:
                key = tuple((c, None if r[at[c]] is None else str(r[at[c]])) for c in cols)
                groups.setdefault(key, []).append(abs(r[4] - r[5]))
            for key, errs in groups.items():
                s = alpha * (sum(errs) / len(errs) / mae - 1) - (1 - alpha) * (n / len(errs) - 1)
                if len(errs) >= math.ceil(support * n) and s > 0:
                    found.append((s, size, key, len(errs)))
    return sorted(found, key=lambda f: (-f[0], f[1]))[:top]


@pytest.mark.parametrize("depth,support,alpha,top", [(1, 0.01, 0.9, 5), (2, 0.02, 0.95, 8), (3, 0.01, 0.99, 30),
                                                     (3, 0.3, 0.95, 4), (2, 1.0, 0.5, 3)])
def test_against_all_slices(spark, depth, support, alpha, top):
    rs = rows()
    df = spark.createDataFrame(rs, SCHEMA).repartition(7)
    got = worst_slices(df, ["a", "b", "c", "d"], depth=depth, support=support, alpha=alpha, top=top).collect()
    want = brute(rs, ["a", "b", "c", "d"], depth, support, alpha, top)
    assert [(r["level"], tuple(map(tuple, r["slice"])), r["n_rows"]) for r in got] == [w[1:] for w in want]
    assert [r["score"] for r in got] == pytest.approx([w[0] for w in want], abs=1e-6)
    assert [r["rank"] for r in got] == list(range(1, len(got) + 1))


def test_bound_is_never_below_a_part(spark):
    rng = random.Random(2)
    for _ in range(300):
        errs = [rng.expovariate(1) for _ in range(rng.randrange(5, 40))]
        total = Total(200, 1.0, 3, rng.choice([0.5, 0.95, 1.0]))
        limit = total.bound(len(errs), sum(errs), max(errs))
        for _ in range(20):
            part = rng.sample(errs, rng.randrange(3, len(errs) + 1))
            assert total.score(len(part), sum(part)) <= limit + 1e-9


def test_pruning_leaves_slices_out(spark, monkeypatch):
    """With a bar from good single conditions most pairs are never counted."""
    rng = random.Random(1)
    rs = [(rng.choice("pqrstuvw"), rng.randrange(8), "k", "k", 20.0 if i % 4 == 0 else 0.1, 0.0) for i in range(800)]
    rs = [(("z" if r[4] > 1 else r[0]), *r[1:]) for r in rs]
    df = spark.createDataFrame(rs, SCHEMA)
    sizes, extend = [], slices._extend
    monkeypatch.setattr(slices, "_extend", lambda *a: sizes.append(extend(*a)) or sizes[-1])
    got = worst_slices(df, ["a", "b"], depth=2, support=0.01, alpha=0.95, top=1).collect()
    assert [tuple(s) for s in got[0]["slice"]] == [("a", "z")]
    assert len(sizes[0]) < 16  # of 72 pairs


def test_empty_and_wrong_arguments(spark):
    df = spark.createDataFrame(rows(20), SCHEMA)
    assert worst_slices(df.limit(0), ["a"]).count() == 0
    assert worst_slices(df.withColumn("pred", df["y"]), ["a", "b"]).count() == 0  # no error at all
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            worst_slices(df, bad)
    with pytest.raises(ValueError):
        worst_slices(df, ["a"], support=0)
