"""Moments of wide inputs (D8, D17): co-moments of hundreds of columns, per fold.

One aggregate column for each pair of columns makes plans of p * p / 2 columns,
which break at a few hundred. Here a task multiplies blocks of rows with numpy
and adds them up, one matrix a fold, cut into square blocks; blocks of the same
place are joined in a tree, at most ``FAN_IN`` in one task at a time, so no task's
memory grows with the number of partitions. Each part is centred on its own means,
which travel with it, so one scan is enough and no digits are lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outfold.operators.joins import materialize

#: Columns in a block of the matrix, rows multiplied at a time, blocks added in a group.
BLOCK = 128
ROWS = 4096
FAN_IN = 64

_SCHEMA = "fold long, i int, j int, part long, n long, mi binary, mj binary, block binary"


def _cuts(p: int, block: int) -> list[tuple[int, int]]:
    return [(lo, min(p, lo + block)) for lo in range(0, p, block)]


def _join(a: tuple, b: tuple) -> tuple:
    """(rows, means of the block's rows, means of its columns, co-moments) of two
    parts together: nothing is lost by subtracting large sums."""
    n = a[0] + b[0]
    di, dj = b[1] - a[1], b[2] - a[2]
    return (n, a[1] + di * (b[0] / n), a[2] + dj * (b[0] / n), a[3] + b[3] + np.outer(di, dj) * (a[0] * b[0] / n))


def wide_moments(df: DataFrame, cols, fold: str | None = None, block: int = BLOCK,
                 fan_in: int = FAN_IN) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Fold -> (rows, means, population covariances) over rows complete in all
    ``cols`` (no null, NaN or infinity); without ``fold`` all rows are fold 0. A
    fold without a complete row is left out, as are rows without a fold. One scan.
    The driver gets one p x p matrix a fold; a task holds as much, and blocks of
    ``fan_in`` tasks while adding."""
    cols = list(cols)
    p = len(cols)
    cuts = _cuts(p, block)
    f = F.lit(0).cast("long") if fold is None else F.col(f"`{fold}`").cast("long")
    rows = df.select(f.alias("fold"), F.array(*[F.col(f"`{c}`").cast("double") for c in cols]).alias("x")
                     ).where("fold is not null")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        have: dict[int, tuple] = {}
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                s = b.slice(lo, ROWS)
                x = s.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
                whole = np.isfinite(x).all(axis=1)
                folds = s.column("fold").to_numpy()
                for t in np.unique(folds[whole]):
                    own = x[whole & (folds == t)]
                    mean = own.mean(axis=0)
                    own = own - mean
                    new = (len(own), mean, mean, own.T @ own)
                    have[int(t)] = _join(have[int(t)], new) if int(t) in have else new
        for t, (n, mean, _, com) in have.items():
            for i, (a, b) in enumerate(cuts):
                for j, (c, d) in enumerate(cuts[i:], i):
                    yield _row(t, i, j, part, (n, mean[a:b], mean[c:d], com[a:b, c:d]))

    out = materialize(rows.mapInArrow(multiply, _SCHEMA))
    width = 1 + (out.agg(F.max("part")).first()[0] or 0)
    while width > 1:
        out = out.withColumn("up", F.floor(F.col("part") / fan_in)).groupBy("fold", "i", "j", "up").applyInArrow(
            _add, _SCHEMA)
        width = -(-width // fan_in)
    result: dict[int, tuple] = {}
    for r in out.toLocalIterator():
        (a, b), (c, d) = cuts[r["i"]], cuts[r["j"]]
        _, mean, cov = result.setdefault(r["fold"], (r["n"], np.zeros(p), np.zeros((p, p))))
        mean[a:b] = np.frombuffer(r["mi"])
        m = np.frombuffer(r["block"]).reshape(b - a, d - c) / r["n"]
        cov[a:b, c:d] = m
        cov[c:d, a:b] = m.T
    return dict(sorted(result.items()))


def _row(fold: int, i: int, j: int, part: int, state: tuple) -> pa.RecordBatch:
    n, *arrays = state
    return pa.RecordBatch.from_arrays(
        [pa.array([fold], pa.int64()), pa.array([i], pa.int32()), pa.array([j], pa.int32()),
         pa.array([part], pa.int64()), pa.array([n], pa.int64()),
         *(pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in arrays)],
        ["fold", "i", "j", "part", "n", "mi", "mj", "block"])


def _add(t: pa.Table) -> pa.Table:
    """One row from the blocks of a group, joined in the order of their parts."""
    fold, i, j, up = (t.column(c)[0].as_py() for c in ("fold", "i", "j", "up"))
    state = None
    for k in np.argsort(t.column("part").to_numpy()):
        n, mi, mj, block = (t.column(c)[int(k)].as_py() for c in ("n", "mi", "mj", "block"))
        mi, mj = np.frombuffer(mi), np.frombuffer(mj)
        new = (n, mi, mj, np.frombuffer(block).reshape(len(mi), len(mj)))
        state = new if state is None else _join(state, new)
    return pa.Table.from_batches([_row(fold, i, j, up, state)])


def wide_corr(df: DataFrame, cols, block: int = BLOCK) -> DataFrame:
    """(a, b, r): Pearson correlation of every pair of ``cols`` over rows complete
    in all of them; null where a column is constant or there is no such row."""
    cols = list(cols)
    got = wide_moments(df, cols, block=block).get(0)
    p = len(cols)
    if got is None:
        r = np.full((p, p), np.nan)
    else:
        cov = got[2]
        var = np.diag(cov).copy()
        var[var <= 1e-24 * np.maximum(1.0, got[1] ** 2)] = np.nan  # constant but for rounding
        r = cov / np.sqrt(np.outer(var, var))
    rows = [(cols[i], cols[j], None if np.isnan(r[i, j]) else float(r[i, j]))
            for i in range(p) for j in range(i + 1, p)]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")
