"""Gradient-boosted trees with absolute loss for all folds at once (D18).

The k models of a k-fold run are grown together. Features are cut into bins
once and the rows are sorted by them in each part, so rows with equal bins, which
have equal predictions, are seen as one run. A scan adds up the gradients (the
signs of the residuals) and the rows: with few possible combinations of bins
(``CELLS``), once a round by (model, combination), which gives all levels of all k
trees; else once a level by (model, node, feature, bin). A row counts in every
model but its own fold's. What reaches the driver is these sums, bounded by the
parameters whatever the data. One or more further scans a round give the leaves
their values, the median residual of their rows, by mergeable sketches or exactly.

Rows travel in blocks, as bytes: row by row, passing them to Python would cost several
times what is computed. Trees are complete and small; a scan rebuilds the predictions of
its runs from the bins and the trees so far. With many combinations, the predictions are written with
the bins every ``REFRESH`` rounds, so the work of a scan does not grow with the
rounds.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outfold.functions.safe import known
from outfold.operators.folds import check_folds
from outfold.operators.holdout import HOLD_SEED, split_holdout
from outfold.operators.joins import materialize
from outfold.operators.quantiles import SKETCH_K

REFRESH = 8
#: Rows in a block, which a task works on at once.
CHUNK = 1 << 18
#: Up to so many combinations of bins, a round's gradients are added up by combination.
CELLS = 1 << 16
#: Consecutive values of a sorted chunk that stand as one in a sketch; evenly ranked
#: values that two sketches are put together from.
RUN, GRID = 64, 1000
#: Values that an exact median may bring to the driver at the end.
LAST = 100_000


@dataclass
class Boosted:
    """k models over the same bins. ``edges``: the cut points of each feature; a
    value is in bin 1 + (number of cut points below it), 0 if null or NaN.
    ``trees[r]``: (feature, cut, value) of round r, one row a model; nodes in
    level order, a row goes right if its bin is above the cut. ``base``: the
    first prediction of each model, NaN without a training row."""
    xs: list[str]
    edges: list[list[float]]
    base: np.ndarray
    depth: int
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def place(self, tree, model: int, bins: np.ndarray, levels: int) -> np.ndarray:
        """Node of each row (0..2**levels - 1) after ``levels`` splits."""
        feature, cut, _ = tree
        node = np.zeros(len(bins), dtype=np.int64)
        rows = np.arange(len(bins))
        for level in range(levels):
            at = node + (1 << level) - 1
            node = 2 * node + (bins[rows, feature[model, at]] > cut[model, at])
        return node

    def add(self, pred: np.ndarray, model: int, bins: np.ndarray, first: int = 0) -> np.ndarray:
        """``pred`` plus the trees of a model from round ``first`` on."""
        for tree in self.trees[first:]:
            pred = pred + tree[2][model, self.place(tree, model, bins, self.depth)]
        return pred

    def save(self, spark: SparkSession, path: str) -> None:
        """The model as a table of one row per part, for later rows."""
        rows = [("head", -1, json.dumps({"xs": self.xs, "edges": self.edges, "depth": self.depth,
                                         "base": [None if np.isnan(b) else b for b in self.base]}))]
        rows += [("tree", r, json.dumps([a.tolist() for a in t])) for r, t in enumerate(self.trees)]
        spark.createDataFrame(rows, "part string, round int, body string").coalesce(1).write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Boosted:
        rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r["round"])
        head = json.loads(rows[0]["body"])
        base = np.array([np.nan if b is None else b for b in head["base"]])
        trees = []
        for r in rows[1:]:
            f, c, v = json.loads(r["body"])
            trees.append((np.array(f), np.array(c), np.array(v, dtype=float)))
        return Boosted(head["xs"], head["edges"], base, head["depth"], trees)


def _bin(v: np.ndarray, edges: list[float]) -> np.ndarray:
    """Bins of doubles, NaN for unknown ones."""
    return np.where(np.isnan(v), 0, 1 + np.searchsorted(np.array(edges, dtype=float), v)).astype(np.int32)


BLOCK = "f binary, b binary, n binary, y binary"


def _packed(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Blocks of about ``CHUNK`` rows: fold, bins and length of each run, targets."""
    def block() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        f, y_, *bins_ = (rows.column(c).to_numpy() for c in ("__f", "__y", *names))
        new = np.ones(len(f), bool)
        new[1:] = f[1:] != f[:-1]
        for c in bins_:
            new[1:] |= c[1:] != c[:-1]
        head = np.flatnonzero(new)
        runs = np.stack([c[head] for c in bins_], axis=1) if bins_ else np.zeros((len(head), 0))
        cols = [f[head], runs.astype(np.int32), np.diff(np.append(head, len(f))), y_]
        return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cols], ["f", "b", "n", "y"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(h.num_rows for h in held) >= CHUNK:
            yield block()
            held = []
    if any(h.num_rows for h in held):
        yield block()


def _blocks(batches: Iterator[pa.RecordBatch], p: int, k: int):
    """(folds, bins, lengths) of the runs of each block, its targets and, with k
    models, their predictions of each run."""
    for b in batches:
        for i in range(b.num_rows):
            f, bins_, size, y_ = (np.frombuffer(b.column(c)[i].as_buffer(), kind) for c, kind in (
                ("f", np.int64), ("b", np.int32), ("n", np.int64), ("y", np.float64)))
            preds = np.frombuffer(b.column("p")[i].as_buffer(), np.float64).reshape(k, -1) if k else None
            yield f, bins_.reshape(len(f), p), size, y_, preds


def bin_edges(df: DataFrame, xs, bins: int = 32) -> list[list[float]]:
    """Cut points of each column at evenly spaced ranks, from one bounded sketch a
    column; one scan for all."""
    xs = list(xs)
    ranks = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    row = df.agg(*[F.kll_sketch_agg_double(known(c), F.lit(SKETCH_K)).alias(f"s{i}")
                   for i, c in enumerate(xs)], *[F.count(known(c)).alias(f"n{i}") for i, c in enumerate(xs)]
                 ).select(*[F.when(F.col(f"n{i}") > 0, F.kll_sketch_get_quantile_double(f"s{i}", ranks))
                            .alias(f"q{i}") for i in range(len(xs))]).first()
    return [sorted({float(v) for v in q}) if q else [] for q in row]


def fit(df: DataFrame, fold: str, y: str, xs, k: int, rounds: int = 20, depth: int = 3, rate: float = 0.3,
        bins: int = 32, least_rows: int = 20, edges: list[list[float]] | None = None,
        leaf: str = "sketch") -> Boosted:
    """k models; model t is trained on the rows with a fold other than t.

    Splits maximise G_left^2 / n_left + G_right^2 / n_right (G: sum of residual
    signs), ties to the first feature and the lowest cut, with at least
    ``least_rows`` rows on each side; a node without such a split that is better than
    none sends all rows left. Null and NaN features have a bin of their own, the
    lowest. ``edges`` gives the bins' cut points, else ``bin_edges`` does.
    ``leaf``: "sketch" or "exact" medians of the residuals, or "mean": the first
    tree is a regression tree of the target and counts in full, the later ones have
    the means of their rows' signs (of 0: 1) as values. Rows without a fold, with a
    null or NaN target train nothing."""
    if rounds < 0 or depth < 1 or least_rows < 1 or leaf not in ("sketch", "exact", "mean"):
        raise ValueError("need rounds >= 0, depth >= 1, least_rows >= 1 and leaf 'sketch', 'exact' or 'mean'")
    spark, xs = df.sparkSession, list(xs)
    df = df.where(F.col(fold).isNotNull() & known(y).isNotNull())
    edges = bin_edges(df, xs, bins) if edges is None else [sorted(map(float, e)) for e in edges]
    p, width = len(xs), max([len(e) for e in edges], default=0) + 2
    widths = [len(e) + 2 for e in edges]
    names = [f"__b{j}" for j in range(p)]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("__f"), b.column("__y"),
                 *[pa.array(_bin(b.column(n).to_numpy(zero_copy_only=False), e)) for n, e in zip(names, edges)]],
                ["__f", "__y", *names])

    columns = ["__f long", "__y double", *[f"{n} int" for n in names]]
    raw = df.select(F.col(fold).cast("bigint").alias("__f"), known(y).alias("__y"),
                    *[known(x).alias(n) for x, n in zip(xs, names, strict=True)])
    # Dealt evenly, equal bins next to each other, and packed: a row of the table is a
    # block of rows, its runs of equal bins and folds and all its targets.
    data = materialize(raw.mapInArrow(put, ", ".join(columns)).repartition(spark.sparkContext.defaultParallelism)
                       .sortWithinPartitions(*names, "__f").mapInArrow(lambda b: _packed(b, names), BLOCK))
    model = Boosted(xs, edges, np.zeros(k), depth)
    written = 0  # rounds whose predictions are in the table
    cells = math.prod(widths)

    def residuals(batches: Iterator[pa.RecordBatch], m: Boosted, done: int):
        """For each block and model: model, first row and length of each run, which
        runs train it, their bins, and the residuals of all rows."""
        for f, bins_, size, y_, preds in _blocks(batches, p, k if done else 0):
            head = np.cumsum(size) - size
            for t in range(k):
                use = f != t
                if use.any():
                    start = preds[t] if done else np.full(len(f), m.base[t])
                    with np.errstate(invalid="ignore"):
                        yield t, head, size, use, bins_, y_ - np.repeat(m.add(start, t, bins_, done), size)

    def by_fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f, _, size, y_, _ in _blocks(batches, p, 0):
            at, inv = np.unique(f, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), pa.array(np.bincount(inv, np.add.reduceat(y_, np.cumsum(size) - size))),
                 pa.array(np.bincount(inv, size).astype(np.int64))], ["f", "s", "n"])

    def spread(total: np.ndarray, t: int, tree, level: int, bins_: np.ndarray, g: np.ndarray, n: np.ndarray) -> None:
        nodes = 1 << level
        node = model.place(tree, t, bins_, level) * width
        for j in range(p):
            at = node + bins_[:, j]
            total[0, t, :, j] += np.bincount(at, g, nodes * width).reshape(nodes, width)
            total[1, t, :, j] += np.bincount(at, n, nodes * width).reshape(nodes, width)

    def added(shape: tuple, put_in) -> np.ndarray:
        """(2, *shape): gradients and rows, added up by ``put_in`` in each task."""
        m, done, first = model, written, leaf == "mean" and not model.trees

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, *shape))
            for t, head, size, use, bins_, r in residuals(batches, m, done):
                if first:
                    g = np.add.reduceat(r, head)
                elif leaf == "mean":
                    g = 2 * np.add.reduceat(r >= 0, head, dtype=np.int64) - size
                else:
                    g = np.add.reduceat((r > 0).astype(np.int8) - (r < 0).astype(np.int8), head, dtype=np.int64)
                put_in(total, t, bins_[use], g[use], size[use])
            flat = total.reshape(2, -1)
            cell = np.flatnonzero(flat[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell), pa.array(flat[0, cell]), pa.array(flat[1, cell].astype(np.int64))], ["c", "g", "n"])

        got = data.mapInArrow(scan, "c long, g double, n long").groupBy("c").agg(
            F.sum("g").alias("g"), F.sum("n").alias("n")).toArrow()  # bounded by the shape
        out = np.zeros((2, math.prod(shape)))
        at = got.column("c").to_numpy()
        out[0, at], out[1, at] = got.column("g").to_numpy(), got.column("n").to_numpy()
        return out.reshape(2, *shape)

    def round_sums():
        """The sums of one round: a function of tree and level that gives
        (2, k, nodes, features, bins). Gradients do not change within a round, so
        with few possible cells (a bound of the bins, not of the rows) one scan adds
        them up by cell for all levels; else each level is a scan."""
        def shape(level: int) -> tuple:
            return k, 1 << level, p, width

        if cells > CELLS:
            return lambda tree, level: added(shape(level), lambda total, t, bins_, g, n: spread(
                total, t, tree, level, bins_, g, n))

        def by_cell(total, t, bins_, g, n):
            at = np.ravel_multi_index(tuple(bins_.T), widths)
            total[0, t] += np.bincount(at, g, cells)
            total[1, t] += np.bincount(at, n, cells)

        every = added((k, cells), by_cell)
        bins_ = np.stack(np.unravel_index(np.arange(cells), widths), axis=1)

        def of_level(tree, level: int) -> np.ndarray:
            total = np.zeros((2, *shape(level)))
            for t in range(k):
                spread(total, t, tree, level, bins_, every[0, t], every[1, t])
            return total
        return of_level

    def by_leaf(m: Boosted, done: int, tree, levels: int, batches: Iterator[pa.RecordBatch]):
        """(leaf numbered over all models, residuals) of each chunk, training rows only, no NaN."""
        for t, _, size, use, bins_, r in residuals(batches, m, done):
            at = m.place(tree, t, bins_, levels) if levels else np.zeros(len(bins_), np.int64)
            c = np.repeat(np.where(use, at + t * (1 << levels), -1), size)
            keep = (c >= 0) & ~np.isnan(r)
            yield c[keep], r[keep]

    def medians(tree, levels: int) -> np.ndarray:
        """(k, leaves): the median residual of each leaf, NaN without rows."""
        m, done, leaves = model, written, 1 << levels

        def scan(batches):
            return by_leaf(m, done, tree, levels, batches)
        find = _exact_medians if leaf == "exact" else _sketched_medians
        return find(data, scan, k * leaves).reshape(k, leaves)

    nothing = (np.zeros((k, 0), int), np.zeros((k, 0), int), np.zeros((k, 1)))
    part = {r["f"]: (r["s"], r["n"]) for r in data.mapInArrow(by_fold, "f long, s double, n long").groupBy("f").agg(
        F.sum("s").alias("s"), F.sum("n").alias("n")).collect()}  # a row a fold
    if max(part, default=-1) >= k:
        raise ValueError(f"fold {max(part)} is not below {k}")
    if leaf == "mean":
        others = [[part[f] for f in sorted(part) if f != t] for t in range(k)]
        model.base = np.array([sum(s for s, _ in o) / sum(n for _, n in o) if o else np.nan for o in others])
    else:
        model.base = medians(nothing, 0)[:, 0]
    for _ in range(rounds if p else 0):
        inner = (1 << depth) - 1
        feature, cut = np.zeros((k, inner), int), np.full((k, inner), width)
        sums = round_sums()
        for level in range(depth):
            g, n = sums((feature, cut, None), level)
            split = _best_splits(g, n, least_rows)
            at = slice((1 << level) - 1, (1 << (level + 1)) - 1)
            feature[:, at], cut[:, at] = np.where(split[1] < 0, 0, split[0]), np.where(split[1] < 0, width, split[1])
        if leaf == "mean":
            g, n = sums((feature, cut, None), depth)[:, :, :, 0].sum(axis=-1)
            value = np.divide(g, n, out=np.zeros_like(g), where=n > 0) * (rate if model.trees else 1.0)
        else:
            value = rate * np.nan_to_num(medians((feature, cut, None), depth))
        model.trees.append((feature, cut, value))
        # With few cells the trees are cheap to evaluate; predictions are not stored.
        if cells > CELLS and len(model.trees) - written == REFRESH and len(model.trees) < rounds:
            data = _refreshed(data, model, written, k)
            written = len(model.trees)
    return model


def _sketched_medians(data: DataFrame, scan, n: int) -> np.ndarray:
    """The median of each of n groups, (group, values) being what ``scan`` makes of
    batches. Of each ``RUN`` consecutive values of a sorted chunk the middle one
    goes to a sketch, and what is left over to another, so every row counts."""
    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, r in scan(batches):
            order = np.argsort(c.astype(np.int16 if n < 1 << 15 else np.int64), kind="stable")
            c, r = c[order], r[order]
            at, first = np.unique(c, return_index=True)
            out = []
            for g, v in zip(at, np.split(r, first[1:])):
                v = np.sort(v)
                whole = len(v) // RUN * RUN
                out += [(g, 1, v[RUN // 2:whole:RUN]), (g, 0, v[whole:])]
            if out:
                sizes = [len(v) for *_, v in out]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([g for g, *_ in out], sizes)), pa.array(np.repeat([w for _, w, _ in out], sizes)),
                     pa.array(np.concatenate([v for *_, v in out]))], ["c", "w", "r"])

    ranks = F.expr(f"array(0.5D, {', '.join(f'{(i + 0.5) / GRID}D' for i in range(GRID))})")
    got = data.mapInArrow(points, "c long, w long, r double").groupBy("c", "w").agg(
        F.count("r").alias("n"), F.kll_sketch_agg_double("r", F.lit(SKETCH_K)).alias("s")).select(
        "c", "w", "n", F.kll_sketch_get_quantile_double("s", ranks).alias("q")).toArrow()  # two rows a group
    found: dict[int, list] = {}
    for c, w, size, q in zip(*[got.column(x).to_pylist() for x in ("c", "w", "n", "q")]):
        found.setdefault(c, []).append((size * (RUN if w else 1), q))
    out = np.full(n, np.nan)
    for c, parts in found.items():
        if len(parts) == 1:
            out[c] = parts[0][1][0]
            continue
        value = np.concatenate([q[1:] for _, q in parts])
        weight = np.concatenate([np.full(GRID, size / GRID) for size, _ in parts])
        order = np.argsort(value, kind="stable")
        upto = np.cumsum(weight[order])
        out[c] = value[order][np.searchsorted(upto, upto[-1] / 2)]
    return out


_TOP = np.uint64(1 << 63)


def _as_keys(r: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles."""
    bits = (r + 0.0).view(np.uint64)
    return np.where(bits & _TOP, ~bits, bits | _TOP)


def _from_keys(keys: np.ndarray) -> np.ndarray:
    return np.where(keys & _TOP, keys ^ _TOP, ~keys).view(np.float64)


def _exact_medians(data: DataFrame, scan, n: int) -> np.ndarray:
    """The exact median of each of n groups (the mean of the middle two), as above.

    The doubles are ordered as integers. A pass counts the rows of the interval that
    holds the wanted rank in equal parts; the part with the rank is the next
    interval. So the passes are bounded (64 bits), and so is what reaches the
    driver: counts, and at the end the values of the last intervals, ``LAST`` at
    most."""
    parts = 1 << max(4, min(14, ((1 << 20) // n).bit_length() - 1))
    # States 0 and 1: the lower and the upper of the two middle ranks.
    lo, span = np.zeros((2, n), np.uint64), np.full((2, n), (1 << 64) - 1, np.uint64)
    rank = np.zeros((2, n), np.int64)
    inside = None
    while True:
        wide = span > 0
        twin = (lo[0] == lo[1]) & (span[0] == span[1])
        do = np.stack([wide[0], wide[1] & ~twin])
        last = inside is not None and inside[wide].sum() <= LAST
        if not do.any() or last:
            break
        shift = np.array([[max(0, int(v).bit_length() - parts.bit_length() + 1) for v in s] for s in span], np.uint64)

        def counted(batches, lo=lo, span=span, do=do, shift=shift):
            total = np.zeros((2, n * parts), np.int64)
            for c, r in scan(batches):
                u = _as_keys(r)
                for s in range(2):
                    if do[s].any():
                        off = u - lo[s][c]
                        keep = do[s][c] & (off <= span[s][c])
                        at = c[keep] * parts + (off[keep] >> shift[s][c[keep]]).astype(np.int64)
                        total[s] += np.bincount(at, None, n * parts)
            total = total.reshape(-1)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["c", "n"])

        got = data.mapInArrow(counted, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).toArrow()
        count = np.zeros(2 * n * parts, np.int64)
        count[got.column("c").to_numpy()] = got.column("n").to_numpy()
        count = count.reshape(2, n, parts)
        count[1][twin] = count[0][twin]
        if inside is None:
            size = count[0].sum(axis=1)
            inside, rank = np.stack([size, size]), np.stack([(size - 1) // 2, size // 2])
            span[:, size == 0] = 0
        for s, g in zip(*np.nonzero(span > 0)):
            upto = np.cumsum(count[s, g])
            at = int(np.searchsorted(upto, rank[s, g], side="right"))
            rank[s, g] -= upto[at] - count[s, g, at]
            inside[s, g] = count[s, g, at]
            begin = at << int(shift[s, g])
            span[s, g] = min(int(span[s, g]) - begin, (1 << int(shift[s, g])) - 1)
            lo[s, g] += np.uint64(begin)
    if do.any():
        def taken(batches):
            for c, r in scan(batches):
                u = _as_keys(r)
                for s in range(2):
                    keep = do[s][c] & (u - lo[s][c] <= span[s][c])
                    found, times = np.unique(np.stack([c[keep].astype(np.uint64), u[keep]]), axis=1, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found[0].astype(np.int64) + s * n), pa.array((found[1] ^ _TOP).view(np.int64)),
                         pa.array(times.astype(np.int64))], ["c", "u", "n"])

        got = data.mapInArrow(taken, "c long, u long, n long").groupBy("c", "u").agg(F.sum("n").alias("n")).toArrow()
        c, u, times = (got.column(x).to_numpy() for x in ("c", "u", "n"))
        order = np.lexsort((u, c))
        c, u, times = c[order], u[order].view(np.uint64) ^ _TOP, times[order]
        for s, g in zip(*np.nonzero(wide)):
            at = slice(*np.searchsorted(c, [(g if twin[g] else g + s * n), (g if twin[g] else g + s * n) + 1]))
            lo[s, g] = u[at][np.searchsorted(np.cumsum(times[at]), rank[s, g], side="right")]
    low, high = _from_keys(lo[0]), _from_keys(lo[1])
    with np.errstate(invalid="ignore"):
        out = np.where(low == high, low, 0.5 * low + 0.5 * high)
    return out if inside is None else np.where(size > 0, out, np.nan)


def _refreshed(data: DataFrame, m: Boosted, done: int, k: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (f, bins_, _, _, preds) in enumerate(_blocks([b], len(m.xs), k if done else 0)):
                new = np.stack([m.add(preds[t] if done else np.full(len(f), m.base[t]), t, bins_, done)
                                for t in range(k)])
                one = b.slice(i, 1)
                yield pa.RecordBatch.from_arrays(
                    [*[one.column(c) for c in ("f", "b", "n", "y")], pa.array([new.tobytes()], pa.binary())],
                    ["f", "b", "n", "y", "p"])

    return materialize(data.mapInArrow(scan, f"{BLOCK}, p binary"))


def _best_splits(g: np.ndarray, n: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Per (model, node): feature and highest bin that goes left, -1 without a split."""
    left_g, left_n = np.cumsum(g, axis=-1), np.cumsum(n, axis=-1)
    all_g, all_n = left_g[..., -1:], left_n[..., -1:]
    right_g, right_n = all_g - left_g, all_n - left_n
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left_g ** 2 / left_n + right_g ** 2 / right_n
        none = np.where(all_n > 0, all_g ** 2 / all_n, 0)
    gain = np.where((left_n >= least) & (right_n >= least) & (gain > none), gain, -1)
    flat = gain.reshape(*gain.shape[:2], -1)  # first feature, lowest cut first
    at = flat.argmax(axis=-1)
    best = np.take_along_axis(flat, at[..., None], axis=-1)[..., 0]
    return at // gain.shape[-1], np.where(best < 0, -1, at % gain.shape[-1])


def predict(df: DataFrame, model: Boosted, which: Column, out: str = "pred") -> DataFrame:
    """``df`` with the prediction of model number ``which`` of each row; null
    where that is null or such a model has no training row."""
    p = len(model.xs)

    @F.pandas_udf("double")
    def score(which_, *values):
        import pandas as pd
        w = which_.to_numpy(dtype=float, na_value=np.nan)
        x = (np.stack([_bin(v.to_numpy(dtype=float, na_value=np.nan), e) for v, e in zip(values, model.edges)], axis=1)
             if p else np.zeros((len(w), 0), int))
        pred = np.full(len(w), np.nan)
        for t in range(len(model.base)):
            rows = np.flatnonzero(w == t)
            pred[rows] = model.add(np.full(len(rows), model.base[t]), t, x[rows])
        return pd.Series(pred)

    raw = score(which.cast("double"), *[known(x) for x in model.xs])
    return df.withColumn(out, raw).withColumn(out, F.when(~F.isnan(out), F.col(out)))


def oof_boost(df: DataFrame, fold: str = "fold", y: str = "y", xs=("x",), k: int = 5, out: str = "pred",
              **options) -> DataFrame:
    """Out-of-fold boosted trees, the k models grown together; options as in
    ``fit``. Every row is returned; a row without a fold, or whose fold's model
    has no training row, gets a null pred. A fold outside 0..k-1 raises
    ValueError."""
    check_folds(df, fold, k)
    return predict(df, fit(df, fold, y, xs, k, **options), F.col(fold), out)


def holdout_boost(df: DataFrame, key, y: str, xs, parts: int = 10, seed: str = HOLD_SEED,
                  out: str = "pred", **options) -> DataFrame:
    """Rows of the held-out part, predicted by one model of all other rows."""
    flagged = split_holdout(df, key, parts, seed, "__held")
    train = flagged.where("not __held").withColumn("__fold", F.lit(-1))
    model = fit(train, "__fold", y, xs, 1, **options)
    return predict(flagged.where("__held").drop("__held"), model, F.lit(0), out)
