"""Nearest neighbours by an inverted multi-index.

A vector is cut into two halves and each half is quantised with a codebook of
its own, so a vector lies in one of ``codes ** 2`` cells. For a query, pairs of
centroids are visited in order of their summed nearness with a heap until the
visited cells hold enough vectors; these are ranked again with the exact inner
product in double precision. A query travels to a bucket of cells with one bit for
each of them, so that the task ranks the cells that were visited, whatever way
their sums were rounded.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outfold.llm.anchors import mix
from outfold.llm.common import Workspace

#: Codebooks are fitted on at most about this many vectors (hash sample).
SAMPLE = 20_000
#: Vectors that one task ranks at once: small cells are put together up to this
#: number, larger ones are split.
BUCKET_ROWS = 4096
#: Queries that one task ranks at once.
QUERY_ROWS = 256
#: Queries that meet a bucket in one group, about; for more, the bucket is
#: repeated once for each block of so many queries.
QUERY_BLOCK = 8192
#: Side of the squares of centroid pairs that the heap holds.
SIDE = 16


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Lloyd's algorithm on a bounded sample; deterministic."""
    x = np.unique(x, axis=0)
    if len(x) <= k:
        return x
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (((c ** 2).sum(1))[None] - 2 * x @ c.T).argmin(1)


def visit(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, want: int, side: int = SIDE
          ) -> tuple[np.ndarray, float]:
    """The non-empty cells (i * len(b) + j) with the largest a[i] + b[j] that
    together hold ``want`` vectors, and the smallest of their sums.

    Both lists are sorted; a heap pops squares of ``side`` x ``side``
    neighbouring pairs by the sum at their best corner, until no square that is
    left can hold a better pair than those found."""
    ia, ib = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
    a, b, n = a[ia], b[ib], len(b)
    heap, seen = [(-(a[0] + b[0]), 0, 0)], {(0, 0)}
    sums, cells, got, least = [], [], 0, -np.inf
    while heap and (got < want or -heap[0][0] > least):
        _, i, j = heapq.heappop(heap)
        for k, m in ((i + side, j), (i, j + side)):
            if k < len(a) and m < n and (k, m) not in seen:
                seen.add((k, m))
                heapq.heappush(heap, (-(a[k] + b[m]), k, m))
        cell = (ia[i:i + side, None] * n + ib[None, j:j + side]).ravel()
        full = sizes[cell] > 0
        cells.append(cell[full])
        sums.append(np.add.outer(a[i:i + side], b[j:j + side]).ravel()[full])
        short = got < want
        got += int(sizes[cell].sum())
        if short and got >= want:
            least = _cut(np.concatenate(sums), sizes[np.concatenate(cells)], want)
    sums, cells = np.concatenate(sums), np.concatenate(cells)
    least = _cut(sums, sizes[cells], want)
    return cells[sums >= least], least


def _cut(sums: np.ndarray, sizes: np.ndarray, want: int) -> float:
    order = np.argsort(-sums)
    held = np.cumsum(sizes[order])
    return float(sums[order[min(len(order) - 1, int(np.searchsorted(held, want)))]])


def usable(vec: str):
    """Vectors that take part: not null, not empty, all components finite, not
    all zero."""
    v = F.col(vec)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)


def search(vectors: DataFrame, query: object, top: int = 20, codes: int = 256, share: float = 0.4,
           least: int = 2000, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), id and ``score`` of the ``top`` nearest
    found for each query.

    ``query`` is a condition on ``vectors`` that says which rows are queries;
    every other row than the query's own is a candidate. At least
    ``max(least, share * all)`` vectors are ranked for each query. Vectors that
    are null, empty, zero, hold a null or non-finite component, or have not the
    commonest dimension take no part, neither as query nor as candidate; the
    same holds for a null id. Ties go to the smaller id. Repeated rows of one
    id are candidates each, except for the query of that id; query rows of one id
    are answered each, with ranks of their own. No usable vector:
    empty result. Other columns are not read.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "multiindex")
    rows = vectors.withColumn("_query", F.coalesce(query, F.lit(False))).where(
        usable(vec_col) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("_id"),
        F.col(vec_col).cast("array<double>").alias("_v"), "_query")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double"
                                  ).withColumnRenamed("vec_id", id_col)
    dims = rows.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return empty
    d, total = dims["d"], dims["count"]
    rows = rows.where(F.size("_v") == d)
    if d < 2:  # one component cannot be halved: put a zero beside it
        rows, d = rows.withColumn("_v", F.concat("_v", F.array(F.lit(0.0)))), 2
    grid = 1 << 30
    sample = rows.where(F.pmod(F.xxhash64("_id"), F.lit(grid)) <=
                        int(min(1.0, SAMPLE / total) * grid)).select("_v")
    x = sample.toArrow().column("_v").combine_chunks().flatten().to_numpy().reshape(-1, d)
    if not len(x):
        x = np.array([r["_v"] for r in rows.select("_v").limit(1).collect()])
    h = d // 2
    left, right = kmeans(x[:, :h], codes), kmeans(x[:, h:], codes)
    books = spark.sparkContext.broadcast((left, right))  # 2 * codes centroids

    def matrix(col: pa.Array) -> np.ndarray:
        return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = books.value
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column("_v"))
                cell = nearest(v[:, :h], a) * len(b) + nearest(v[:, h:], b)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell, pa.int64())], ["_id", "_v", "_query", "_cell"])

    index = ws.save(rows.mapInArrow(place, "_id long, _v array<double>, _query boolean, _cell long"),
                    "index")
    sizes = np.zeros(len(left) * len(right), dtype=np.int64)  # codes**2 numbers
    counts = index.groupBy("_cell").agg(F.count(F.lit(1)).alias("count"),
                                        F.count_if("_query").alias("queries")).toArrow()
    sizes[counts.column("_cell").to_numpy()] = counts.column("count").to_numpy()
    blocks = max(1, -(-int(counts.column("queries").to_numpy().sum()) // QUERY_BLOCK))
    want = max(least, int(share * total))
    # Cells in order are cut into buckets of about BUCKET_ROWS vectors; a cell
    # that is larger has several buckets of its own.
    parts = np.maximum(1, -(-sizes // BUCKET_ROWS))
    whole = np.cumsum(np.where(parts > 1, 0, sizes)) // BUCKET_ROWS
    extra = np.cumsum(np.where(parts > 1, parts, 0)) - np.where(parts > 1, parts, 0)
    base = np.where(parts > 1, whole[-1] + 1 + extra, whole)
    # The full cells of a bucket have one bit each, in whole bytes a bucket: at
    # most 2 * BUCKET_ROWS bits. The parts of a large cell all have its one bit.
    full = np.flatnonzero(sizes)
    home = base[full]
    order = np.argsort(home, kind="stable")
    held_by = np.bincount(home, minlength=int((base + parts).max()))
    ends = np.concatenate([[0], np.cumsum(-(-np.maximum(held_by, 1) // 8))])
    nth = np.arange(len(full)) - (np.cumsum(held_by) - held_by)[home[order]]
    slot = np.zeros(len(sizes), dtype=np.int64)
    slot[full[order]] = 8 * ends[home[order]] + nth
    known = spark.sparkContext.broadcast((sizes, base, parts, slot, ends))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = books.value
        held, first, n, slot, ends = known.value
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix(batch.column("_v"))
            near_a, near_b = v[:, :h] @ a.T, v[:, h:] @ b.T
            take, bucket, bits = [], [], []
            for i in range(len(v)):
                cells, _ = visit(near_a[i], near_b[i], held, want)
                mark = np.zeros(8 * int(ends[-1]), dtype=bool)
                mark[slot[cells]] = True
                packed = np.packbits(mark).tobytes()
                go = np.unique(first[cells])
                big = cells[n[cells] > 1]
                go = np.union1d(go, np.concatenate([np.empty(0, np.int64), *(
                    first[c] + np.arange(n[c]) for c in big)]))
                take += [i] * len(go)
                bucket += go.tolist()
                bits += [packed[ends[k]:ends[k + 1]] for k in go]
            pick = pa.array(take, pa.int64())
            block = (mix(batch.column("_id").to_numpy().view(np.uint64)) % np.uint64(blocks)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").take(pick), batch.column("_row").take(pick), batch.column("_v").take(pick),
                 pa.array(bucket, pa.int64()), pa.array(block[take], pa.int64()), pa.array(bits, pa.binary())],
                ["_id", "_row", "_v", "_bucket", "_block", "_cells"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, first, n, _, _ = known.value
        for batch in batches:
            cell = batch.column("_cell").to_numpy()
            spread = mix(batch.column("_id").to_numpy().view(np.uint64)) % n[cell].astype(np.uint64)
            bucket = pa.array(first[cell] + spread.astype(np.int64))
            for k in range(blocks):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id"), batch.column("_v"), batch.column("_cell"), bucket,
                     pa.array(np.full(len(cell), k))], ["_id", "_v", "_cell", "_bucket", "_block"])

    # Rows of one query id are searched for apart.
    queries = index.where("_query").select(
        "_id", F.monotonically_increasing_id().alias("_row"), "_v").repartition(
        spark.sparkContext.defaultParallelism).mapInArrow(
        route, "_id long, _row long, _v array<double>, _bucket long, _block long, _cells binary")
    entries = index.select("_id", "_v", "_cell").mapInArrow(
        deal, "_id long, _v array<double>, _cell long, _bucket long, _block long")

    def rank(q: pa.Table, e: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("_row", pa.int64()), ("vec_id", pa.int64()),
                            ("score", pa.float64())])
        if not q.num_rows or not e.num_rows:
            return schema.empty_table()
        _, first, n, slot, ends = known.value
        qv, ev = (t.column("_v").combine_chunks().flatten().to_numpy().reshape(-1, d) for t in (q, e))
        qid, eid = (t.column("_id").to_numpy() for t in (q, e))
        row = q.column("_row").to_numpy()
        cell = e.column("_cell").to_numpy()
        # a part of a large cell is sent to only if the cell is visited
        bit = None if n[cell[0]] > 1 else slot[cell] - 8 * ends[first[cell[0]]]
        bits = q.column("_cells")
        out = []
        for lo in range(0, len(qid), QUERY_ROWS):
            ids, v = qid[lo:lo + QUERY_ROWS], qv[lo:lo + QUERY_ROWS]
            meant = ids[:, None] != eid[None]
            if bit is not None:
                sent = b"".join(bits.slice(lo, QUERY_ROWS).to_pylist())
                sent = np.frombuffer(sent, dtype=np.uint8).reshape(len(ids), -1)
                meant &= np.unpackbits(sent, axis=1)[:, bit].astype(bool)
            score = np.where(meant, v @ ev.T, -np.inf)
            for i in range(len(ids)):
                s = score[i]
                bar = np.partition(s, len(s) - top)[len(s) - top] if len(s) > top else -np.inf
                near = np.flatnonzero((s >= bar - 1e-9 * max(1.0, abs(bar)) if np.isfinite(bar) else
                                       s > -np.inf))
                # summed component by component: equal vectors get equal scores
                exact = np.zeros(len(near))
                for k in range(d):
                    exact += v[i, k] * ev[near, k]
                best = np.lexsort((eid[near], -exact))[:top]
                out.append((np.full(len(best), ids[i]), np.full(len(best), row[lo + i]), eid[near[best]],
                            exact[best]))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)],
                                    schema=schema)

    found = queries.groupBy("_bucket", "_block").cogroup(entries.groupBy("_bucket", "_block")).applyInArrow(
        rank, "query_id long, _row long, vec_id long, score double")
    order = Window.partitionBy("query_id", "_row").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("query_id", "rank", F.col("vec_id").alias(id_col), "score"))
