"""Harmonic packing of token sequences into training sequences of a fixed size.

Class j holds pieces of more than capacity/(j+1) and at most capacity/j tokens;
each of its sequences takes exactly j pieces, whatever they are, so any worker
can fill sequences of a class without looking at the others. As documents may
be cut anywhere, a document is cut into pieces that fill their class's share
(capacity // j) exactly until at most ``whole`` tokens are left; only these
last pieces leave padding, at most whole**2 / capacity tokens each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outfold.llm.common import Workspace, slices, texts
from outfold.llm.tokens import whole_tokens, worker_words


def cut(n: int, capacity: int, whole: int) -> list[tuple[int, int]]:
    """(length, class) of the pieces of ``n`` tokens, in order."""
    out = [(capacity, 1)] * (n // capacity)
    rest = n % capacity
    while rest:
        j = capacity // rest
        if rest > whole and capacity // j != rest:
            j += 1  # the largest share that the rest fills
        size = min(rest, capacity // j)
        out.append((size, j))
        rest -= size
    return out


def share_out(sizes: dict[int, int], capacity: int) -> dict[int, tuple[int, int]]:
    """First fit decreasing of the classes' unfinished sequences:
    class -> (sequence, offset)."""
    used: list[int] = []
    out = {}
    for j, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        at = next((i for i, u in enumerate(used) if u + size <= capacity), len(used))
        if at == len(used):
            used.append(0)
        out[j] = (at, used[at])
        used[at] += size
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2,
         whole: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids_crc32``,
    ``doc_tokens``, ``sequence_id``, ``offset``, ``class``.

    A document is its text's ids and ``end_id``. Workers cut their documents
    and count the pieces of each class; the counts' prefix sums give every
    piece its number in its class, number // j is its sequence. So at most one
    sequence of a class is not full, at any number of workers; what these hold
    is put together by first fit. The pieces are written before they are
    counted: a lost executor cannot renumber them.

    Null or empty text: one token, ``end_id``. Repeated rows are packed each by
    itself. A null id is kept. Empty table: empty result. Other columns are not
    read.
    """
    if capacity < 2 or not 1 <= whole <= capacity:
        raise ValueError("need capacity >= 2 and 1 <= whole <= capacity")
    spark = docs.sparkSession
    ws = Workspace(spark, "packing")
    proved = spark.sparkContext.broadcast(whole_tokens(tokenizer))  # bounded by the vocabulary
    tail = int(end_id).to_bytes(4, "little")
    names = ["_id", "start", "length", "ids_crc32", "doc_tokens", "class", "_part", "_i"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part, seen = worker_words(tokenizer, proved.value), TaskContext.get().partitionId(), {}
        for b in slices(batches, "_t", 4 << 20):
            out = [[] for _ in names]
            for key, t in zip(b.column("_id").to_pylist(), texts(b.column("_t")), strict=True):
                ids = memoryview(table.encode(t) + tail)
                total, start = len(ids) // 4, 0
                for size, j in cut(total, capacity, whole):
                    i = seen.get(j, 0)
                    seen[j] = i + 1
                    crc = zlib.crc32(ids[4 * start:4 * (start + size)])
                    for col, v in zip(out, (key, start, size, crc, total, j, part, i), strict=True):
                        col.append(v)
                    start += size
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], b.column("_id").type), *(pa.array(c, pa.int64()) for c in out[1:])],
                names)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t"))
    pieces = ws.save(rows.mapInArrow(
        run, f"_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
             "class long, _part long, _i long"), "pieces")
    # One row per (worker, class).
    counts = pieces.groupBy("_part", "class").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("class").orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    counts = ws.save(counts.withColumn("_n0", F.coalesce(F.sum("_n").over(before), F.lit(0))),
                     "counts")
    # One row per class, at most ``capacity`` of them.
    total = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("_n").alias("n")).collect()}
    numbered = ws.save(pieces.join(counts.drop("_n"), ["_part", "class"])
                       .withColumn("_k", F.col("_n0") + F.col("_i")).drop("_part", "_i", "_n0"),
                       "numbered")
    limits = spark.createDataFrame([(j, n // j * j) for j, n in total.items()],
                                   "class long, _full long")
    rest = numbered.join(F.broadcast(limits), "class").where("_k >= _full").groupBy("class").agg(
        F.sum("length").alias("size"))
    plan, base = [], 0
    for j, n in sorted(total.items()):
        plan.append([j, n // j * j, base])
        base += n // j
    tails = share_out({r["class"]: r["size"] for r in rest.collect()}, capacity)
    plan = [(j, full, first, *(tails.get(j, (0, 0)))) for j, full, first in plan]
    places = spark.createDataFrame(
        [(j, full, first, base + seq, at) for j, full, first, seq, at in plan],
        "class long, _full long, _base long, _tail long, _at long")
    # A full sequence of class j has j pieces, a tail has fewer.
    inside = Window.partitionBy("class", F.expr("_k div class")).orderBy("_k").rowsBetween(
        Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(inside), F.lit(0))
    tail = F.col("_k") >= F.col("_full")
    return numbered.withColumn("offset", offset).join(F.broadcast(places), "class").select(
        F.col("_id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens",
        F.when(tail, F.col("_tail")).otherwise(F.col("_base") + F.expr("_k div class"))
        .alias("sequence_id"),
        (F.col("offset") + F.when(tail, F.col("_at")).otherwise(0)).alias("offset"), "class")
