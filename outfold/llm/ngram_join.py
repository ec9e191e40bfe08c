"""Jaccard join of documents on word n-grams, in size-banded tiles.

A link at ``percent`` needs sets whose sizes differ by no more than that ratio.
Sizes are cut into bands so wide that linked sets lie in one band or in two
neighbouring ones. It also needs a shared shingle among the first of each set in
any order that is the same for all, as many as may be missing plus one; here
shingles that many sets hold come last. A *tile* is one such shingle and one band:
its members are the sets of the band and of the band below that hold the
shingle among their first. All links lie inside tiles, so no pair is lost.

Inside a tile hashed bitmaps go first: every bit in which two bitmaps differ
stands for a shingle that only one of the sets has, so the common shingles are
at most (|A| + |B| - differing bits) / 2. Pairs whose bound reaches the threshold
are decided by intersecting the sorted sets.

Texts with equal sets are one member. Each member is compared with the smallest
one of its tiles first; tiles whose members are then one component need nothing
more. The others are compared in blocks, by bitmaps alone first; only sets that may
still be linked to one of another component travel. Where the tiles of a group overlap so much that the group as a whole
has fewer pairs, the group is compared instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outfold.llm.common import Workspace, bit_filter, blobs, slices
from outfold.llm.components import components
from outfold.llm.minhash import Shingler

#: Bits of a bitmap, by the size band: two to four for each shingle, within these.
LEAST_BITS, MOST_BITS = 256, 1 << 16
#: Sets, and shingles in them, that one task compares with as many others.
BLOCK, BLOCK_SHINGLES = 512, 1 << 19
#: Shingles known as common, at most (16 MB with their counts), and how many sets
#: of a batch must hold one for the batch to count it.
COMMON, LOCAL = 1 << 20, 4


def band_edges(percent: int) -> np.ndarray:
    """Smallest size of each band. A set linked to one of band i is in i - 1, i or i + 1."""
    edges = [1]
    while edges[-1] < 1 << 31 and percent < 100:
        edges.append(max(edges[-1] + 1, -(-edges[-1] * 100 // percent)))
    return np.array(edges)


def prefix_size(n, percent: int):
    """How many shingles of a set hold one of every linked set's, in any order."""
    return n - (n * percent + 99) // 100 + 1


def width_of(size: int) -> int:
    """Bits for sets of up to ``size`` shingles."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (2 * int(size) - 1).bit_length()))


def bitmap(shingles: np.ndarray, bits: int) -> np.ndarray:
    """Each shingle (a hash) sets one bit; as 64-bit words."""
    out = np.zeros(bits, dtype=bool)
    out[(shingles >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)] = True
    return np.packbits(out).view(np.uint64)


def _bound(a: str, b: str, x: str, y: str) -> Column:
    """Most common shingles of two sets of sizes a and b with bitmaps x and y."""
    return F.expr(f"({a} + {b} - aggregate(zip_with({x}, {y}, (p, q) -> bit_count(p ^ q)), 0, "
                  f"(s, c) -> s + c)) div 2")


def _reaches(common, a, b, percent: int):
    return 100 * common >= percent * (a + b - common)


def jaccard_join(docs: DataFrame, words: int = 4, percent: int = 85, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """id, ``n_shingles`` and ``component_id`` of each document.

    Two documents are linked if 100 * |A & B| >= ``percent`` * |A | B| for
    their sets of ``words``-word shingles (A-Z lower-cased, words between ASCII
    blanks; fewer words: the whole sequence is one shingle). ``component_id`` is
    the smallest id that can be reached by links, the document's own included.
    Links are decided on whole sets, of 64-bit hashes of shingles.

    Null, empty or blank text: no shingle, linked with nothing. Ids are whole
    numbers. Rows with one id are documents of their own, linked or not by their
    texts. Null ids link like others but are nobody's component; without any
    other id around, the component is null. Empty table: empty result. Other
    columns are not read.
    """
    if not 1 <= percent <= 100 or words < 1:
        raise ValueError("need 1 <= percent <= 100 and words >= 1")
    spark = docs.sparkSession
    ws = Workspace(spark, "ngrams")
    edges = band_edges(percent)
    # The width of band i, whose sets are below its upper edge; and of one more.
    widths = [LEAST_BITS, *[width_of(e) for e in edges[1:]], MOST_BITS, MOST_BITS]

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_x"), text.alias("_t"))
    common = spark.sparkContext.broadcast(_common(rows, words, ws))

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for b in slices(batches, "_t", 2 << 20):
            sets = [shingles(t) for t in blobs(b.column("_t"))]
            n = np.array([len(x) for x in sets])
            band = np.searchsorted(edges, n, side="right")
            own = [bitmap(x, widths[k]) for x, k in zip(sets, band)]
            up = [bitmap(x, widths[k + 1]) if widths[k + 1] > widths[k] else None
                  for x, k in zip(sets, band)]
            first = [_prefix(x, common.value, percent) for x in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), b.column("_x"), pa.array(n, pa.int64()),
                 pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets], pa.binary()),
                 pa.array(band, pa.int64()), _lists(np.concatenate(own), np.array([len(x) for x in own])),
                 pa.array([None if x is None else x.view(np.int64) for x in up], pa.list_(pa.int64())),
                 _lists(np.concatenate(first), np.array([len(x) for x in first]))],
                ["_id", "_x", "_n", "_key", "_band", "_bits", "_up", "_first"])

    signed = ws.save(rows.mapInArrow(
        rarest, "_id long, _x long, _n long, _key binary, _band long, _bits array<bigint>, "
        "_up array<bigint>, _first array<bigint>"), "signed")
    # One representative of each set, numbered in the written table.
    reps = ws.save(
        signed.where("_key is not null").groupBy("_key").agg(
            F.min("_id").alias("_least"), F.min(F.struct("_id", "_x")).alias("_at"),
            *[F.first(c).alias(c) for c in ("_n", "_band", "_bits", "_up", "_first")])
        .withColumn("_v", F.monotonically_increasing_id()), "reps")
    common.unpersist()

    # Tiles: (shingle, band) with the sets of that band and of the one below.
    cells = reps.select("_v", "_n", "_band", F.explode("_first").alias("_w"))
    shared = ws.save(cells.groupBy("_w").agg(F.count("*").alias("_c")).where("_c > 1").select("_w"),
                     "shared")
    cells = ws.save(cells.hint("merge").join(shared, "_w", "left_semi"), "cells")
    placed = cells.withColumn("_home", F.lit(True)).unionAll(
        cells.select("_w", "_v", "_n", F.col("_band") + 1, F.lit(False)))
    heads = ws.save(placed.groupBy("_w", "_band").agg(
        F.min(F.when(F.col("_home"), F.struct("_n", "_v"))).alias("_lead"),
        F.count("*").alias("_c")).where("_c > 1 and _lead is not null")
        .select("_w", "_band", F.col("_lead._v").alias("_lead")), "heads")
    tiles = ws.save(placed.hint("merge").join(heads, ["_w", "_band"])
                    .select("_w", "_band", "_v", "_home", "_lead"), "tiles")

    # Every member with its tile's smallest set: bitmaps, then the sets themselves.
    pairs = tiles.where("_v <> _lead").select("_v", "_lead").distinct()
    marks = reps.select("_v", "_n", "_bits", "_up")
    lead = reps.select(F.col("_v").alias("_lead"), F.col("_n").alias("_m"), F.col("_bits").alias("_lbits"))
    near = ws.save(
        pairs.join(marks, "_v").join(lead, "_lead")
        .withColumn("_bits", F.when(F.size("_bits") == F.size("_lbits"), F.col("_bits")).otherwise(F.col("_up")))
        .where(_reaches(_bound("_n", "_m", "_bits", "_lbits"), F.col("_n"), F.col("_m"), percent))
        .select("_v", "_lead", "_n", "_m"), "near")
    sets = _sets(rows, words, reps, near.select("_v").unionAll(near.select("_lead")), ws)
    lead = sets.select(F.col("_v").alias("_lead"), F.col("_set").alias("_lset"))
    links = ws.save(
        near.join(sets, "_v").join(lead, "_lead")
        .where(_reaches(F.size(F.array_intersect("_set", "_lset")), F.col("_n"), F.col("_m"), percent))
        .select(F.col("_v").alias("a"), F.col("_lead").alias("b")), "links")

    more = _open_units(ws, tiles, rows, words, reps, links, percent)
    final = components(links if more is None else links.unionAll(more), ws)
    of_set = ws.save(reps.select("_key", "_v", "_least").join(
        final.withColumnRenamed("id", "_v"), "_v", "left").select(
        "_key", "_least", F.coalesce("component", "_v").alias("_c")), "classes")
    least = of_set.groupBy("_c").agg(F.min("_least").alias("_component"))
    of_key = ws.save(of_set.join(least, "_c").select("_key", "_component"), "of-key")
    return signed.select("_id", "_n", "_key").join(of_key, "_key", "left").select(
        F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"),
        F.when(F.col("_key").isNull(), F.col("_id")).otherwise(F.col("_component")).alias("component_id"))


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _flat(col: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column and where each list ends."""
    ends = col.offsets.to_numpy().astype(np.int64)
    return col.values.to_numpy()[ends[0]:ends[-1]].view(np.uint64), ends - ends[0]


def _common(rows: DataFrame, words: int, ws: Workspace) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many sets hold, with counts; sorted, at most ``COMMON``.

    A task counts a shingle if several of its sets hold it, so the counts are a
    little low. They only put the shingles in order; links do not depend on it."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[bytes] = set()

        def flush() -> pa.RecordBatch:
            w, c = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            seen.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(w[c >= LOCAL].view(np.int64)), pa.array(c[c >= LOCAL])], ["_w", "_c"])

        shingles, size = Shingler(words), 0
        for b in slices(batches, "_t", 2 << 20):
            for t in blobs(b.column("_t")):
                key = xxhash.xxh3_128_digest(t)
                if key not in seen:  # copies are one set
                    seen.add(key)
                    held.append(shingles(t))
                    size += len(held[-1])
            if size > 1 << 21:
                yield flush()
                size = 0
        if held:
            yield flush()

    counts = ws.save(rows.select("_t").mapInArrow(count, "_w long, _c long").groupBy("_w").agg(
        F.sum("_c").alias("_c")).where("_c >= 64"), "common")
    # The least power of two that leaves few enough.
    steps = counts.groupBy(F.floor(F.log2("_c")).cast("int").alias("_p")).agg(F.count("*").alias("_k"))
    least, total = 64, 0
    for p, k in sorted(((r["_p"], r["_k"]) for r in steps.collect()), reverse=True):
        total += k
        if total > COMMON:
            least = max(least, 2 << p)
            break
    t = counts.where(F.col("_c") >= least).toArrow()
    w, c = t.column("_w").to_numpy().view(np.uint64), t.column("_c").to_numpy()
    order = np.argsort(w)
    return w[order], c[order]


def _prefix(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray], percent: int) -> np.ndarray:
    """The first shingles of a set: uncommon ones by hash, then common ones by count."""
    n = prefix_size(len(shingles), percent)
    w, c = common
    if len(w):
        at = np.minimum(np.searchsorted(w, shingles), len(w) - 1)
        hot = w[at] == shingles
        few = shingles[~hot]
        if len(few) < n:
            more = shingles[hot]
            few = np.concatenate([few, more[np.lexsort((more, c[at[hot]]))]])
        shingles = few
    return shingles[:n]


def _sets(rows: DataFrame, words: int, reps: DataFrame, wanted: DataFrame, ws: Workspace) -> DataFrame:
    """(_v, _set) of the sets asked for (first column of ``wanted``), from the
    texts. A table of bits, bounded in size, keeps most others out of the shuffle."""
    keys = ws.save(reps.select("_v", F.col("_at._id").alias("_wid"), F.col("_at._x").alias("_wx"))
                   .join(wanted.toDF("_v").distinct(), "_v", "left_semi"), "wanted")
    may = bit_filter(keys.select(F.xxhash64("_wid", "_wx").alias("_h")), "_h")
    rows = rows.withColumn("_h", F.xxhash64("_id", "_x"))
    rows = rows.mapInArrow(may, rows.schema)

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for b in slices(batches, "_t", 2 << 20):
            sets = [shingles(t) for t in blobs(b.column("_t"))]
            yield pa.RecordBatch.from_arrays(
                [b.column("_v"), _lists(np.concatenate(sets), np.array([len(x) for x in sets]))],
                ["_v", "_set"])

    return ws.save(rows.hint("merge").join(keys, F.col("_x").eqNullSafe(F.col("_wx")) &
                                           F.col("_id").eqNullSafe(F.col("_wid")))
                   .dropDuplicates(["_wx", "_wid"]).select("_v", "_t")
                   .mapInArrow(shingle, "_v long, _set array<bigint>"), "sets")


def _open_units(ws: Workspace, tiles: DataFrame, rows: DataFrame, words: int, reps: DataFrame,
                links: DataFrame, percent: int) -> DataFrame | None:
    """Links found by comparing the members of tiles that are not one component
    yet; None if there is no such tile."""
    part = components(links, ws).select(F.col("id").alias("_v"), F.col("component").alias("_part"))
    parts = ws.save(reps.select("_v", "_n").join(part, "_v", "left").select(
        "_v", "_n", F.coalesce("_part", "_v").alias("_part")), "parts")
    # The smallest member has met all others, so only these others count. Tiles
    # with the same members (two sums of hashes) are one.
    other = F.when(F.col("_v") != F.col("_lead"), F.col("_part"))
    wide = tiles.join(parts, "_v").groupBy("_w", "_band").agg(
        F.min(other).alias("_p"), F.max(other).alias("_q"), F.count("*").alias("_c"),
        F.sum(F.shiftright(F.xxhash64("_v"), 24)).alias("_s1"),
        F.sum(F.shiftright(F.xxhash64("_v", F.lit(1)), 24)).alias("_s2")).where("_p <> _q")
    units = ws.save(wide.groupBy("_c", "_s1", "_s2").agg(F.min(F.struct("_w", "_band")).alias("_u"))
                    .select("_u._w", "_u._band"), "open")
    if units.isEmpty():
        return None
    # Bitmaps first: only members that may be linked to one of another component stay.
    members = tiles.join(units, ["_w", "_band"])
    deal = members.groupBy("_w", "_band").agg(F.count("*").alias("_c")).select(
        "_w", "_band", F.expr(f"cast((_c + {BLOCK - 1}) div {BLOCK} as int)").alias("_blocks"))
    dealt = _block_pairs(members.join(ws.save(deal, "deal"), ["_w", "_band"]).join(parts, "_v").join(
        reps.select("_v", "_bits", "_up"), "_v").withColumn("_bits", F.when(
            F.col("_home"), F.col("_bits")).otherwise(F.coalesce("_up", "_bits"))),
        "_w", "_band", "_n", "_part", "_bits")

    def bound(table: pa.Table) -> pa.Table:
        return sift(table.combine_chunks(), percent)

    members = ws.save(dealt.groupBy("_w", "_band", "_x", "_y").applyInArrow(
        bound, "_w long, _band long, _v long").distinct().select(F.struct("_w", "_band").alias("_tile"), "_v"),
        "members")
    if members.isEmpty():
        return None
    lead = ws.save(members.groupBy("_tile").agg(F.min("_v").alias("_lead"), F.count("*").alias("_c")), "leads")
    group = ws.save(components(members.join(lead, "_tile").select(
        F.col("_v").alias("a"), F.col("_lead").alias("b")), ws)
        .select(F.col("id").alias("_v"), F.col("component").alias("_group")), "groups")
    # A group goes as a whole where that means fewer pairs than its tiles have.
    of_tile = lead.join(group.withColumnRenamed("_v", "_lead"), "_lead").groupBy("_group").agg(
        F.sum(F.col("_c").cast("double") * F.col("_c")).alias("_tiles"))
    size = group.groupBy("_group").agg(F.count("*").alias("_g"))
    whole = ws.save(of_tile.join(size, "_group").select(
        "_group", (F.col("_g").cast("double") * F.col("_g") <= F.col("_tiles")).alias("_whole")), "whole")
    kind = ws.save(group.join(whole, "_group"), "kinds")
    none = F.lit(None).cast(members.schema["_tile"].dataType)
    dealt = kind.where("_whole").select(none.alias("_tile"), "_group", "_v").unionAll(
        members.join(kind.where("not _whole"), "_v").select(
            "_tile", F.lit(None).cast("long").alias("_group"), "_v"))
    dealt = ws.save(dealt.join(parts, "_v"), "dealt")
    sets = _sets(rows, words, reps, dealt.select("_v"), ws)
    blocks = ws.save(dealt.groupBy("_tile", "_group").agg(
        F.count("*").alias("_c"), F.sum("_n").alias("_all")).select(
        "_tile", "_group", F.expr(f"cast(greatest((_c + {BLOCK - 1}) div {BLOCK}, "
                                  f"(_all + {BLOCK_SHINGLES - 1}) div {BLOCK_SHINGLES}) as int)")
        .alias("_blocks")), "blocks")
    b = blocks.withColumnsRenamed({"_tile": "_bt", "_group": "_bg"})
    dealt = _block_pairs(
        dealt.join(b, F.col("_tile").eqNullSafe(F.col("_bt")) & F.col("_group").eqNullSafe(F.col("_bg")))
        .join(sets, "_v").withColumn("_u", F.coalesce("_tile._w", "_group"))
        .withColumn("_band", F.coalesce("_tile._band", F.lit(-1))), "_u", "_band", "_part", "_set")

    def compare(table: pa.Table) -> pa.Table:
        return joining_edges(table.combine_chunks(), percent)

    return ws.save(dealt.groupBy("_u", "_band", "_x", "_y").applyInArrow(compare, "a long, b long"), "more")


def _block_pairs(members: DataFrame, *columns: str) -> DataFrame:
    """Block pairs (x <= y): a member of block k goes to all pairs that hold k."""
    return members.withColumn("_k", F.pmod(F.xxhash64("_v", F.lit(5)), F.col("_blocks")).cast("int")).withColumn(
        "_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select(
        *columns, F.least("_k", "_other").alias("_x"), F.greatest("_k", "_other").alias("_y"), "_k", "_v")


def _candidates(n: np.ndarray, marks: np.ndarray, block: np.ndarray | None, percent: int, label: np.ndarray
                ) -> Iterator[tuple[int, np.ndarray]]:
    """(i, all j > i that the bitmaps let pass and whose label differs), sets in
    the order of their sizes. ``block``: only pairs of different blocks."""
    upto = np.searchsorted(n, n * 100 // percent, side="right")  # linked sets are no larger
    for i in range(len(n)):
        lo, hi = i + 1, upto[i]
        if lo >= hi:
            continue
        differ = np.bitwise_count(marks[lo:hi] ^ marks[i]).sum(axis=1, dtype=np.int64)
        m = n[lo:hi]
        may = _reaches((n[i] + m - differ) // 2, n[i], m, percent) & (label[lo:hi] != label[i])
        if block is not None:
            may &= block[lo:hi] != block[i]
        yield i, lo + np.flatnonzero(may)


def _blocks_of(t: pa.Table, order: np.ndarray) -> np.ndarray | None:
    if t.column("_x")[0].as_py() == t.column("_y")[0].as_py():
        return None
    return t.column("_k").to_numpy()[order]


def sift(t: pa.Table, percent: int) -> pa.Table:
    """Members of a block pair with a pair that the bitmaps let pass."""
    n = t.column("_n").to_numpy()
    order = np.argsort(n, kind="stable")
    n, label = n[order], t.column("_part").to_numpy()[order]
    marks = _flat(t.column("_bits").combine_chunks())[0].reshape(len(n), -1)[order]
    stay = np.zeros(len(n), bool)
    for i, found in _candidates(n, marks, _blocks_of(t, order), percent, label):
        stay[found] = True
        stay[i] |= len(found) > 0
    return t.select(["_w", "_band", "_v"]).take(pa.array(order[stay]))


def joining_edges(t: pa.Table, percent: int) -> pa.Table:
    """Links of one block pair that join different components, as a forest."""
    flat, ends = _flat(t.column("_set").combine_chunks())
    n = np.diff(ends)
    order = np.argsort(n, kind="stable")
    sets = [flat[ends[i]:ends[i + 1]] for i in order]
    n, ids, label = n[order], t.column("_v").to_numpy()[order], t.column("_part").to_numpy()[order].copy()
    marks = np.stack([bitmap(x, width_of(n[-1])) for x in sets])
    a, b = [], []
    for i, found in _candidates(n, marks, _blocks_of(t, order), percent, label):
        for j in found:
            if label[j] == label[i]:
                continue
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if _reaches(common, n[i], n[j], percent):
                a.append(int(ids[i]))
                b.append(int(ids[j]))
                label[label == label[j]] = label[i]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
