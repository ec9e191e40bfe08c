"""Near-duplicate documents by circulant MinHash.

One permutation (sigma) shuffles the shingles once, a second one (pi), shifted
by 1, 2, 3 ... places, gives every coordinate of the signature:
``min over shingles of pi(sigma(shingle) + shift)``. Bands of the signature put
documents into buckets; every link is confirmed with the exact Jaccard
similarity of the whole shingle sets.

No pairs of a bucket are written out. Texts with equal sets are one
representative. Each member of a bucket is compared with the bucket's smallest
member; most groups are one component after that. Only where a group still has
several components are its members compared with each other, in blocks, and
only edges that join components leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outfold.llm.anchors import mix
from outfold.llm.common import Workspace, blobs, slices
from outfold.llm.components import components

#: bands x rows: a pair at similarity 0.8 shares no band with probability 3e-6,
#: at 0.85 with 2e-8.
BANDS, ROWS = 24, 4
#: Members of a group that one task compares with as many others.
BLOCK = 512
SIGMA, PI = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0876A9A47)


def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII blanks (x20, x09-x0D), A-Z in lower case."""
    return text.lower().split()


class Shingler(dict):
    """Distinct shingles of a text as sorted 64-bit hashes; a word's own hash is kept."""

    def __init__(self, words: int):
        super().__init__()
        self.words = words

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def __call__(self, text: bytes) -> np.ndarray:
        words = words_of(text)
        n, k = len(words), self.words
        if not n:
            return np.empty(0, dtype=np.uint64)
        h = np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=n)
        size = min(n, k)
        out = np.full(n - size + 1, size, dtype=np.uint64)
        for j in range(size):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j:n - size + 1 + j])
        return np.unique(out)


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash coordinates of a non-empty set."""
    places = mix(shingles ^ SIGMA)[:, None]  # sigma: a bijection of 64-bit values
    out = np.empty(size, dtype=np.uint64)
    step = max(1, (1 << 17) // len(shingles))
    for lo in range(0, size, step):
        shift = np.arange(lo + 1, min(size, lo + step) + 1, dtype=np.uint64)[None]
        x = places + shift                 # the circular shift, modulo 2**64
        x *= PI                            # pi: an odd multiplier and a fold, a bijection too
        x ^= x >> np.uint64(32)
        x *= SIGMA
        out[lo:lo + shift.shape[1]] = x.min(axis=0)
    return out


def _similar(common: str, a: str, b: str, percent: int) -> str:
    return f"100 * {common} >= {int(percent)} * ({a} + {b} - {common})"


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS,
                    rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``n_shingles``, ``component_id`` and ``kept`` of each document.

    Two documents are linked if 100 * |A & B| >= ``percent`` * |A | B| for
    their sets of ``words``-word shingles (A-Z lower-cased; fewer words: the
    whole sequence is one shingle). ``component_id`` is the smallest id that can
    be reached by links; ``kept`` marks that document.

    Null, empty or blank text: no shingle, linked with nothing. Ids are taken
    to be whole numbers and unique; of rows with one id, each is returned, and
    they share a component. A null id is returned with a null component and not kept.
    Empty table: empty result. Other columns are not read.
    """
    if not 1 <= percent <= 100 or words < 1:
        raise ValueError("need 1 <= percent <= 100 and words >= 1")
    spark = docs.sparkSession
    ws = Workspace(spark, "minhash")
    size = bands * rows
    texts_in = docs.select(F.col(id_col).cast("long").alias("_id"),
                           F.col(text_col).cast("string").alias("_t"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for b in slices(batches, "_t", 4 << 20):
            n, key, bands_out = [], [], []
            for t in blobs(b.column("_t")):
                s = shingles(t)
                n.append(len(s))
                if len(s):
                    key.append(xxhash.xxh3_128_digest(s.tobytes()))
                    sig = signature(s, size).reshape(bands, rows)
                    h = np.arange(bands, dtype=np.uint64)
                    for r in range(rows):
                        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, r])
                    bands_out.append(h.view(np.int64).tolist())
                else:
                    key.append(None)
                    bands_out.append(None)
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), pa.array(n, pa.int64()), pa.array(key, pa.binary()),
                 pa.array(bands_out, pa.list_(pa.int64()))], ["_id", "n_shingles", "_key", "_bands"])

    signed = ws.save(texts_in.mapInArrow(
        sign, "_id long, n_shingles long, _key binary, _bands array<bigint>"), "signed")

    # One representative of each set.
    reps = ws.save(signed.where("_key is not null and _id is not null").groupBy("_key").agg(
        F.min("_id").alias("_rep"), F.first("_bands").alias("_bands")), "reps")
    cells = reps.select(F.col("_rep").alias("_id"), F.posexplode("_bands").alias("_band", "_value"))
    leaders = cells.groupBy("_band", "_value").agg(
        F.min("_id").alias("_lead"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    # (member, smallest member) over all buckets: at most `bands` rows of each text.
    pairs = ws.save(cells.join(leaders, ["_band", "_value"]).where("_id <> _lead")
                    .select("_id", "_lead").distinct(), "pairs")
    wanted = pairs.select("_id").unionAll(pairs.select(F.col("_lead").alias("_id"))).distinct()

    def shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for b in slices(batches, "_t", 2 << 20):
            sets = [shingles(t).view(np.int64) for t in blobs(b.column("_t"))]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), pa.ListArray.from_arrays(pa.array(ends), flat)], ["_id", "_set"])

    # Whole sets, for candidates only. The texts go through a shuffle at any size:
    # the candidates are not bounded, so they are not to be broadcast.
    sets = ws.save(texts_in.hint("merge").join(wanted, "_id", "left_semi").dropDuplicates(["_id"])
                   .mapInArrow(shingle_sets, "_id long, _set array<bigint>"), "sets")
    lead_sets = sets.select(F.col("_id").alias("_lead"), F.col("_set").alias("_lead_set"))
    common = F.size(F.array_intersect("_set", "_lead_set"))
    links = ws.save(
        pairs.join(sets, "_id").join(lead_sets, "_lead")
        .select("_id", "_lead", F.size("_set").alias("_a"), F.size("_lead_set").alias("_b"),
                common.alias("_c"))
        .where(_similar("_c", "_a", "_b", percent))
        .select(F.col("_id").alias("a"), F.col("_lead").alias("b")), "links")

    # Which groups of candidates are not one component yet?
    groups = ws.save(components(pairs.select(F.col("_id").alias("a"), F.col("_lead").alias("b")), ws)
                     .withColumnRenamed("component", "_group"), "groups")
    joined = components(links, ws)
    members = ws.save(groups.join(joined, "id", "left").select(
        F.col("id").alias("_id"), "_group", F.coalesce("component", "id").alias("_part")), "members")
    parts = members.groupBy("_group").agg(
        F.min("_part").alias("_p"), F.max("_part").alias("_q"), F.count("*").alias("_n")
    ).where("_p <> _q").withColumn("_blocks", F.expr(f"cast((_n + {BLOCK - 1}) div {BLOCK} as int)")
                                   ).select("_group", "_blocks")
    # Block pairs (x <= y): a member of block k goes to all pairs that hold k.
    dealt = members.join(parts, "_group").join(sets, "_id").withColumn(
        "_k", F.pmod(F.xxhash64("_id", F.lit(5)), F.col("_blocks")).cast("int")).withColumn(
        "_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select(
        "_group", F.least("_k", "_other").alias("_x"), F.greatest("_k", "_other").alias("_y"),
        "_k", "_id", "_part", "_set")

    def compare(table: pa.Table) -> pa.Table:
        return _joining_edges(table.combine_chunks(), percent)

    more = dealt.groupBy("_group", "_x", "_y").applyInArrow(compare, "a long, b long")
    final = components(links.unionAll(ws.save(more, "more")), ws)
    of_rep = reps.select("_key", "_rep").join(
        final, reps["_rep"] == final["id"], "left").select(
        "_key", F.coalesce("component", "_rep").alias("_component"))
    return signed.join(of_rep, "_key", "left").select(
        F.col("_id").alias(id_col), "n_shingles",
        F.coalesce("_component", "_id").alias("component_id"),
        F.coalesce(F.coalesce("_component", "_id") == F.col("_id"), F.lit(False)).alias("kept"))


def _joining_edges(t: pa.Table, percent: int) -> pa.Table:
    """Links inside one block pair that join different components, as a forest.

    An inverted list of the block's shingles counts common shingles of a member
    with all others at once."""
    x, y = t.column("_x")[0].as_py(), t.column("_y")[0].as_py()
    ids = t.column("_id").to_numpy()
    part = {p: p for p in t.column("_part").to_pylist()}
    label = t.column("_part").to_pylist()
    block = t.column("_k").to_numpy()
    col = t.column("_set").combine_chunks()
    ends = col.offsets.to_numpy().astype(np.int64)
    size = np.diff(ends)
    flat = col.values.to_numpy()[ends[0]:ends[-1]]
    owner = np.repeat(np.arange(len(ids)), size)
    _, code = np.unique(flat, return_inverse=True)
    order = np.argsort(code, kind="stable")
    posted = owner[order]
    begin = np.searchsorted(code[order], np.arange(code.max() + 2 if len(code) else 1))
    ends = ends - ends[0]

    def root(p: int) -> int:
        while part[p] != p:
            part[p] = part[part[p]]
            p = part[p]
        return p

    a, b = [], []
    for i in range(len(ids)):
        if x != y and block[i] != x:
            continue
        codes = code[ends[i]:ends[i + 1]]
        lists = [posted[begin[c]:begin[c + 1]] for c in codes]
        common = np.bincount(np.concatenate(lists), minlength=len(ids))
        near = np.flatnonzero(100 * common >= percent * (size[i] + size - common))
        for j in near:
            if j == i or (x != y and block[j] == x):
                continue
            p, q = root(label[i]), root(label[j])
            if p != q:
                part[max(p, q)] = min(p, q)
                a.append(int(ids[i]))
                b.append(int(ids[j]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
