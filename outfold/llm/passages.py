"""Documents and the runs of windows in them that recur: steps that the
substring and the phrase operator share.

A document is a row of symbols, its UTF-8 bytes or its words. ``sample`` writes
one small row for each run of windows (see ``anchors``). Runs whose key occurs
once have no repeated window; runs with equal content are repeated as a whole.
What is left are runs that share their key with runs of another content. One
run of each such content is taken apart into blocks of a few windows, which
have a key (what all windows of the block have in common) and a content of
their own and are judged in the same way, and blocks that are still open into
single windows. So a text that differs from its copies here and there costs
some rows around each difference, not one for each window. Equal runs of one
document are one row; where a document has more of them than the first, they are
found again when its text is at hand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outfold.llm.anchors import (BASE_A, BASE_B, BYTE_VALUES, MAX_SYMBOLS, Rolling, Runs, find_runs,
                                 mix, pieces, union_of)
from outfold.llm.common import Workspace, blobs, slices

#: Bytes of text that a task looks at together.
SLICE = 1 << 20


class Bytes:
    """Symbols are bytes."""

    def __init__(self, width: int, gram: int):
        self.width, self.gram = width, gram

    def parts(self, text: bytes) -> bytes:
        return text

    def read(self, parts: bytes) -> np.ndarray:
        return BYTE_VALUES[np.frombuffer(parts, dtype=np.uint8)]

    def kept(self, parts: bytes, lo: np.ndarray, hi: np.ndarray) -> bytes:
        """What stays without the symbols of the intervals."""
        edges = zip([0, *hi.tolist()], [*lo.tolist(), len(parts)], strict=True)
        return b"".join(parts[a:b] for a, b in edges)


class _WordHashes(dict):
    """Hashes of the words a Python worker has met, bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 800_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHashes()


class Words:
    """Symbols are words between ASCII blanks (x20, x09-x0D), unchanged."""

    def __init__(self, width: int, gram: int):
        self.width, self.gram = width, gram

    def parts(self, text: bytes) -> list[bytes]:
        return text.split()

    def read(self, parts: list[bytes]) -> np.ndarray:
        return mix(np.fromiter(map(_hashes.__getitem__, parts), np.uint64, len(parts)))

    def kept(self, parts: list[bytes], lo: np.ndarray, hi: np.ndarray) -> bytes:
        edges = zip([0, *hi.tolist()], [*lo.tolist(), len(parts)], strict=True)
        return b" ".join(w for a, b in edges for w in parts[a:b])


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id``, ``_h`` (checksum that tells texts of one id apart), ``_t``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("_id"),
                       F.hash(text).alias("_h"), text.alias("_t"))


def _batch_runs(symbols: list[np.ndarray], kind) -> Iterator[tuple[np.ndarray, Runs]]:
    """Runs of several documents; those too long for one batch go piece by piece."""
    room: list[tuple[int, int, np.ndarray]] = []  # document, where the piece begins, symbols
    size = 0

    def flush():
        found = find_runs(np.concatenate([r[2] for r in room]),
                          np.cumsum([len(r[2]) for r in room]), kind.width, kind.gram)
        if found is not None:
            at = np.array([r[1] for r in room])[found.doc]
            found.start, found.anchor = found.start + at, found.anchor + at
            yield np.array([r[0] for r in room])[found.doc], found

    for d, s in enumerate(symbols):
        if len(s) < kind.width:
            continue
        for lo, hi in pieces(len(s), kind.width, MAX_SYMBOLS):
            if room and size + hi - lo > MAX_SYMBOLS:
                yield from flush()
                room, size = [], 0
            room.append((d, lo, s[lo:hi]))
            size += hi - lo
    if room:
        yield from flush()


RUN = "_id long, _h int, _start int, _n int, _lead int, _m int, _key long, _content long"
NAMES = [f.split()[0] for f in RUN.split(", ")]


def _run_batch(ids: pa.Array, checks: pa.Array, ints: list[np.ndarray], key: np.ndarray,
               content: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [ids, checks, *(pa.array(c.astype(np.int32)) for c in ints),
         pa.array(key.view(np.int64)), pa.array(content.view(np.int64))], NAMES)


def sample(rows: DataFrame, make: Callable) -> DataFrame:
    """One row for each different run of a document: document, first window,
    number of windows, how far the anchor stands from the first window, how
    often the document has such a run, key, content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = make()
        for b in slices(batches, "_t", SLICE):
            symbols = [kind.read(kind.parts(t)) for t in blobs(b.column("_t"))]
            for doc, r in _batch_runs(symbols, kind):
                order = np.lexsort((r.start, r.content, doc))
                d, c = doc[order], r.content[order]
                new = np.ones(len(d), dtype=bool)
                new[1:] = (d[1:] != d[:-1]) | (c[1:] != c[:-1])
                head = np.flatnonzero(new)
                first = order[head]
                pick = pa.array(doc[first])
                yield _run_batch(b.column("_id").take(pick), b.column("_h").take(pick),
                                 [r.start[first], r.windows[first], (r.anchor - r.start)[first],
                                  np.diff(np.append(head, len(d)))], r.key[first], r.content[first])

    return rows.mapInArrow(run, RUN)


def same_text(a: DataFrame, b: DataFrame):
    """Join condition: the same document, null ids included."""
    return a["_id"].eqNullSafe(b["_id"]) & (a["_h"] == b["_h"])


def with_refs(rows: DataFrame, refs: DataFrame, make: Callable) -> DataFrame:
    """Every document with its number of symbols, the checksum of its untouched
    symbols and its refs (structs of its recurring runs); the text only where
    there are refs. One shuffle of the texts."""
    by_doc = refs.groupBy("_id", "_h").agg(F.collect_list("_ref").alias("_refs"))
    # refs are not bounded: no broadcast at any size
    joined = rows.hint("merge").join(by_doc, same_text(rows, by_doc), "left").select(
        rows["_id"], rows["_h"], rows["_t"], by_doc["_refs"])
    kind_of_refs = joined.schema["_refs"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = make()
        none = np.empty(0, np.int64)
        for b in slices(batches, "_t", SLICE):
            read = blobs(b.column("_t"))
            parts = [kind.parts(t) for t in read]
            sha = [hashlib.sha256(kind.kept(p, none, none)).hexdigest() for p in parts]
            refs = b.column("_refs")
            has = refs.is_valid().to_pylist()
            text = pa.array([t if h else None for t, h in zip(read, has, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), b.column("_h"), pa.array(map(len, parts), pa.int64()),
                 pa.array(sha, pa.string()), text.cast(pa.string()), refs], ["_id", "_h", "_size", "_sha", "_t", "_refs"])

    return joined.mapInArrow(
        run, f"_id long, _h int, _size long, _sha string, _t string, _refs {kind_of_refs}")


def _refs_of(col: pa.ListArray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Refs of a batch: the row of each, and their fields."""
    rows = np.repeat(np.arange(len(col)), pc.fill_null(pc.list_value_length(col), 0).to_numpy(
        zero_copy_only=False))
    flat = col.flatten()
    return rows, {f.name: flat.field(f.name).to_numpy(zero_copy_only=False).astype(
        bool if pa.types.is_boolean(f.type) else np.int64) for f in flat.type}


def _only(col: pa.ListArray, keep: np.ndarray) -> pa.ListArray:
    """The refs of a batch for which ``keep`` holds."""
    if keep.all():
        return col
    sizes = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
    left = np.bincount(np.repeat(np.arange(len(col)), sizes)[keep], minlength=len(col))
    ends = pa.array(np.cumsum([0, *left]).astype(np.int32))
    return pa.ListArray.from_arrays(ends, col.flatten().filter(pa.array(keep)), type=col.type,
                                    mask=col.is_null())


def parts_of(docs: DataFrame, make: Callable, step: int) -> DataFrame:
    """The refs marked ``open``, cut into blocks of at most ``step`` windows whose
    distance to the anchor is the same multiple of ``step``; rows as in ``RUN``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = make()
        for b in slices(batches, "_t", SLICE):
            doc, ref = _refs_of(b.column("_refs"))
            take = ref["open"]
            doc = doc[take]
            if not len(doc):
                continue
            start, n, lead = (ref[c][take] for c in ("start", "n", "lead"))
            use = np.unique(doc)  # the documents with open refs, end to end
            read = blobs(b.column("_t").take(pa.array(use)))
            symbols = [kind.read(kind.parts(t)) for t in read]
            base = np.cumsum([0, *map(len, symbols)])[:-1]
            start = start + base[np.searchsorted(use, doc)]
            symbols = np.concatenate(symbols)
            low = lead - n + 1                       # smallest distance to the anchor
            first, count = low // step, lead // step - low // step + 1
            which = np.repeat(np.arange(len(doc)), count)
            j = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + first[which]
            far = np.minimum(lead[which], j * step + step - 1)
            near = np.maximum(low[which], j * step)
            anchor = (start + lead)[which]
            at, size = anchor - far, far - near + 1
            core = Rolling(symbols, BASE_A).of(
                anchor - j * step, anchor - j * step - step + 1 + kind.width)
            whole = Rolling(symbols, BASE_B).of(at, at + size - 1 + kind.width)
            key = mix(core + mix(j.astype(np.uint64)))
            content = mix(whole + far.astype(np.uint64) * np.uint64(BASE_A))
            doc = doc[which]
            pick = pa.array(doc)
            yield _run_batch(b.column("_id").take(pick), b.column("_h").take(pick),
                             [at - base[np.searchsorted(use, doc)], size, far, np.ones(len(at))],
                             key, content)

    return docs.mapInArrow(run, RUN)


def judge(runs: DataFrame, keep_first: bool, ws: Workspace, single: bool = False) -> DataFrame:
    """Runs that are repeated as a whole (``cut``; with ``keep_first`` all but
    the first of equal ones), runs to be taken apart (``open``: the first of its
    content, where the key has other contents too) and runs that the document
    has again further on (``many``). ``runs`` must be a table, as it is read
    twice. All counts are pre-aggregated, and written before they are joined, so
    that Spark can split the join of a hot content. ``single``: runs of one
    window, which cannot be taken apart."""
    place = F.struct("_id", "_start")
    same = runs.groupBy("_key", "_content").agg(
        F.sum("_m").alias("_c"), F.min(place).alias("_first"))
    if single:
        known = ws.save(same.where("_c > 1").withColumn("_mixed", F.lit(False)), "known")
    else:
        same = ws.save(same, "same")
        keys = same.groupBy("_key").agg(F.sum("_c").alias("_all"), (
            F.min("_content") != F.max("_content")).alias("_mixed")).where("_all > 1").drop("_all")
        known = ws.save(same.join(keys, "_key"), "known")
    first = place.eqNullSafe(F.col("_first"))
    return (runs.hint("merge").join(known, ["_key", "_content"])
            .withColumn("cut", ~first if keep_first else F.col("_c") > 1)
            .withColumn("open", F.col("_mixed") & first)
            .withColumn("many", F.col("_m") > 1)
            .where("cut or open or many")
            .select("_id", "_h", F.struct(
                F.col("_start").alias("start"), F.col("_n").alias("n"), F.col("_lead").alias("lead"),
                F.col("_content").alias("content"), "cut", "open", "many").alias("_ref")))


def open_parts(docs: DataFrame, refs: DataFrame, make: Callable, step: int) -> DataFrame:
    """``parts_of`` for further refs of documents whose text is in ``docs``."""
    by_doc = refs.where("_ref.open").groupBy("_id", "_h").agg(F.collect_list("_ref").alias("_more"))
    joined = docs.hint("merge").join(by_doc, same_text(docs, by_doc)).select(
        docs["_id"], docs["_h"], docs["_t"], by_doc["_more"].alias("_refs"))
    return parts_of(joined, make, step)


def remove_repeats(rows: DataFrame, recurring: DataFrame, make: Callable, ws: Workspace, step: int,
                   keep_first: bool, id_col: str, unit: str) -> DataFrame:
    """From the runs with a recurring key to the documents without what repeats."""
    marked, path = ws.save_at(with_refs(rows, judge(recurring, keep_first, ws), make), "marked")
    ws.drop_all(but=path)
    opened = marked.where("exists(_refs, r -> r.open)")
    blocks = ws.save(parts_of(opened, make, step), "blocks")
    more = ws.save(judge(blocks, keep_first, ws), "more")
    windows = ws.save(open_parts(opened, more, make, 1), "windows")
    hits = ws.save(judge(windows, keep_first, ws, single=True).unionAll(more).where("_ref.cut"), "hits")
    return finish(marked, hits, make, id_col, unit)


def _again(kind, parts: list, doc: np.ndarray, ref: dict[str, np.ndarray]
           ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, n) of the runs that equal a ref marked ``many`` of their
    document, but for the refs that stay."""
    none = np.empty(0, np.int64)
    use = np.unique(doc[ref["many"]])
    if not len(use):
        return none, none, none
    tag = mix(doc.astype(np.uint64) * np.uint64(BASE_B) + ref["content"].view(np.uint64))
    seek = tag[ref["many"]]
    stay = ~ref["cut"]
    stay = mix(tag[stay] + ref["start"][stay].astype(np.uint64))
    out = []
    for d, r in _batch_runs([kind.read(parts[i]) for i in use], kind):
        d = use[d]
        own = mix(d.astype(np.uint64) * np.uint64(BASE_B) + r.content)
        hit = np.isin(own, seek) & ~np.isin(mix(own + r.start.astype(np.uint64)), stay)
        out.append((d[hit], r.start[hit], r.windows[hit]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (none, none, none)


def finish(docs: DataFrame, hits: DataFrame, make: Callable, id_col: str, unit: str) -> DataFrame:
    """Remove the symbols covered by refs with ``cut``, those of ``docs`` and of ``hits``."""
    by_doc = hits.groupBy("_id", "_h").agg(F.collect_list("_ref").alias("_hits"))
    opened = docs.where("exists(_refs, r -> r.open)")
    closed = docs.where("not exists(_refs, r -> r.open)").select(
        "_id", "_t", "_refs", F.lit(None).cast(by_doc.schema["_hits"].dataType).alias("_hits"))
    joined = opened.hint("merge").join(by_doc, same_text(opened, by_doc), "left").select(
        opened["_id"], opened["_t"], opened["_refs"], by_doc["_hits"]).unionAll(closed)
    names = ["_id", f"n_{unit}", "n_removed", "n_spans", "kept_sha256"]
    schema = f"_id long, n_{unit} long, n_removed long, n_spans long, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = make()
        for b in slices(batches, "_t", SLICE):
            read = [kind.parts(t) for t in blobs(b.column("_t"))]
            doc, ref = _refs_of(b.column("_refs"))
            more_doc, more = _refs_of(b.column("_hits"))
            cut = ref["cut"]
            found = [(doc[cut], ref["start"][cut], ref["n"][cut]),
                     (more_doc, more["start"], more["n"]), _again(kind, read, doc, ref)]
            doc, start, n = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.argsort(doc, kind="stable")
            doc, start, n = doc[order], start[order], n[order]
            edge = np.searchsorted(doc, np.arange(len(read) + 1))
            out = [[] for _ in names[1:]]
            for i, parts in enumerate(read):
                lo = start[edge[i]:edge[i + 1]]
                hi = lo + n[edge[i]:edge[i + 1]] - 1 + kind.width
                if len(lo):
                    lo, hi = union_of(lo, hi)
                out[0].append(len(parts))
                out[1].append(int((hi - lo).sum()))
                out[2].append(len(lo))
                out[3].append(hashlib.sha256(kind.kept(parts, lo, hi)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), *(pa.array(c, pa.int64()) for c in out[:3]),
                 pa.array(out[3], pa.string())], names)

    clean = docs.where("_refs is null").select(
        "_id", F.col("_size").alias(f"n_{unit}"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.col("_sha").alias("kept_sha256"))
    return clean.unionAll(joined.mapInArrow(run, schema)).withColumnRenamed("_id", id_col)
