"""Phrase collocations by multikey three-way quicksort of suffix pointers.

Every word is the beginning of a suffix: itself and the words after it, five at
most, up to the end of its piece. A first pass over the texts counts words and
leading pairs; suffixes whose leading pair is infrequent are abandoned, and the
others end before their first infrequent pair. What is left is routed by its
leading pair, so that all suffixes with it meet in one task; there a three-way
quicksort goes through them word by word. Equal partitions are phrases and their
sizes the counts; a partition, equal or not, with too few suffixes for one
frequent phrase is abandoned.

Equal suffixes of a batch of texts travel once, with their number; those of one
route are one row. A leading
pair that holds more than its share of all suffixes is routed by all five words
instead; its shorter phrases are then counted in parts, which are added up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outfold.llm.anchors import mix
from outfold.llm.common import Workspace, bit_table, blobs, in_table, slices, small_batches

DEPTH = 5
#: A pair with more than one part in this many of all suffixes is routed by five words.
SHARES = 1000
#: Suffixes in one sorting task, about; half of it is what a task sends off at once.
TASK_ROWS = 1 << 18

_ENDS = re.compile(rb"[.,;:!?\x0a-\x0d]+")
#: Stands between pieces; no word of a text without A-Z is equal to it.
_END = b"A"
_K = np.uint64(0x9E3779B97F4A7C15)


class Coder(dict):
    """64-bit codes of words; 0 ends a piece."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = (xxhash.xxh64_intdigest(word) or 1) if word != _END else 0
        return h

    def __call__(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def words_of(text: bytes) -> list[bytes]:
    """Words in lower case (A-Z), with an end mark after each piece."""
    words = _ENDS.sub(b" A ", text.lower()).split()
    words.append(_END)
    return words


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[int, str, list[bytes]]]:
    """(code, language, words of all its texts) in a batch."""
    found: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column("_lang").to_pylist(), blobs(batch.column("_t"))):
        found.setdefault(lang, []).extend(words_of(text))
    for lang, words in found.items():
        yield xxhash.xxh64_intdigest(lang.encode()), lang, words


def _pairs(codes: np.ndarray, lang: int) -> np.ndarray:
    """A hash of each word and the next one; 0 where a piece ends before."""
    a, b = codes[:-1], codes[1:]
    h = mix(mix(a * _K + np.uint64(lang)) * _K + b)
    h[(a == 0) | (b == 0)] = 0
    return h


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_lang, _g, _code, _word, _c): words, and pairs with a code and a number only."""
    coder = Coder()
    for batch in slices(batches, "_t", 1 << 20):
        for g, lang, words in _by_lang(batch):
            codes = coder(words)
            one, at, c1 = np.unique(codes, return_index=True, return_counts=True)
            two, c2 = np.unique(_pairs(codes, g), return_counts=True)
            one, at, c1 = one[one != 0], at[one != 0], c1[one != 0]
            two, c2 = two[two != 0], c2[two != 0]
            text = pa.array([words[i] for i in at], pa.binary()).cast(pa.string())
            none = np.r_[np.zeros(len(one), bool), np.ones(len(two), bool)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang], pa.string()).take(pa.array(np.zeros(len(none), np.int32), mask=none)),
                 pa.array(np.full(len(none), g, np.uint64).view(np.int64), mask=none),
                 pa.array(np.concatenate([one, two]).view(np.int64)),
                 pa.concat_arrays([text, pa.nulls(len(two), pa.string())]),
                 pa.array(np.concatenate([c1, c2]))], ["_lang", "_g", "_code", "_word", "_c"])


def runs(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different rows of ``keys`` and their summed weights."""
    if not len(keys):
        return keys, weight
    order = np.lexsort(keys.T[::-1])
    keys, weight = keys[order], weight[order]
    head = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
    return keys[head], np.add.reduceat(weight, head)


def multikey(keys: np.ndarray, weight: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """Three-way radix quicksort of the rows of ``keys``: (depth, a row, weight)
    for each equal partition of at least ``least``; 0 ends a row. Partitions
    below that are left unsorted."""
    stack = [(np.arange(len(keys)), 0)]
    while stack:
        at, depth = stack.pop()
        if depth == keys.shape[1] or weight[at].sum() < least:
            continue
        col = keys[at, depth]
        pivot = np.sort(col[[0, len(col) // 2, -1]])[1]
        same = col == pivot
        low = col < pivot
        equal = at[same]
        if len(equal) < len(at):
            stack.append((at[low], depth))
            stack.append((at[~(same | low)], depth))
        total = int(weight[equal].sum())
        if pivot and total >= least:
            yield depth + 1, int(equal[0]), total
            stack.append((equal, depth + 1))


def _phrases_of(whole: np.ndarray, parted: np.ndarray, least: int) -> pa.RecordBatch:
    """Frequent phrases of complete groups, partial counts of the others. Rows of
    codes (language, words) and a number."""
    out, total = [], []
    k, w = whole[:, :-1], whole[:, -1].view(np.int64)
    for depth, row, n in multikey(k, w, least):
        if depth > 2:  # language and two words at least
            out.append(np.r_[k[row, :depth], np.zeros(DEPTH + 1 - depth, np.uint64)])
            total.append(n)
    found, counts = [np.array(out, dtype=np.uint64).reshape(-1, DEPTH + 1)], [np.array(total, np.int64)]
    k, w = parted[:, :-1], parted[:, -1].view(np.int64)
    for depth in range(3, DEPTH + 2):
        some = k[:, depth - 1] != 0
        head = k[some].copy()
        head[:, depth:] = 0
        a, b = runs(head, w[some])
        found.append(a)
        counts.append(b)
    rows = np.concatenate(found).view(np.int64)
    return pa.RecordBatch.from_arrays(
        [*[pa.array(np.ascontiguousarray(rows[:, i])) for i in range(DEPTH + 1)],
         pa.array(np.concatenate(counts))], ["_g", *[f"_w{i}" for i in range(DEPTH)], "_c"])


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, cover: int = 100,
                 lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The strongest phrases of 2 to 5 words of each language: lang, ``rank``,
    ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    Texts in lower case (A-Z) are cut at ``.,;:!?`` and line ends into pieces,
    these at blanks and tabs into words. A phrase that occurs a >= ``least`` times
    (within pieces, overlaps included) has for each cut l = f(first part),
    r = f(rest) and floor(1000 * a * n / (l * r)), n being all words of the
    language; the lowest counts, the first of equal ones. Phrases inside a
    longer one with 100 * f(longer) >= ``cover`` * a are dropped. The first ``top`` by score,
    a (both descending) and phrase (UTF-8 bytes) are returned.

    Null language: ``und``. Null, empty or blank text: no words. Repeated rows
    count each time. Texts without a frequent phrase, and empty tables, give no
    row. Other columns are not read. Words are told apart by 64-bit hashes.
    """
    if least < 1 or top < 1 or not 1 <= cover <= 100:
        raise ValueError("need least >= 1, top >= 1 and 1 <= cover <= 100")
    spark = docs.sparkSession
    ws = Workspace(spark, "phrases")
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("_lang"),
                        F.col(text_col).cast("string").alias("_t")).where("_t is not null")
    with small_batches(spark):
        counted = ws.save(texts.mapInArrow(
            _count_words, "_lang string, _g long, _code long, _word string, _c long")
            .groupBy("_lang", "_g", "_code", "_word").agg(F.sum("_c").alias("_c"))
            # An infrequent pair is needed no more; words are, for n.
            .where(f"_word is not null or _c >= {int(least)}"), "counted")
    vocabulary = counted.where("_word is not null")
    pairs = counted.where("_word is null")
    size = vocabulary.groupBy("_lang", "_g").agg(F.sum("_c").alias("_n"))

    # Frequent pairs as bits, a bounded table (others that hit a bit travel in
    # vain); pairs with a large share by name.
    suffixes = pairs.agg(F.sum("_c")).first()[0] or 0
    large = [r[0] for r in pairs.where(F.col("_c") > max(least, suffixes // SHARES)).select("_code").collect()]
    shared = spark.sparkContext.broadcast(
        (bit_table(pairs, "_code"), np.sort(np.array(large, dtype=np.int64).view(np.uint64))))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-suffixes // TASK_ROWS))
    buckets = 8 * tasks  # of about equal size; hashing them over the tasks evens out

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, large = shared.value
        coder = Coder()
        held: list[np.ndarray] = []

        def packed() -> pa.RecordBatch:
            keys, c = runs(np.concatenate([h[:, :-1] for h in held]),
                           np.concatenate([h[:, -1] for h in held]).view(np.int64))
            held.clear()
            route = mix(mix(keys[:, 1] * _K + keys[:, 0]) * _K + keys[:, 2])
            hot = np.isin(route, large)
            for j in range(3, DEPTH + 1):
                route[hot] = mix(route[hot] * _K + keys[hot, j])
            to = (route % np.uint64(buckets)).astype(np.int64) * 2 + hot
            order = np.argsort(to, kind="stable")
            to, rows = to[order], np.column_stack([keys, c.view(np.uint64)])[order]
            at, first = np.unique(to, return_index=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(at // 2), pa.array(at % 2 == 1),
                 pa.array([r.tobytes() for r in np.split(rows, first[1:])], pa.binary())],
                ["_to", "_hot", "_rows"])

        size = 0
        for batch in slices(batches, "_t", 1 << 20):
            for g, _, words in _by_lang(batch):
                codes = coder(words)
                pair = _pairs(codes, g)
                go = in_table(bits, pair) & (pair != 0)
                at = np.flatnonzero(go)
                if not len(at):
                    continue
                go = np.r_[go, np.zeros(DEPTH, bool)]
                codes = np.r_[codes, np.zeros(DEPTH, np.uint64)]
                cols, on = [np.full(len(at), g, np.uint64), codes[at], codes[at + 1]], np.ones(len(at), bool)
                for j in range(2, DEPTH):
                    on = on & go[at + j - 1]
                    cols.append(np.where(on, codes[at + j], np.uint64(0)))
                held.append(np.column_stack([*cols, np.ones(len(at), np.uint64)]))
                size += len(at)
                if 2 * size > TASK_ROWS:
                    yield packed()
                    size = 0
        if held:
            yield packed()

    columns = ", ".join(f"_w{j} long" for j in range(DEPTH))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list[np.ndarray]] = [[np.empty((0, DEPTH + 2), np.uint64)] for _ in range(2)]
        for b in batches:
            for hot, blob in zip(b.column("_hot").to_pylist(), b.column("_rows").to_pylist()):
                rows[hot].append(np.frombuffer(blob, np.uint64).reshape(-1, DEPTH + 2))
        yield _phrases_of(np.concatenate(rows[0]), np.concatenate(rows[1]), least)

    keys = ["_g", *[f"_w{j}" for j in range(DEPTH)]]
    phrases = (texts.mapInArrow(emit, "_to long, _hot boolean, _rows binary").repartition(tasks, "_to")
               .mapInArrow(sort, f"_g long, {columns}, _c long")
               .groupBy(*keys).agg(F.sum("_c").alias("_a")).where(f"_a >= {int(least)}")
               .select("_g", F.filter(F.array(*keys[1:]), lambda w: w != 0).alias("_p"), "_a"))
    with small_batches(spark):
        phrases = ws.save(phrases, "frequent")
    shared.unpersist()
    counts = ws.save(phrases.unionAll(vocabulary.where(f"_c >= {int(least)}").select(
        "_g", F.array("_code").alias("_p"), F.col("_c").alias("_a"))), "counts")

    # Each cut of each phrase meets the counts of its two parts.
    cuts = phrases.withColumn("_k", F.explode(F.sequence(F.lit(1), F.size("_p") - 1))).withColumn(
        "_left", F.expr("slice(_p, 1, _k)")).withColumn("_right", F.expr("slice(_p, _k + 1, size(_p) - _k)"))
    cuts = cuts.join(counts.select("_g", F.col("_p").alias("_left"), F.col("_a").alias("_l")), ["_g", "_left"])
    cuts = cuts.join(counts.select("_g", F.col("_p").alias("_right"), F.col("_a").alias("_r")), ["_g", "_right"])
    scored = cuts.join(size, "_g").withColumn("_score", F.expr(
        "(cast(1000L * _a as decimal(19,0)) * cast(_n as decimal(19,0))) div "
        "(cast(_l as decimal(19,0)) * cast(_r as decimal(19,0)))"))
    best = scored.groupBy("_g", "_lang", "_p", "_a", "_n").agg(
        F.min(F.struct("_score", "_k", "_l", "_r")).alias("_b"))
    # A longer phrase with this one inside is found by way of those with one word more.
    longer = phrases.where("size(_p) > 2").select("_g", "_a", F.explode(F.array(
        F.expr("slice(_p, 1, size(_p) - 1)"), F.expr("slice(_p, 2, size(_p) - 1)"))).alias("_p"))
    longer = longer.groupBy("_g", "_p").agg(F.max("_a").alias("_inside"))
    kept = best.join(longer, ["_g", "_p"], "left").where(
        f"_inside is null or 100 * _inside < {int(cover)} * _a")
    # Ties at the last place stay until the words are there to part them.
    order = Window.partitionBy("_g").orderBy(F.desc("_b._score"), F.desc("_a"))
    kept = ws.save(kept.withColumn("_i", F.rank().over(order)).where(f"_i <= {int(top)}").drop("_i"), "kept")
    named = kept.select("_g", "_p", F.posexplode("_p").alias("_pos", "_code")).join(
        vocabulary.select("_g", "_code", "_word"), ["_g", "_code"]).groupBy("_g", "_p").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_pos", "_word"))),
                                 lambda s: s["_word"]), " ").alias("phrase"))
    last = order.orderBy(F.desc("_b._score"), F.desc("_a"), "phrase")
    return kept.join(named, ["_g", "_p"]).withColumn("rank", F.row_number().over(last).cast("long")).where(
        f"rank <= {int(top)}").select(
        F.col("_lang").alias("lang"), "rank", "phrase", F.col("_a").alias("a"), F.col("_b._l").alias("l"),
        F.col("_b._r").alias("r"), F.col("_n").alias("n"), F.col("_b._score").alias("score"))
