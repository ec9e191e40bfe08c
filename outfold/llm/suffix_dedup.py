"""Repeated substrings by grouping hashes.

A family of levels counts sampled suffixes by the fingerprint of their first
``gram`` bytes; level i holds the counts of 2**i batches. A new batch is grouped
together with the levels for fingerprints that recur, and then merged with level
0, 1, ... as long as there is a level of equal size, as in binary counting. The
levels are no suffix arrays: they are a prefilter that equals one count over all
batches.

Only suffixes at the anchors of ``anchors`` are sampled. Every string of
``width`` bytes that repeats has an anchor at the same offset in each place, so
no repeat is lost, while the family holds about one entry for 60 bytes. Which
bytes go is then decided by grouping hashes of runs, blocks and windows
(``passages``).
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outfold.llm.common import Workspace
from outfold.llm.passages import Bytes, remove_repeats, rows_of, sample

WIDTH, GRAM = 200, 64
#: Windows of a block when a run is taken apart.
BLOCK = 16


class SuffixFamily:
    """Levels of suffix fingerprints, ``_key`` and how often it occurs."""

    def __init__(self, ws: Workspace):
        self.ws = ws
        self.levels: dict[int, tuple[DataFrame, str]] = {}

    def add(self, suffixes: DataFrame) -> DataFrame:
        """Index a batch (``_key`` and ``_m``, how often); returns the keys of the batch that
        occur elsewhere too, in the batch or in an older one."""
        full = 0
        while full in self.levels:
            full += 1
        n, one, none = F.col("_m").cast("long"), F.lit(1).cast("long"), F.lit(0).cast("long")
        every = suffixes.select("_key", n.alias("n"), one.alias("fresh"), n.alias("own"))
        for i, (level, _) in self.levels.items():
            every = every.unionAll(level.select(
                "_key", "n", none.alias("fresh"), (F.col("n") if i < full else none).alias("own")))
        scan, path = self.ws.save_at(
            every.groupBy("_key").agg(F.sum("n").alias("seen"), F.sum("fresh").alias("fresh"),
                                      F.sum("own").alias("n"))
            .where("n > 0").sortWithinPartitions("_key"), f"level{full}")
        for i in range(full):
            self.ws.drop(self.levels.pop(i)[1])
        self.levels[full] = (scan.select("_key", "n"), path)
        # written out, as a later merge takes the level's file away
        return self.ws.save(scan.where("fresh > 0 and seen > 1").select("_key"), "matches")


def repeated_substrings(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, batches: int = 4,
                        id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` of each
    document after every byte covered by a ``width``-byte string that also
    starts elsewhere (in any document) is taken away.

    The documents are indexed in ``batches`` batches by a hash of their id; the
    result does not depend on how many. Null text: empty. Texts shorter than
    ``width`` lose nothing. A repeated row (same id, same text) is another
    document with the same text. A null id is kept. Empty table: empty result.
    Other columns are not read.
    """
    if not 1 <= gram <= width:
        raise ValueError("need 1 <= gram <= width")
    ws = Workspace(docs.sparkSession, "suffixes")
    rows = rows_of(docs, id_col, text_col)
    make = partial(Bytes, width, gram)
    runs, path = ws.save_at(sample(rows, make), "runs")
    family, found = SuffixFamily(ws), None
    batch = F.pmod(F.xxhash64("_id", "_h"), F.lit(batches))
    for b in range(batches):
        matches = family.add(runs.where(batch == b).select("_key", "_m"))
        found = matches if found is None else found.unionAll(matches)
    keys = ws.save(found.distinct(), "keys")  # written, so that Spark can split a hot key's join
    recurring = ws.save(runs.hint("merge").join(keys, "_key"), "recurring")
    ws.drop(path)
    return remove_repeats(rows, recurring, make, ws, BLOCK, False, id_col, "bytes")
