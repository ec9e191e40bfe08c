"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may differ in at most ``budget`` edits. It is split
into budget + 1 pieces; wherever the item stands in a text with no more edits,
at least one piece stands there unchanged. An automaton finds all exact pieces
in one pass over a text; the places they point at are verified with Myers'
bit-parallel edit distance.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outfold.llm.common import slices, texts

#: One edit is allowed for this many characters of an item.
CHARS_PER_EDIT = 20
#: Scripts without blanks between words (Thai to Myanmar, Khmer, Kana, Han), and
#: Hangul, whose particles follow a word without one.
UNSPACED = (("\u0e00", "\u109f"), ("\u1100", "\u11ff"), ("\u1780", "\u17ff"), ("\u3040", "\u318f"),
            ("\u31f0", "\u31ff"), ("\u3400", "\u9fff"), ("\uac00", "\ud7ff"), ("\uf900", "\ufaff"),
            ("\U00020000", "\U0003ffff"))
#: Characters of items that one automaton holds; more items, more passes.
BLOCK_CHARS = 4_000_000


def normal(text: str) -> str:
    """Lower case, single blanks."""
    return " ".join(text.lower().split())


def in_word(text: str, at: int) -> bool:
    """Whether ``at`` lies inside a word of ``text``: a letter, digit, mark or
    underscore on both sides, neither of a script in ``UNSPACED``."""
    return 0 < at < len(text) and all(
        (c.isalnum() or c == "_" or unicodedata.category(c)[0] == "M")
        and not any(lo <= c <= hi for lo, hi in UNSPACED) for c in text[at - 1:at + 1])


def split(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces of nearly equal length and where they begin."""
    n, k = len(item), budget + 1
    cuts = [i * n // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


class Myers:
    """Bit-parallel approximate search of one pattern (Python integers as words
    of any length)."""

    def __init__(self, pattern: str):
        self.m = len(pattern)
        self.peq: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.peq[c] = self.peq.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """Smallest edit distance of the pattern to a substring of ``text``, and
        where the first such substring ends."""
        full, top, get = (1 << self.m) - 1, 1 << (self.m - 1), self.peq.get
        pv, mv, score = full, 0, self.m
        least, end = score, 0
        for i, c in enumerate(text):
            eq = get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (~(xh | pv) & full)
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
                if score < least:
                    least, end = score, i + 1
            ph = (ph << 1) & full
            mh = (mh << 1) & full
            pv = mh | (~(xv | ph) & full)
            mv = ph & xv
        return least, end


class Matcher:
    """All items of a block: automaton of the pieces, verifier of each item."""

    def __init__(self, items: list[tuple[int, str]], chars_per_edit: int, whole_words: bool = False):
        import ahocorasick
        self.whole_words = whole_words
        self.items = [(i, t, len(t) // chars_per_edit) for i, t in items]
        self.verify: dict[int, Myers] = {}
        pieces: dict[str, list[tuple[int, int]]] = {}
        for at, (_, t, budget) in enumerate(self.items):
            for offset, piece in split(t, budget):
                pieces.setdefault(piece, []).append((at, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item id, smallest distance, where that match ends) of items in the text."""
        if not len(self.automaton):
            return []
        spans: dict[int, list[list[int]]] = {}
        whole: dict[int, int] = {}  # where an exact item first ends
        for end, (size, places) in self.automaton.iter(text):
            for at, offset in places:
                _, t, budget = self.items[at]
                begin = end + 1 - size - offset  # the item would begin here, give or take
                if self.whole_words and not budget:  # the piece is the item
                    if not in_word(text, begin) and not in_word(text, end + 1):
                        whole.setdefault(at, end + 1)
                    continue
                lo, hi = begin - budget, begin + len(t) + budget
                have = spans.setdefault(at, [])
                if have and lo <= have[-1][1]:
                    have[-1][0] = min(have[-1][0], lo)
                    have[-1][1] = max(have[-1][1], hi)
                else:
                    have.append([lo, hi])
        out = [(self.items[at][0], 0, end) for at, end in whole.items()]
        for at, places in spans.items():
            key, t, budget = self.items[at]
            verifier = self.verify.get(at)
            if verifier is None:
                verifier = self.verify[at] = Myers(t)
            best = None
            for lo, hi in places:
                lo = max(0, lo)
                distance, end = verifier.best(text[lo:max(0, hi)])
                if distance <= budget and (best is None or distance < best[0]):
                    best = (distance, lo + end)
            if best:
                out.append((key, *best))
        return out


def item_blocks(items: DataFrame, item_col: str | None, text_col: str, block_chars: int = BLOCK_CHARS
                ) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most ``block_chars`` characters (or one item),
    read one partition at a time. Null or blank items match nothing and are left
    out, as are null ids; without ``item_col`` ids are not read and all are 0."""
    key = F.col(item_col) if item_col else F.lit(0)
    rows = items.select(key.cast("long").alias("i"), F.col(text_col).cast("string").alias("t")
                        ).where("i is not null and t is not null").dropDuplicates(["i", "t"]).orderBy("i", "t")
    block, size = [], 0
    for r in rows.toLocalIterator():
        t = normal(r["t"])
        if not t:
            continue
        if block and size + len(t) > block_chars:
            yield block
            block, size = [], 0
        block.append((r["i"], t))
        size += len(t)
    if block:
        yield block


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text",
          chars_per_edit: int = CHARS_PER_EDIT, whole_words: bool = False) -> DataFrame:
    """(id, item id, ``distance``, ``match_end``) of every item that stands in a
    document with at most len(item) // ``chars_per_edit`` edits, both in lower
    case with single blanks; ``match_end`` counts characters of that form. With
    ``whole_words``, an item that allows no edit neither begins nor ends inside
    a longer word.

    The items are the query set: blocks of them of a bounded size go to all
    tasks, each block in one pass over the documents, without a shuffle. Null
    or empty texts and items match nothing. Repeated documents are reported
    each; of items with one id and several texts, each text that matches gives
    a row. A null document id is kept, a null item id left out. Other columns
    are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, _item long, distance long, match_end long"
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t")
                       ).where("_t is not null and _t <> ''")
    out = None
    for block in item_blocks(items, item_col, item_text_col):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, chars_per_edit, whole_words)
            for b in slices(batches, "_t", 4 << 20):
                at, found = [], []
                for i, t in enumerate(texts(b.column("_t"))):
                    for hit in matcher.find(normal(t)):
                        at.append(i)
                        found.append(hit)
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [b.column("_id").take(pa.array(at, pa.int64())),
                         *(pa.array(c, pa.int64()) for c in zip(*found, strict=True))],
                        ["_id", "_item", "distance", "match_end"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionAll(part)
    if out is None:
        out = rows.limit(0).mapInArrow(lambda it: iter(()), schema)
    return out.withColumnRenamed("_id", id_col).withColumnRenamed("_item", item_col)


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text",
          item_text_col: str = "text", chars_per_edit: int = CHARS_PER_EDIT,
          whole_words: bool = True) -> DataFrame:
    """The rows of ``docs`` in which no item stands (see ``leaks``), with all
    their columns; one pass for each block of items, no shuffle. Item ids are not
    read: an item without one removes documents too."""
    spark = docs.sparkSession
    out = docs
    for block in item_blocks(items, None, item_text_col):
        sent = spark.sparkContext.broadcast(block)
        rows = out.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                          F.col(text_col).cast("string").alias("_t"))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, chars_per_edit, whole_words)
            for b in slices(batches, "_t", 4 << 20):
                stay = [not matcher.find(normal(t)) for t in texts(b.column("_t"))]
                yield b.select(["row"]).filter(pa.array(stay, pa.bool_()))

        out = rows.mapInArrow(run, rows.select("row").schema).select("row.*")
    return out
