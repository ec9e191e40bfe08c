"""Language identification by prediction by partial matching (PPM).

Each language has a context tree of depth ``ORDER`` over classes of bytes: how
often each symbol followed each context of 0..3 symbols in its training texts;
contexts rarer than ``MIN_CONTEXT`` are left out. A symbol's
probability comes from the longest context that knows it, reached by escapes
(method C: a context of N observations and D different symbols escapes with
probability D/(N+D)). The statistics are frozen after training, so the code
length of every (context, symbol) is computed once into a table, and a text's
code length in a language is a sum of table entries over all its bytes. The
shortest code wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outfold.llm.common import slices, texts

ORDER = 3
SYMBOLS = 128
#: At most about this many training documents of each language are read
#: (hash sample); the rest of the labelled documents are not needed.
TRAIN_DOCS = 3000
#: A context seen less often over all languages is left to its shorter suffix.
MIN_CONTEXT = 8
#: Contexts whose probabilities are worked out at a time.
FIT_ROWS = 256

LETTER = re.compile(r"[^\W\d_]")


def _classes() -> np.ndarray:
    """Byte -> symbol 1..127 (0 stands before a text). Letters, UTF-8
    continuation bytes and the lead bytes of the commonest scripts keep a symbol
    of their own; digits share one, other ASCII characters share one."""
    out = np.zeros(256, dtype=np.uint8)
    out[:128] = 2                              # punctuation and control
    out[[9, 10, 11, 12, 13, 32]] = 1           # blanks
    out[48:58] = 3                             # digits
    out[97:123] = np.arange(4, 30)             # a-z (texts are lower-cased)
    out[65:91] = np.arange(4, 30)
    out[128:192] = np.arange(30, 94)           # continuation bytes
    out[192:224] = 94                          # two-byte leads
    for k, b in enumerate((0xC3, 0xC4, 0xC5, 0xCE, 0xCF, 0xD0, 0xD1, 0xD7, 0xD8, 0xD9)):
        out[b] = 95 + k
    out[224:240] = np.arange(105, 121)         # three-byte leads
    out[240:] = 121
    return out


CLASSES = _classes()


def symbols(text: str) -> np.ndarray:
    return CLASSES[np.frombuffer(text.lower().encode("utf-8", "replace"), dtype=np.uint8)]


def grams(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context of 3 symbols, next symbol) of all texts end to end, and where
    each text begins; before a text stands symbol 0."""
    pad = np.zeros(ORDER, dtype=np.uint8)
    flat = np.concatenate([x for s in lists for x in (pad, s)]).astype(np.int64)
    lens = np.array([len(s) for s in lists])
    context = (flat[:-3] << 14) | (flat[1:-2] << 7) | flat[2:-1]
    begin = np.cumsum(lens + ORDER) - lens - ORDER
    keep = np.ones(len(flat) - ORDER, dtype=bool)
    for k in range(ORDER):  # what would run from one text into the next
        cut = begin[1:] - 1 - k
        keep[cut[cut >= 0]] = False
    return context[keep], flat[ORDER:][keep], np.cumsum(lens) - lens


class Model:
    """Frozen code lengths (nats): ``cost[row, symbol, language]``; ``row_of``
    gives the deepest kept context for any three symbols."""

    def __init__(self, langs: list[str], row_of: np.ndarray, cost: np.ndarray):
        self.langs, self.row_of, self.cost = langs, row_of, cost

    @classmethod
    def fit(cls, counts: list[tuple[str, int, int]]) -> Model:
        """counts: (language, context * SYMBOLS + symbol, how often)."""
        langs = sorted({c[0] for c in counts})
        at = {lang: i for i, lang in enumerate(langs)}
        return cls.fit_arrays(langs, np.array([at[c[0]] for c in counts], dtype=np.int64),
                              np.array([c[1] for c in counts], dtype=np.int64),
                              np.array([c[2] for c in counts], dtype=np.int64))

    @classmethod
    def fit_arrays(cls, langs: list[str], lang: np.ndarray, code: np.ndarray, n: np.ndarray) -> Model:
        """The same from arrays; ``lang`` holds places in ``langs``. Beside the tables
        only ``FIT_ROWS`` contexts are worked on at a time."""
        n, n_lang = n.astype(np.float64), len(langs)
        known = np.full((1, SYMBOLS, n_lang), 1.0 / SYMBOLS)
        costs, rows, parent_row = [], 0, None
        for order in range(ORDER + 1):
            size = SYMBOLS ** order
            context = (code // SYMBOLS) % size
            kept = np.flatnonzero(np.bincount(context, n, minlength=size) >= (MIN_CONTEXT if order else 0))
            if not len(kept):
                break
            place = np.full(size, -1, dtype=np.int32)
            place[kept] = np.arange(len(kept))
            place = place[context]
            use = np.argsort(place, kind="stable")
            begin = np.searchsorted(place[use], np.arange(0, len(kept) + FIT_ROWS, FIT_ROWS))
            cost = np.empty((len(kept), SYMBOLS, n_lang), dtype=np.float32)
            table = np.empty(cost.shape if order < ORDER else (0, SYMBOLS, n_lang))
            for k, lo in enumerate(range(0, len(kept), FIT_ROWS)):
                some, now = use[begin[k]:begin[k + 1]], kept[lo:lo + FIT_ROWS]
                freq = np.zeros((len(now), SYMBOLS, n_lang))
                np.add.at(freq, (place[some] - lo, code[some] % SYMBOLS, lang[some]), n[some])
                below = known if parent_row is None else known[parent_row[now % SYMBOLS ** (order - 1)]]
                seen, kinds = freq.sum(1), (freq > 0).sum(1)
                escape = np.where(seen > 0, kinds / np.maximum(seen + kinds, 1), 1.0)
                p = np.where(freq > 0, freq / np.maximum(seen + kinds, 1)[:, None, :],
                             escape[:, None, :] * below)
                cost[lo:lo + FIT_ROWS] = -np.log(p)
                if order < ORDER:  # the deepest contexts are no one's suffix
                    table[lo:lo + FIT_ROWS] = p
            costs.append(cost)
            known = table if parent_row is None else np.concatenate([known, table])
            # contexts that are not kept fall back to the row of their suffix
            row = np.zeros(1, dtype=np.int32) if parent_row is None else np.tile(parent_row, SYMBOLS)
            row[kept] = rows + np.arange(len(kept))
            rows += len(kept)
            parent_row = row
        return cls(langs, np.resize(parent_row, SYMBOLS ** ORDER),
                   np.concatenate(costs).reshape(-1, max(1, n_lang)))

    def code_lengths(self, lists: list[np.ndarray]) -> np.ndarray:
        """Nats of each text in each language."""
        out = np.zeros((len(lists), max(1, len(self.langs))))
        full = [i for i, s in enumerate(lists) if len(s)]
        if full and self.langs:
            context, symbol, begin = grams([lists[i] for i in full])
            cost = self.cost[self.row_of[context].astype(np.int64) * SYMBOLS + symbol]
            out[full] = np.add.reduceat(cost, begin, axis=0, dtype=np.float64)
        return out


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> Model:
    """Fit on a hash sample of about ``train_docs`` rows of each language (all,
    where a language has fewer). Rows without text or language teach nothing.
    Counting runs in Spark; the driver gets one row per (language, context,
    symbol), bounded by the sample."""
    rows = labelled.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t"),
                           F.col(lang_col).cast("string").alias("_l")
                           ).where("_l is not null and _t is not null and _t <> ''")
    sizes = rows.groupBy("_l").count().collect()  # one row per language
    if not sizes:
        return Model.fit([])
    grid = 1 << 30
    keep = F.lit(False)
    for r in sizes:
        share = min(1.0, train_docs / r["count"])
        keep = keep | ((F.col("_l") == r["_l"]) &
                       (F.pmod(F.xxhash64("_id"), F.lit(grid)) < int(share * grid) + (share == 1.0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_t", 2 << 20):
            lang = np.array(b.column("_l").to_pylist())
            lists = [symbols(t) for t in texts(b.column("_t"))]
            for x in np.unique(lang):
                context, symbol, _ = grams([s for s, y in zip(lists, lang, strict=True) if y == x])
                code, n = np.unique(context * SYMBOLS + symbol, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([str(x)] * len(code)), pa.array(code, pa.int64()),
                     pa.array(n, pa.int64())], ["lang", "code", "n"])

    counts = (rows.where(keep).mapInArrow(run, "lang string, code long, n long")
              .groupBy("lang", "code").agg(F.sum("n").alias("n")))
    table = counts.toArrow()
    names = table.column("lang").combine_chunks().dictionary_encode()
    langs = sorted(names.dictionary.to_pylist())
    place = np.array([langs.index(x) for x in names.dictionary.to_pylist()], dtype=np.int64)
    return Model.fit_arrays(langs, place[names.indices.to_numpy()],
                            table.column("code").to_numpy(), table.column("n").to_numpy())


def predict(docs: DataFrame, model: Model, keep: Column, text_col: str = "text",
            unknown: str = "und") -> DataFrame:
    """``kept`` (the column ``keep``, such as an id or a struct of a whole row),
    ``lang_pred``, ``score`` and ``nats_per_byte`` of each row.

    ``score`` is the share of the winning language if each were as likely
    before reading the text. A text that is null or has no letter is
    ``unknown`` with score 0, as is every text if the model has no language.
    Equal code lengths: the language that sorts first. Repeated rows and null
    ids are kept; only the text is read. One pass, no shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by SYMBOLS and ORDER

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in slices(batches, "_t", 1 << 19):
            strings = texts(b.column("_t"))
            lists = [symbols(t) if m.langs and LETTER.search(t) else np.empty(0, np.uint8)
                     for t in strings]
            nats = m.code_lengths(lists)
            best = nats.argmin(axis=1)
            least = nats[np.arange(len(best)), best]
            share = 1 / np.exp(np.maximum(least[:, None] - nats, -700)).sum(axis=1)
            known = np.array([len(s) > 0 for s in lists], dtype=bool)
            size = np.maximum([len(s) for s in lists], 1)
            yield pa.RecordBatch.from_arrays(
                [b.column("kept"),
                 pa.array([m.langs[i] if k else unknown for i, k in zip(best, known, strict=True)],
                          pa.string()),
                 pa.array(np.where(known, share, 0.0), pa.float64()),
                 pa.array(np.where(known, least / size, 0.0), pa.float64())],
                ["kept", "lang_pred", "score", "nats_per_byte"])

    rows = docs.select(keep.alias("kept"), F.col(text_col).cast("string").alias("_t"))
    schema = T.StructType([rows.schema["kept"], *T.StructType.fromDDL(
        "lang_pred string, score double, nats_per_byte double").fields])
    return rows.mapInArrow(run, schema)


#: Nats per byte above which a text speaks for no learned language, and how many
#: nats it must be above that in all. Texts of sf0.01 cost 0.9 to 3.1 (German texts
#: under a model without German at most 4.6, Polish 7.9); random letters and
#: digits cost 9.1, scripts that were never seen 13.
MAX_NATS = 8.0
SLACK = 100.0


def rejected(text: Column, max_nats: float = MAX_NATS, slack: float = SLACK) -> Column:
    """For rows of ``predict``: is the text in none of the learned languages? It has
    no letter, or its best code length is more than ``slack`` nats above ``max_nats``
    a byte, so that a few odd words decide nothing."""
    over = (F.col("nats_per_byte") - max_nats) * F.coalesce(F.octet_length(text), F.lit(0)) > slack
    return (F.col("lang_pred") == "und") | over


def with_letter(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has a letter, with all their columns; no
    model is needed."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col(text_col).cast("string").alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_t", 4 << 20):
            stay = [LETTER.search(t) is not None for t in texts(b.column("_t"))]
            yield b.select(["row"]).filter(pa.array(stay, pa.bool_()))

    return rows.mapInArrow(run, rows.select("row").schema).select("row.*")


def held_out(id_col: str = "doc_id"):
    """True for documents whose crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
