"""Repeated phrases, found by grouping hashes.

Of every ``width`` words, the phrase of ``gram`` words at the window's anchor
stands for the window, and phrases that occur once are dropped by a count. Which
words go is then decided by grouping hashes of runs, blocks and windows
(``passages``). Automata over the recurring phrases are not used: their number
grows with the corpus, so every document would pass through ever more shards
(measured figures in the README).
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outfold.llm.common import Workspace
from outfold.llm.passages import Words, remove_repeats, rows_of, sample

WIDTH, GRAM = 20, 6
#: Windows of a block when a run is taken apart.
BLOCK = 4


def repeated_phrases(docs: DataFrame, width: int = WIDTH, gram: int = GRAM,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``n_words``, ``n_removed``, ``n_spans`` and ``kept_sha256`` of each
    document after every word covered by a window of ``width`` words that also
    starts earlier (smaller id, or earlier in the document) is taken away;
    ``kept_sha256`` is of the kept words joined by one blank.

    Words stand between ASCII blanks (x20, x09-x0D). Null text: no words.
    Documents shorter than ``width`` words lose nothing. Rows of one id stand
    at the same place: neither is earlier than the other. A null id comes
    before all others. Empty table: empty result. Other columns are not read.
    """
    if not 1 <= gram <= width:
        raise ValueError("need 1 <= gram <= width")
    ws = Workspace(docs.sparkSession, "phrases")
    rows = rows_of(docs, id_col, text_col)
    make = partial(Words, width, gram)
    runs, path = ws.save_at(sample(rows, make), "runs")
    often = runs.groupBy("_key").agg(F.sum("_m").alias("_c")).where("_c > 1").select("_key")
    often = ws.save(often, "often")  # written, so that Spark can split a hot key's join
    recurring = ws.save(runs.hint("merge").join(often, "_key"), "recurring")
    ws.drop(path)
    return remove_repeats(rows, recurring, make, ws, BLOCK, True, id_col, "words")
