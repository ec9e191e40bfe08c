"""Token counts of whole texts by the whole-token shortcut."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outfold.llm.common import byte_lengths, slices, texts
from outfold.llm.tokens import whole_tokens, worker_words


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """id, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit``
    tokens) of each row; ``tokenizer`` is a .json file of the ``tokenizers``
    library. One that does not split in the form of ``tokens.SPLITS`` counts whole
    texts, without the shortcut.

    Which vocabulary strings are one token by themselves is proved once on the
    driver (bounded by the vocabulary) and sent to the tasks. One pass over the
    texts, no shuffle. Null or empty text: 0 tokens. Repeated rows are counted
    each by itself; a null id is kept. Other columns are not read.
    """
    proved = docs.sparkSession.sparkContext.broadcast(whole_tokens(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_words(tokenizer, proved.value)
        for b in slices(batches, "_t", 8 << 20):
            n = pa.array([words.count(t) for t in texts(b.column("_t"))], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), pa.array(byte_lengths(b.column("_t")), pa.int64()), n],
                ["_id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t"))
    return (rows.mapInArrow(run, f"_id {kind}, n_bytes long, n_tokens long")
            .select(F.col("_id").alias(id_col), "n_bytes", "n_tokens",
                    (F.col("n_tokens") > limit).alias("over_limit")))
