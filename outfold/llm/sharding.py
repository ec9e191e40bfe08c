"""Contiguous shards of nearly equal bytes, with DataFrame functions only.

Rows are ordered by (id, text checksum, size) with a range partitioning. Each
partition gives its number of rows and its bytes; prefix sums of these few
totals say where each partition begins; a running sum inside a partition gives
every row its place in the whole order. The order is cut at equal byte targets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outfold.llm.common import Workspace


def byte_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``size``, ``text_crc32``, ``law``,
    ``shard``, ``slot`` and ``grown_shard``.

    ``size`` is the UTF-8 bytes of the text plus 1. A row goes to the shard in
    which its middle byte falls, so every shard is within one row's size of
    the target at each end. ``slot`` counts rows from 0 in each shard.
    ``grown_shard`` is null: byte targets move when a shard is added.

    Null or empty text: size 1, checksum 0. Repeated rows: each gets a slot of
    its own. A null id sorts first. An empty table gives an empty result. Other
    columns, whatever their names, are not read.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    ws = Workspace(docs.sparkSession, "shards")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"),
                       (F.octet_length(text) + 1).cast("long").alias("_size"),
                       F.crc32(text.cast("binary")).alias("_crc"))
    # A table, so that the cut points cannot differ between the passes below.
    rows = ws.save(rows.repartitionByRange("_id", "_crc", "_size")
                   .withColumn("_part", F.spark_partition_id())
                   .sortWithinPartitions("_id", "_crc", "_size"), "rows")
    totals = rows.groupBy("_part").agg(F.sum("_size").alias("_b"), F.count("*").alias("_n"))
    # One row per partition, not per document.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "_part", F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_b0"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        F.sum("_b").over(Window.orderBy("_part").rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"))
    inside = Window.partitionBy("_part").orderBy("_id", "_crc", "_size")
    placed = (rows.withColumn("_end", F.sum("_size").over(inside.rowsBetween(
                  Window.unboundedPreceding, 0)))
              .withColumn("_i", F.row_number().over(inside))
              .join(totals, "_part")
              .withColumn("_mid", 2 * (F.col("_b0") + F.col("_end")) - F.col("_size"))
              .withColumn("_shard", F.least(F.lit(shards - 1), F.expr(
                  f"(_mid * {int(shards)}L) div (2L * _all)")).cast("int"))
              .withColumn("_i", F.col("_n0") + F.col("_i") - 1)
              .select("_id", "_size", "_crc", "_shard", "_i"))
    placed = ws.save(placed, "placed")
    first = placed.groupBy("_shard").agg(F.min("_i").alias("_first"))  # one row per shard
    return placed.join(F.broadcast(first), "_shard").select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"), (F.col("_i") - F.col("_first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
