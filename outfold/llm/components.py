"""Connected components of a large graph by alternating star operations.

large-star links every neighbour larger than a vertex to the smallest vertex
around it, small-star every smaller one; both keep the components. When
nothing changes, each vertex is linked to the smallest vertex of its component.
The number of rounds grows with the logarithm of the graph's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outfold.llm.common import Workspace


def _star(edges: DataFrame, large: bool, ws: Workspace) -> DataFrame:
    """edges: (u, v), u > v. Rows keyed by a hub meet only the hub's smallest
    neighbour, a pre-aggregated row, which is written first: then a hot hub is a
    skewed join of two shuffles, which AQE splits."""
    if large:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        least = ws.save(least, "least")
        return both.where("v > u").join(least, "u").select(
            F.col("v").alias("u"), F.col("m").alias("v"))
    least = ws.save(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """(id, component) of every vertex of ``edges`` (columns a, b of long ids);
    component is the smallest id of the vertex's component."""
    now, path = ws.save_at(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(), "edges")

    def fingerprint(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    mark = fingerprint(now)
    while mark[0]:
        big = ws.save(_star(now, True, ws).where("u > v").distinct(), "big")
        small = _star(big, False, ws).where("u > v").distinct()
        new, new_path = ws.save_at(small, "edges")
        ws.drop(path)
        now, path = new, new_path
        last, mark = mark, fingerprint(now)
        if last == mark:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(
        now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
