"""Merkle manifest of a dataset: a content-addressed DAG of digests.

Every row is a leaf, the sha256 of its fields. Within a group the leaves are put
in order, and every 8 consecutive nodes become one node of the next level, until
one is left: the group's subroot. The subroots, in the order of their groups,
are put together in the same way; what is left is the root.

``build`` stores one record for each inner node, ``digest -> children``, and
nothing else about the shape: equal parts of the data are one record. ``prove``
answers requests for leaves by descent: starting at the root, the digits of a
leaf's rank (base 8) choose a child at every record; the children not chosen are
collected as one path segment; the segments in reverse are the proof. Requests
with a common beginning of their ranks share one row until they part, so the
rows of a step are the nodes visited, not requests times levels, and no record is
asked for by more rows than there are nodes with its digest.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outfold.llm.common import Workspace

#: Children of a full node.
FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(*values: Column) -> Column:
    """sha256 (lowercase hex) of the values: ``-`` for null, else the number of
    UTF-8 bytes, ``:`` and the value as text."""
    parts = []
    for v in values:
        v = v.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


@dataclass
class Manifest:
    """``store``: (digest, children), one row per different inner node.
    ``leaves``: (_t, _n, _r, _id, _carry): the place of the group among the
    groups, its number of leaves, the leaf's rank in it, its id and what was
    carried along. ``groups`` and ``largest``: how many groups, and the most
    leaves in one; ``root``: None for an empty dataset."""
    store: DataFrame
    leaves: DataFrame
    groups: int
    largest: int
    root: str | None


def _ranked(rows: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """``rows`` (_g, _id, _digest, _carry) with ``_r``, the rank by (_id, _digest)
    within _g from 0, and ``_n``, the rows of _g.

    A range partitioning puts all rows in order, whatever the sizes of the
    groups; each (partition, group) counts its rows and prefix sums of the
    counts say where its ranks begin. ``_salt`` parts equal rows."""
    rows = ws.save(rows, name)
    keys = ["_g", "_id", "_digest", "_salt"]
    dealt = ws.save(rows.withColumn("_salt", F.monotonically_increasing_id())
                    .repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()),
                    name + "-dealt")
    of_group = Window.partitionBy("_g")
    before = of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_g", "_part").agg(F.count("*").alias("_c")).select(
        "_g", "_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"),
        F.sum("_c").over(of_group).alias("_n"))
    inside = Window.partitionBy("_part", "_g").orderBy("_id", "_digest", "_salt")
    return ws.save(dealt.withColumn("_i", F.row_number().over(inside) - 1)
                   .join(totals, ["_part", "_g"])
                   .select("_g", "_id", "_digest", "_carry", "_n",
                           (F.col("_before") + F.col("_i")).alias("_r")), name + "-ranked")


def _grow(ranked: DataFrame, ws: Workspace, name: str) -> tuple[list[DataFrame], DataFrame, int]:
    """Inner nodes of all levels, (_g, _digest, _n) of each group's last node
    with its number of leaves, and the largest such number."""
    largest = ranked.agg(F.max("_n")).first()[0] or 0
    level = ranked.select("_g", F.col("_r").alias("_i"), "_digest", F.col("_n").alias("_m"), "_n")
    records, done = [], [level.where("_m = 1")]
    left = largest
    while left > 1:
        nodes = level.where("_m > 1").groupBy(
            "_g", F.expr(f"_i div {FAN}").alias("_i"), "_m", "_n").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("_i", "_digest"))),
                        lambda s: s["_digest"]).alias("_children"))
        nodes = ws.save(nodes.withColumn(
            "_digest", F.sha2(F.concat_ws("", "_children").cast("binary"), 256)), name)
        records.append(nodes.select("_digest", "_children"))
        level = nodes.select("_g", "_i", "_digest",
                             F.expr(f"(_m + {FAN - 1}) div {FAN}").alias("_m"), "_n")
        done.append(level.where("_m = 1"))
        left = -(-left // FAN)
    tops = done[0]
    for d in done[1:]:
        tops = tops.unionAll(d)
    return records, tops.select("_g", "_digest", "_n"), largest


def build(docs: DataFrame, fields: Sequence[str] = FIELDS, group_col: str = "lang",
          id_col: str = "doc_id", carry: Column | None = None) -> Manifest:
    """The manifest of ``docs``. Leaves ascend by id within a group (null ids
    first, ties by digest); groups ascend by the UTF-8 bytes of their value,
    null first. ``carry``: a column that stays with each leaf.

    Null fields count as ``-``, so null and empty differ. Repeated rows are
    leaves of their own. Empty table: no root. Other columns are not read."""
    ws = Workspace(docs.sparkSession, "merkle")
    group = F.col(group_col).cast("string")
    rows = docs.select(
        F.coalesce(F.concat(F.lit("1"), group), F.lit("0")).alias("_g"), F.col(id_col).alias("_id"),
        leaf_digest(*[F.col(f) for f in fields]).alias("_digest"),
        (F.lit(None).cast("string") if carry is None else carry).alias("_carry"))
    leaves = _ranked(rows, ws, "leaves")
    records, tops, largest = _grow(leaves, ws, "nodes")
    heads = _ranked(tops.select(F.lit("").alias("_g"), F.col("_g").alias("_id"), "_digest",
                                F.col("_n").alias("_carry")), ws, "groups")
    upper, last, groups = _grow(heads, ws, "upper")
    root = last.first()
    store = tops.select("_digest", F.array("_digest").alias("_children")).limit(0)
    for r in records + upper:
        store = store.unionAll(r)
    store = ws.save(store.dropDuplicates(["_digest"]), "store")
    # A group's place is found by its value: one row per group, any number of them.
    places = heads.select(F.col("_id").alias("_g"), F.col("_r").alias("_t"))
    leaves = leaves.join(places, "_g").select("_t", "_n", "_r", "_id", "_carry")
    return Manifest(store, leaves, groups, largest, root["_digest"] if root else None)


def _wanted(requests: DataFrame, key: list[str], index: str, levels: int, ws: Workspace
            ) -> list[DataFrame]:
    """For each level from 0: the different (key, node) on the way to a request."""
    out = [requests.select(*key, F.col(index).cast("long").alias("_w")).distinct()]
    for _ in range(levels):
        out.append(ws.save(out[-1].select(*key, F.expr(f"_w div {FAN}").alias("_w")).distinct(), "wanted"))
    return out


def _levels(n: int) -> int:
    out = 0
    while n > 1:
        n, out = -(-n // FAN), out + 1
    return out


def _descend(visited: DataFrame, store: DataFrame, wanted: DataFrame, key: list[str], keep: list[str]
             ) -> DataFrame:
    """Each visited node (_w, _digest, _path) gives way to its wanted children."""
    kids = visited.join(store, "_digest").select(
        *keep, F.col("_w").alias("_up"), "_path", "_children",
        F.posexplode("_children").alias("_pos", "_digest"))
    segment = F.struct(F.expr("array_join(slice(_children, 1, _pos), '')").alias("left"),
                       F.expr(f"array_join(slice(_children, _pos + 2, {FAN}), '')").alias("right"))
    kids = kids.select(*keep, (F.col("_up") * FAN + F.col("_pos")).alias("_w"), "_digest",
                       F.concat("_path", F.array(segment)).alias("_path"))
    return kids.join(wanted, [*key, "_w"], "left_semi")


def prove(m: Manifest, requests: DataFrame) -> DataFrame:
    """For each request, a row of ``m.leaves`` (all or some, with more columns
    if need be): ``leaf`` and ``subroot`` as found by the descent, and
    ``path``: an array of (left, right), the digests beside the way from the leaf
    up to the root, joined. No request: no row."""
    spark = m.store.sparkSession
    ws = Workspace(spark, "proofs")
    start = spark.range(1 if m.root else 0).select(
        F.lit(0).cast("long").alias("_w"), F.lit(m.root).alias("_digest"),
        F.array().cast("array<struct<left:string,right:string>>").alias("_path"))
    # From the root to the subroots of the groups asked for ...
    groups = requests.select("_t", "_n").distinct()
    top = _levels(m.groups)
    wanted = _wanted(groups, [], "_t", top, ws)
    at = start
    for level in reversed(range(top)):
        at = _descend(at, m.store, wanted[level], [], [])
    at = at.select(F.col("_w").alias("_t"), F.col("_digest").alias("_subroot"), "_digest", "_path",
                   F.lit(0).cast("long").alias("_w")).join(groups, "_t")
    # ... and from there to the nodes above the leaves; small groups wait.
    deep = _levels(m.largest)
    wanted = _wanted(requests, ["_t"], "_r", deep, ws)
    keep = ["_t", "_n", "_subroot"]
    for level in reversed(range(1, deep)):
        high = F.col("_n") > FAN ** level
        at = _descend(at.where(high), m.store, wanted[level], ["_t"], keep).unionByName(
            at.where(~high).select(*keep, "_w", "_digest", "_path"))
        if level % 2 == 0:  # both branches read ``at``
            at = ws.save(at, "visited")
    last = ws.save(at.join(m.store, "_digest", "left").select(
        "_t", F.col("_w").alias("_up"), "_subroot", "_path",
        F.when(F.col("_n") == 1, F.array("_digest")).otherwise(F.col("_children")).alias("_children")),
        "last")
    place = F.col("_pos").cast("int")
    found = requests.withColumn("_up", F.expr(f"_r div {FAN}")).withColumn(
        "_pos", F.col("_r") % FAN).join(last, ["_t", "_up"])
    own = F.array(F.struct(
        F.array_join(F.slice("_children", F.lit(1), place), "").alias("left"),
        F.array_join(F.slice("_children", place + 2, F.lit(FAN)), "").alias("right")))
    return found.select(
        *[F.col(f"`{c}`") for c in requests.columns], F.element_at("_children", place + 1).alias("leaf"),
        F.col("_subroot").alias("subroot"),
        F.when(F.col("_n") > 1, F.concat(own, F.reverse("_path"))).otherwise(
            F.reverse("_path")).alias("path"))


def proof_digest(path: Column) -> Column:
    """sha256 of the digests of a proof, from the leaf to the root."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")
                  .cast("binary"), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf's digest and its proof."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(
        F.concat(s["left"], acc, s["right"]).cast("binary"), 256))


def tamper_check(docs: DataFrame, fields: Sequence[str] = FIELDS, group_col: str = "lang",
                 id_col: str = "doc_id", text_col: str = "text",
                 tampered: Column | None = None) -> DataFrame:
    """A proof for every row: id, ``leaf``, ``subroot``, ``root``,
    ``proof_sha256``, ``folded_root`` and ``verified``.

    ``tampered`` marks rows whose text is shown with A-Z in lower case (default:
    3 divides the CRC-32 of the id in decimal); ``folded_root`` follows from the
    shown row and the proof, and ``verified`` says whether it is the root. A null
    text or id is never tampered with. See ``build`` for nulls, ties, repeated
    rows and empty tables."""
    if tampered is None:
        tampered = F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 0
    low = F.translate(F.col(text_col).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                      "abcdefghijklmnopqrstuvwxyz")
    shown = leaf_digest(*[low if f == text_col else F.col(f) for f in fields])
    m = build(docs, fields, group_col, id_col, carry=F.when(tampered, shown))
    proofs = prove(m, m.leaves)
    return proofs.select(
        F.col("_id").alias(id_col), "leaf", "subroot", F.lit(m.root).alias("root"),
        proof_digest(F.col("path")).alias("proof_sha256"),
        fold(F.coalesce("_carry", "leaf"), F.col("path")).alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
