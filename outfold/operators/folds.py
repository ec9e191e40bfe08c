"""Fold assignment: row-wise (R2), group-wise (D19) and stratified (D20)."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outfold.functions.folds import _key, fold_col, hash32
from outfold.operators.joins import broadcast_bounded, broadcast_checked, join_keys


def check_folds(stats: DataFrame, fold: str, k: int) -> None:
    """Raise ValueError if a small table of per-fold statistics holds a fold
    outside 0..k-1: its rows would be scored by a model that was trained on them
    or by none. A null fold is allowed; such rows train nothing."""
    low, high = stats.agg(F.min(fold), F.max(fold)).first()
    if low is not None and (low < 0 or high >= k):
        raise ValueError(f"folds {low}..{high} are not in 0..{k - 1}")


def assign_fold(df: DataFrame, key, k: int, seed=None, out: str = "fold",
                method: str = "md5") -> DataFrame:
    """Add ``out`` = fold of the row key. No shuffle: a projection only."""
    return df.withColumn(out, fold_col(key, k, seed, method))


def assign_group_fold(df: DataFrame, group_key, k: int, seed=None,
                      out: str = "fold", method: str = "md5") -> DataFrame:
    """All rows sharing ``group_key`` land in one fold, so a group is never in
    train and test at once. Same hash as R2, applied to the group key."""
    return df.withColumn(out, fold_col(group_key, k, seed, method))


def pack_largest_first(sizes: list[int], k: int) -> list[int]:
    """The bin of each item: each goes to the least filled of ``k`` (ties: the first)."""
    load = [(0, f) for f in range(k)]
    out = []
    for n in sizes:
        total, f = heapq.heappop(load)
        heapq.heappush(load, (total + n, f))
        out.append(f)
    return out


def assign_balanced_group_fold(df: DataFrame, group_key: str, k: int, seed=None, out: str = "fold",
                               slots: int = 1024) -> DataFrame:
    """Group-wise folds of near equal size, whatever the groups' sizes: a group
    stays in one fold.

    Groups are hashed to ``slots`` slots and the slots' rows are counted; nothing
    but these counts is shuffled. Only in slots with more than twice an even share
    are groups counted one by one, and those with more than an even share (at most
    ``slots``) stand for themselves. These groups and the slots without them are
    packed largest first, each into the fold with the fewest rows; ties go by the
    slot, groups before slots and then by the group as a string. So two folds
    differ by no more than the largest item that comes after the first k, and
    usually by no more than the smallest one. Rows are not shuffled.

    The folds depend on the data: further rows can move groups. Rows without a
    group get a null fold and count for nothing.
    """
    if k < 1 or slots < 1:
        raise ValueError("need k >= 1 and slots >= 1")
    slot = fold_col(group_key, slots, seed)
    keyed = df.where(F.col(group_key).isNotNull()).select(
        slot.alias("s"), F.col(group_key).cast("string").alias("g"))
    size = {r["s"]: r["c"] for r in keyed.groupBy("s").agg(F.count(F.lit(1)).alias("c")).collect()}
    total = sum(size.values())
    full = [s for s, c in size.items() if c * slots > 2 * total]
    heavy = []
    if full:
        heavy = [(r["c"], r["s"], r["g"]) for r in keyed.where(F.col("s").isin(full)).groupBy("s", "g").agg(
            F.count(F.lit(1)).alias("c")).where(F.col("c") * slots > total).collect()]  # under ``slots`` rows
        for c, s, _ in heavy:
            size[s] -= c
    items = sorted([(-c, s, 0, g) for c, s, g in heavy] + [(-c, s, 1, "") for s, c in size.items() if c])
    folds = pack_largest_first([-i[0] for i in items], k)
    of_slot, of_group = [0] * slots, []
    for (_, s, kind, g), f in zip(items, folds, strict=True):
        if kind:
            of_slot[s] = f
        else:
            of_group.append((g, f))
    named = broadcast_bounded(df.sparkSession.createDataFrame(of_group, "__g string, __f long"), slots)
    own = F.element_at(F.lit(of_slot), (slot + 1).cast("int")).cast("bigint")
    return (df.join(named, F.col(group_key).cast("string") == F.col("__g"), "left")
            .withColumn(out, F.when(F.col(group_key).isNotNull(), F.coalesce("__f", own)))
            .drop("__g", "__f"))


def fold_sizes(df: DataFrame, fold: str = "fold", group_key=None) -> DataFrame:
    """Rows per fold, and distinct groups per fold when ``group_key`` is given."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    if group_key is not None:
        gk = [group_key] if isinstance(group_key, str) else list(group_key)
        aggs.append(F.count_distinct(*[F.col(c) for c in gk]).alias("n_groups"))
    return df.groupBy(fold).agg(*aggs)


def assign_strat_fold(df: DataFrame, by, key, k: int, seed=None, out: str = "fold",
                      buckets: int = 4096) -> DataFrame:
    """Stratified folds: within each ``by`` stratum, rows ordered by
    ``(md5(key), key)`` are dealt round-robin to folds, so each fold gets
    ``floor(n/k)`` or ``ceil(n/k)`` rows of every stratum.

    The rank is exact without sending a whole stratum to one task: ``buckets``
    equal ranges of the md5 prefix cut every stratum, one aggregate counts the
    rows of each (stratum, bucket), a cumulative sum over the at most
    ``buckets`` counts of a stratum gives where each bucket begins, and
    ``row_number`` runs inside a bucket only. Choose ``buckets`` so that the
    largest stratum over ``buckets`` fits a task's sort.
    """
    by = [by] if isinstance(by, str) else list(by)
    keycols = [key] if isinstance(key, str) else list(key)
    base = (df.withColumn("__md5", F.md5(_key(key, seed)))
            .withColumn("__b", F.floor(hash32(key, seed) * F.lit(buckets) / F.lit(2 ** 32)).cast("bigint")))
    counts = base.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__c"))
    wb = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "__b", F.coalesce(F.sum("__c").over(wb), F.lit(0)).alias("__off"))
    base = join_keys(base, broadcast_checked(offsets), [*by, "__b"], "inner", null_safe=True)
    wr = Window.partitionBy(*by, "__b").orderBy("__md5", *keycols)
    rank0 = F.col("__off") + F.row_number().over(wr) - 1
    return base.withColumn(out, (rank0 % F.lit(k)).cast("bigint")).drop("__md5", "__b", "__off")
