"""Join helpers.

No helper here puts an unchecked ``broadcast`` hint on data whose size grows
with the input.

- ``broadcast_bounded``: tables whose row count is bounded by a parameter
  (k folds, a rule list), checked against that bound.
- ``broadcast_checked``: tables derived from the data (per-group model
  tables). Catalyst cannot size an aggregate's output before running it, so it
  plans a sort-merge join, and AQE would then shuffle the large side in
  parallel with the small one before it could switch to a broadcast. Instead
  the small table is materialised in the shared folder, its rows and the bytes
  of its variable-length values are measured in one aggregate, and it is hinted
  as broadcast only when that size is under the session's
  ``spark.sql.autoBroadcastJoinThreshold``; beyond it the plain shuffle join
  stays, with AQE splitting skewed keys.
- ``join_hot``: as above, but beyond the threshold the rows of keys that would
  overload a task meet their (few) table rows by broadcast and stay where they
  are, so an aggregate above the join does not gather them in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outfold.session import scratch_path

# Largest row count we hint as broadcast without measuring; such tables are
# built from parameters (folds, rules, weights), never from data.
MAX_BOUNDED_ROWS = 100_000


def broadcast_bounded(df: DataFrame, bound: int) -> DataFrame:
    """Hint ``df`` as broadcast; ``bound`` is its proven maximum row count."""
    if bound > MAX_BOUNDED_ROWS:
        return df
    return F.broadcast(df)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the
    lineage, runs the plan once, and later reads take only the columns they need.
    The tables stay until ``session.clear_scratch``."""
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table_bytes(df: DataFrame) -> int:
    """Measured size of a materialised table: eight bytes for each field and
    row, and the real length of strings, binaries and nested values."""
    fixed = 8 * (len(df.schema.fields) + 1)
    lengths = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            lengths.append(F.octet_length(c))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            lengths.append(F.octet_length(F.to_json(F.struct(c))))
    size = F.lit(fixed).cast("bigint")
    for n in lengths:
        size = size + F.coalesce(n, F.lit(0))
    return df.agg(F.sum(size)).first()[0] or 0


def broadcast_threshold(spark) -> int:
    v = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    v = str(v).strip().lower()
    mult = {"b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}
    for suf in sorted(mult, key=len, reverse=True):
        if v.endswith(suf):
            return int(float(v[: -len(suf)]) * mult[suf])
    return int(v)


def broadcast_sized(df: DataFrame, n_bytes: int, max_bytes: int | None = None) -> DataFrame:
    """Hint ``df`` as broadcast only if ``n_bytes`` (a measured size or a proven
    upper bound) is within ``max_bytes`` (default: the session's broadcast
    threshold; negative never broadcasts)."""
    limit = broadcast_threshold(df.sparkSession) if max_bytes is None else max_bytes
    return F.broadcast(df) if 0 <= n_bytes <= limit else df


def broadcast_if_small(m: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """For an already materialised table: measure it, then ``broadcast_sized``."""
    limit = broadcast_threshold(m.sparkSession) if max_bytes is None else max_bytes
    if limit < 0:
        return m
    return broadcast_sized(m, table_bytes(m), limit)


def broadcast_checked(df: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Materialise a data-derived table, then ``broadcast_if_small``."""
    return broadcast_if_small(materialize(df), max_bytes)


def join_hot(rows: DataFrame, table: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of many rows with a materialised table of one row per ``key``,
    whose column ``size`` says how many of the ``total`` rows the key has (it is
    not returned).

    A table under the broadcast threshold is broadcast. Beyond it, keys with
    more than an even share of a shuffle partition number at most as many as
    there are partitions; these are broadcast, and only the other rows are
    shuffled by the key."""
    spark = table.sparkSession
    slim = table.drop(size)
    if 0 <= table_bytes(slim) <= broadcast_threshold(spark):
        return rows.join(F.broadcast(slim), key)
    share = total // int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = table.where(F.col(size) > share).drop(size)
    cold = table.where(F.col(size) <= share).drop(size)
    return rows.join(F.broadcast(hot), key).unionByName(
        rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def join_keys(left: DataFrame, right: DataFrame, keys, how: str = "inner",
              null_safe: bool = False) -> DataFrame:
    """Equi-join on same-named ``keys``; ``null_safe`` matches null to null.

    The result keeps one copy of each key column (from the left side, or
    from the right for a right join).
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    if not null_safe:
        return left.join(right, on=keys, how=how)
    r = right
    for c in keys:
        r = r.withColumnRenamed(c, f"__r_{c}")
    cond = None
    for c in keys:
        e = left[c].eqNullSafe(r[f"__r_{c}"])
        cond = e if cond is None else cond & e
    out = left.join(r, on=cond, how=how)
    if how in ("left_semi", "leftsemi", "semi", "left_anti", "leftanti", "anti"):
        return out
    if how in ("right", "right_outer", "rightouter"):
        for c in keys:
            out = out.withColumn(c, F.col(f"__r_{c}"))
    elif how in ("full", "outer", "full_outer", "fullouter"):
        for c in keys:
            out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"__r_{c}")))
    return out.drop(*[f"__r_{c}" for c in keys])
