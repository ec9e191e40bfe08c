"""Column expressions for fold numbers.

``fold(c, k)`` is the first 32 bits of ``md5(string(c))`` modulo ``k``. It is
stateless: the same row gets the same fold on every run, with any partitioning,
on any number of executors, and a retried task recomputes the same value. It
also has an exact SQL twin, so an independent engine can check every fold.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _key(cols, seed) -> Column:
    cols = [cols] if isinstance(cols, (str, Column)) else list(cols)
    parts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    key = parts[0] if len(parts) == 1 else F.concat_ws("|", *parts)
    if seed is not None:
        key = F.concat(F.lit(f"{seed}:"), key)
    return key


def hash32(cols, seed=None) -> Column:
    """Unsigned 32-bit integer from md5 of the (seeded) key, as bigint."""
    return F.conv(F.substring(F.md5(_key(cols, seed)), 1, 8), 16, 10).cast("bigint")


def fold_col(cols, k: int, seed=None, method: str = "md5") -> Column:
    """Fold number in ``0..k-1`` for the key column(s) ``cols``.

    Keys must be integers or strings: doubles print differently across engines.
    ``method="xxhash64"`` hashes the typed key columns directly, several
    times cheaper per row and equally stateless and repeatable, but it has no
    SQL twin in other engines (and an int key hashes unlike the same value as
    a bigint); use it where no cross-engine check is needed.
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    if method == "xxhash64":
        cs = [cols] if isinstance(cols, (str, Column)) else list(cols)
        parts = ([F.lit(str(seed))] if seed is not None else []) + [
            F.col(c) if isinstance(c, str) else c for c in cs]
        return F.pmod(F.xxhash64(*parts), F.lit(k).cast("bigint"))
    if method != "md5":
        raise ValueError(f"unknown method {method!r}")
    return hash32(cols, seed) % F.lit(k).cast("bigint")


def fold_sql(expr: str, k: int, seed=None) -> str:
    """The same fold in DuckDB SQL, for oracles."""
    key = f"CAST({expr} AS VARCHAR)"
    if seed is not None:
        key = f"'{seed}:' || {key}"
    return f"(CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT) % {int(k)})"
