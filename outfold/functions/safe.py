"""Scalar expressions that behave the same in Spark (ANSI on) and in SQL oracles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num, den) -> Column:
    """``num / den``, null when ``den`` is 0 or null (ANSI ``/`` raises on 0)."""
    return F.try_divide(col_(num), col_(den))


def known(c) -> Column:
    """The value as a double, null where it is null or NaN: what a model may
    learn from and a score may count."""
    x = col_(c).cast("double")
    return F.when(~F.isnan(x), x)


def abs_err(y, pred) -> Column:
    """Null (not scored, counted as missing) where either is null or NaN."""
    return F.abs(known(y) - known(pred))


def is_whole(c) -> Column:
    """True when a double holds a whole number (``34.0``), false for ``34.5``."""
    c = col_(c)
    return c == F.floor(c)


def exact_int(c, to: str = "int") -> Column:
    """Integer value of a whole-number double, null when it is not whole.

    Uses ``floor`` explicitly: a bare ``cast`` truncates in Spark and rounds in
    other engines.
    """
    c = col_(c)
    return F.when(is_whole(c), F.floor(c).cast(to))


def round_dec(c, scale: int = 6) -> Column:
    """Round half away from zero on the decimal value (through decimal(38,9)),
    as SQL engines do on decimals; a bare double ``round`` differs between
    engines on exact ties such as ``2131.5759375``."""
    return F.round(col_(c).cast("decimal(38,9)"), scale).cast("double")


def round_dec_sql(expr: str, scale: int = 6) -> str:
    return f"CAST(round(CAST({expr} AS DECIMAL(38,9)), {scale}) AS DOUBLE)"
