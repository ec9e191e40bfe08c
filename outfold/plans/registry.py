"""Registry of checked queries: key -> (Spark builder, DuckDB oracle SQL)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    key: str
    build: Builder
    oracle: str | None
    note: str = ""


_ENTRIES: dict[str, Entry] = {}


def register(key: str, oracle: str | None = None, note: str = ""):
    def deco(fn: Builder) -> Builder:
        if key in _ENTRIES:
            raise KeyError(f"duplicate query key {key!r}")
        _ENTRIES[key] = Entry(key, fn, oracle, note)
        return fn
    return deco


def entries() -> dict[str, Entry]:
    from outfold.plans import catalog  # noqa: F401  (registers on import)
    return dict(_ENTRIES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
