"""Typed table scans (R1) and the layout-attribute schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The column names and order of the layout-attribute table,
# as its header states them. The three counts written as ``N.0`` are read as
# double and made integers by ``cast_exact``; declaring them int in a CSV
# schema silently nulls them (PERMISSIVE) or drops every row (DROPMALFORMED).
LAYOUT_SCHEMA = T.StructType([
    T.StructField("layout_id", T.StringType()),
    T.StructField("layout_type", T.StringType()),
    T.StructField("aisle_width_avg", T.DoubleType()),
    T.StructField("intersection_count", T.DoubleType()),
    T.StructField("one_way_ratio", T.DoubleType()),
    T.StructField("pack_station_count", T.DoubleType()),
    T.StructField("charger_count", T.DoubleType()),
    T.StructField("layout_compactness", T.DoubleType()),
    T.StructField("zone_dispersion", T.DoubleType()),
    T.StructField("robot_total", T.IntegerType()),
    T.StructField("building_age_years", T.IntegerType()),
    T.StructField("floor_area_sqm", T.IntegerType()),
    T.StructField("ceiling_height_m", T.DoubleType()),
    T.StructField("fire_sprinkler_count", T.IntegerType()),
    T.StructField("emergency_exit_count", T.IntegerType()),
])

LAYOUT_WHOLE_COUNTS = ("intersection_count", "pack_station_count", "charger_count")


def read_table(spark: SparkSession, path: str, schema: T.StructType,
               fmt: str = "csv", strict: bool = True) -> DataFrame:
    """Scan a header CSV (or parquet) with an explicit schema.

    ``strict``: a header whose names differ from the schema raises
    (``enforceSchema=False``) and a malformed field raises (``FAILFAST``)
    instead of being silently nulled. No ``inferSchema`` pass: types never
    depend on the data sampled.
    """
    if fmt == "parquet":
        df = spark.read.schema(schema).parquet(path)
        return df
    r = spark.read.schema(schema).option("header", True)
    if strict:
        r = r.option("enforceSchema", False).option("mode", "FAILFAST")
    return r.csv(path)


def csv_to_parquet(spark: SparkSession, src: str, dst: str, schema: T.StructType,
                   mode: str = "errorifexists", partitions: int | None = None) -> DataFrame:
    """Convert a header CSV to parquet once, so later scans are columnar,
    vectorised and prune columns and row groups; returns the parquet scan."""
    df = read_table(spark, src, schema)
    if partitions:
        df = df.repartition(partitions)
    df.write.mode(mode).parquet(dst)
    return spark.read.parquet(dst)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Header CSV written by the executors (one file per partition)."""
    df.write.mode(mode).option("header", True).csv(path)
