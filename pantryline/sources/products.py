"""Product dumps of the two sources, read with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pantryline.schemas import FDC_RAW, OFF_RAW


def _read(spark: SparkSession, path: str, fmt: str, schema) -> DataFrame:
    if fmt not in ("json", "parquet", "orc"):
        raise ValueError("nested dumps are read as json, parquet or orc")
    return spark.read.format(fmt).schema(schema).load(path)


def read_off(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Crowdsourced products: the eleven fields used, nutrient values kept as text."""
    return _read(spark, path, fmt, OFF_RAW)


def read_fdc(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Laboratory foods with their nutrient list."""
    return _read(spark, path, fmt, FDC_RAW)
