"""Keyed de-duplication with an explicit order, so results never depend on task order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def first_wins(df: DataFrame, keys: list[str], order: Column, keep: list[str]) -> DataFrame:
    """One row per key: the `keep` columns of the row with the smallest `order`.

    `min_by` aggregates map-side, so a hot key costs one row per task in the shuffle.
    """
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*keep), order).alias("__row"))
    return picked.select(*keys, *[F.col("__row")[c].alias(c) for c in keep])


def last_wins(df: DataFrame, keys: list[str], order: Column, keep: list[str]) -> DataFrame:
    """One row per key: the `keep` columns of the row with the largest `order`."""
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*keep), order).alias("__row"))
    return picked.select(*keys, *[F.col("__row")[c].alias(c) for c in keep])


def _filled(df: DataFrame, columns: list[str]) -> Column:
    """How many of the columns hold something: no null, empty text or empty array."""
    total = F.lit(0)
    for name in columns:
        kind = df.schema[name].dataType.typeName()
        c = F.col(name)
        some = (c != "") if kind == "string" else (F.size(c) > 0) if kind == "array" else c.isNotNull()
        total = total + F.coalesce(some.cast("int"), F.lit(0))
    return total


def one_per_key(df: DataFrame, key: str) -> DataFrame:
    """One whole row per key: the one with most columns filled, of these the smallest.

    Equal rows are the only possible ties.
    """
    rest = [c for c in df.columns if c != key]
    row = F.struct((-_filled(df, rest)).alias("empty"), F.struct(*rest).alias("row"))
    picked = df.groupBy(key).agg(F.min(row)["row"].alias("__row"))
    return picked.select(key, *[F.col("__row")[c].alias(c) for c in rest])
