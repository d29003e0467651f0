"""Key/value metadata: upsert, lookup, map form."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def upsert(old: DataFrame, new: DataFrame, seq: str | None = None) -> DataFrame:
    """(key, value) after writing `new` over `old`; the newest `seq` of a key wins.

    Without `seq` the rows of `new` beat those of `old`, and `new` must name each key
    once. Rows with equal `seq` are settled by the larger value.
    """
    if seq is None:
        rows = old.select("key", "value", F.lit(0).alias("__seq")).unionByName(
            new.select("key", "value", F.lit(1).alias("__seq"))
        )
    else:
        rows = old.select("key", "value", F.col(seq).alias("__seq")).unionByName(
            new.select("key", "value", F.col(seq).alias("__seq"))
        )
    return (
        rows.groupBy("key")
        .agg(F.max_by("value", F.struct("__seq", "value")).alias("value"))
        .select("key", "value")
    )


def lookup(metadata: DataFrame, key: str) -> DataFrame:
    """The value stored under `key`; no row when it is missing."""
    return metadata.filter(F.col("key") == key).select("value")


def value_of(metadata: DataFrame, key: str) -> str | None:
    """The value stored under `key`, fetched."""
    row = lookup(metadata, key).first()
    return row["value"] if row else None


def as_map(metadata: DataFrame) -> DataFrame:
    """All pairs as one map. Keys are the handful of metadata names of one dataset."""
    return metadata.agg(
        F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("metadata")
    )
