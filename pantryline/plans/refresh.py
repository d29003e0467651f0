"""Refresh decisions per dataset, and the catalogue summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pantryline.functions.versions import (
    CHECK_INTERVAL_SECONDS,
    elapsed_seconds,
    is_stale,
    version_status,
)
from pantryline.plans.taxonomy import Taxonomy
from pantryline.sources.metadata import as_map, upsert


def staleness(
    checks: DataFrame, stamp: str, now: Column, interval: int = CHECK_INTERVAL_SECONDS
) -> DataFrame:
    """Add `elapsed_minutes` and `stale` to rows that hold the text of their last check."""
    return checks.withColumn(
        "elapsed_minutes", elapsed_seconds(F.col(stamp), now) / 60
    ).withColumn("stale", is_stale(F.col(stamp), now, interval))


def refresh_plan(datasets: DataFrame, now: Column, interval: int = CHECK_INTERVAL_SECONDS) -> DataFrame:
    """Add `status` to (stored, last_check, candidate, ...) rows.

    `build` without a stored version; `recent` while the last check is fresh; then
    `keep` without a candidate, `current` when it is not newer, else `refresh`.
    """
    decided = version_status(F.col("stored"), F.col("candidate"))
    status = F.when(decided == "build", decided).when(
        ~is_stale(F.col("last_check"), now, interval), "recent"
    ).otherwise(decided)
    return datasets.withColumn("status", status)


def record_check(metadata: DataFrame, now: Column) -> DataFrame:
    """Metadata with `last_version_check` set to `now`, whatever the check found."""
    stamp = F.date_format(
        F.to_utc_timestamp(now, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"
    )
    check = metadata.sparkSession.range(1).select(
        F.lit("last_version_check").alias("key"), stamp.alias("value")
    )
    return upsert(metadata, check)


def catalog_summary(t: Taxonomy, metadata: DataFrame) -> DataFrame:
    """One row: segment count, version, date and import time."""
    shown = ["gpc_version", "xml_date", "import_timestamp"]
    meta = as_map(metadata.filter(F.col("key").isin(shown))).scalar()
    return t.segments.agg(F.count(F.lit(1)).alias("segments")).select(
        "segments",
        F.try_element_at(meta, F.lit("gpc_version")).alias("version"),
        F.try_element_at(meta, F.lit("xml_date")).alias("xml_date"),
        F.try_element_at(meta, F.lit("import_timestamp")).alias("import_timestamp"),
    )
