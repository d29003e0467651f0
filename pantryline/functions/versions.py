"""Version texts, staleness and the refresh decision as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UNKNOWN = "unknown"
CHECK_INTERVAL_SECONDS = 24 * 60 * 60


def file_stem(path: Column) -> Column:
    """The file name without folders and without its last suffix."""
    name = F.substring_index(F.regexp_replace(path, "/+$", ""), "/", -1)
    return F.regexp_replace(name, r"^(.+)\.[^.]+$", "$1")


def compact_date(text: Column) -> Column:
    """`M/D/YYYY` -> `yyyyMMdd`, month first; null when it is not such a date."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    shaped = F.when(trimmed.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), trimmed)
    return F.date_format(F.try_to_date(shaped, "M/d/yyyy"), "yyyyMMdd")


def version_from_path(path: Column, date_text: Column) -> Column:
    """Everything after the first `-v` of the stem, else the digits after its first `-`, else the date."""
    stem = file_stem(path)
    after_dash = F.regexp_extract(stem, r"(?s)^[^-]*-(.*)$", 1)
    return (
        F.when(F.contains(stem, F.lit("-v")), F.regexp_extract(stem, r"(?s)^.*?-v(.*)$", 1))
        .when(after_dash.rlike(r"^\p{Nd}+$"), after_dash)
        .otherwise(F.coalesce(compact_date(date_text), F.lit(UNKNOWN)))
    )


def strip_v(version: Column) -> Column:
    """Drop leading `v`s, as in `v20251127`."""
    return F.ltrim(version, F.lit("v"))


def elapsed_seconds(stamp: Column, now: Column) -> Column:
    """Seconds from an ISO text to `now`; null when unparsable or without a time zone."""
    zoned = F.when(stamp.rlike(r"[T ]\S*(Z|[+-]\d{2}(:?\d{2})?(:?\d{2})?)$"), stamp)
    micros = F.unix_micros(now) - F.unix_micros(F.try_to_timestamp(zoned))
    return micros / F.lit(1_000_000)


def is_stale(stamp: Column, now: Column, interval: int = CHECK_INTERVAL_SECONDS) -> Column:
    """True when the last check is missing, unreadable, without a zone, or old enough."""
    return F.coalesce(elapsed_seconds(stamp, now) >= interval, F.lit(True))


def version_status(stored: Column, candidate: Column) -> Column:
    """`build`, `keep`, `current` or `refresh`; versions compare as text after `strip_v`."""
    return (
        F.when(F.coalesce(stored, F.lit("")) == "", "build")
        .when(F.coalesce(candidate, F.lit("")) == "", "keep")
        .when(strip_v(candidate) <= strip_v(stored), "current")
        .otherwise("refresh")
    )
