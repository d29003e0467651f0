from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from pantryline.functions import versions as v
from pantryline.plans.refresh import record_check, refresh_plan, staleness

NOW = datetime(2025, 6, 2, 12, 0, 0, tzinfo=timezone.utc)


@pytest.mark.parametrize(
    "path, date, want",
    [
        ("/data/imports/en-v20251127.xml", "2/12/2024", "20251127"),
        ("gpc-20240101.xml", "2/12/2024", "20240101"),
        ("gpc_month.xml", "2/12/2024", "20240212"),
        ("gpc_month.xml", " 02/12/2024 ", "20240212"),
        ("gpc_month.xml", "13/13/2024", "unknown"),
        ("gpc_month.xml", "2/30/2024", "unknown"),
        ("gpc_month.xml", "2024-02-12", "unknown"),
        ("gpc_month.xml", "unknown", "unknown"),
        ("gpc_month.xml", None, "unknown"),
        ("gpc-vegan-1.xml", "2/12/2024", "egan-1"),
        ("a-b-v1-v2.xml", None, "1-v2"),
        ("en-v.xml", "2/12/2024", ""),
        ("gpc-2024-01.xml", "2/12/2024", "20240212"),
        ("a-v1.tar.xml", None, "1.tar"),
        ("/dir-v9/plain.xml", "12/1/2024", "20241201"),
        ("gpc-12", None, "12"),
    ],
)
def test_version_from_path(spark, path, date, want):
    df = spark.createDataFrame([(path, date)], "p string, d string")
    assert df.select(v.version_from_path(F.col("p"), F.col("d"))).first()[0] == want


STAMPS = [
    (None, True),
    ("", True),
    ("garbage", True),
    ("2025-06-02T11:00:00", True),  # no zone
    ("2025-06-02", True),
    ((NOW - timedelta(hours=23, minutes=59)).isoformat(), False),
    ((NOW - timedelta(hours=24)).isoformat(), True),
    ((NOW - timedelta(hours=24) + timedelta(microseconds=1)).isoformat(), False),
    ((NOW + timedelta(hours=1)).isoformat(), False),
    ("2025-06-02T13:00:00+02:00", False),
    ("2025-06-01T12:00:00Z", True),
    ("2025-06-01T12:00:01Z", False),
]


@pytest.mark.parametrize("stamp, stale", STAMPS)
def test_staleness(spark, stamp, stale):
    df = spark.createDataFrame([(stamp,)], "s string")
    row = staleness(df, "s", F.lit(NOW)).first()
    assert row["stale"] is stale


def test_elapsed_minutes(spark):
    df = spark.createDataFrame([((NOW - timedelta(minutes=90)).isoformat(),)], "s string")
    assert staleness(df, "s", F.lit(NOW)).first()["elapsed_minutes"] == 90.0


@pytest.mark.parametrize(
    "stored, candidate, want",
    [
        (None, "20250101", "build"),
        ("", "20250101", "build"),
        ("20250101", None, "keep"),
        ("20250101", "", "keep"),
        ("v20250101", "20250101", "current"),
        ("20250101", "vv20250102", "refresh"),
        ("20250102", "20250101", "current"),
        ("unknown", "20991231", "current"),
        ("9", "10", "current"),  # compared as text
    ],
)
def test_version_status(spark, stored, candidate, want):
    df = spark.createDataFrame([(stored, candidate)], "s string, c string")
    assert df.select(v.version_status(F.col("s"), F.col("c"))).first()[0] == want


def test_refresh_plan(spark):
    recent, old = (NOW - timedelta(hours=1)).isoformat(), (NOW - timedelta(days=2)).isoformat()
    rows = [
        ("a", None, recent, "2"), ("b", "1", recent, "2"), ("c", "1", old, "2"),
        ("d", "1", old, None), ("e", "2", None, "2"),
    ]
    df = spark.createDataFrame(rows, "k string, stored string, last_check string, candidate string")
    got = {r["k"]: r["status"] for r in refresh_plan(df, F.lit(NOW)).collect()}
    assert got == {"a": "build", "b": "recent", "c": "refresh", "d": "keep", "e": "current"}


def test_record_check(spark):
    old = spark.createDataFrame([("last_version_check", "never"), ("a", "1")], "key string, value string")
    got = dict(map(tuple, record_check(old, F.lit(NOW)).collect()))
    assert got["a"] == "1" and datetime.fromisoformat(got["last_version_check"]) == NOW
