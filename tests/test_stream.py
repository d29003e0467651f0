from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pantryline.session import work_dir
from pantryline.streaming.enrich import enrich, read_enriched, store_canonical, write_stream


@pytest.fixture(scope="module")
def products(spark):
    return spark.range(0, 20).select(
        F.col("id").cast("string").alias("gtin"),
        F.concat(F.lit("p"), F.col("id").cast("string")).alias("product_name"),
        F.array(F.lit("USDA_FDC")).alias("data_sources"),
    )


@pytest.fixture(scope="module")
def canonical(spark, products, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("canonical"))
    store_canonical(products, path, buckets=16)
    return path


def lookups(spark, first, last):
    # A third of the lookups ask for the same barcode; some for none.
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 != 1, F.col("id") % 30)
    return spark.range(first, last).select(F.col("id").alias("event_id"), key.cast("string").alias("gtin"))


def test_stream_equals_batch_and_resumes(spark, canonical, products, tmp_path):
    inbox, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    schema = lookups(spark, 0, 1).schema

    def run():
        stream = spark.readStream.schema(schema).parquet(inbox)
        write_stream(stream, canonical, out, checkpoint).awaitTermination()

    lookups(spark, 0, 300).write.parquet(inbox)
    run()
    lookups(spark, 300, 500).write.mode("append").parquet(inbox)
    run()
    run()  # nothing new: nothing written twice
    got = sorted(map(str, read_enriched(spark, out).select("event_id", "gtin", "product_name").collect()))
    want = lookups(spark, 0, 500).join(products, "gtin").select("event_id", "gtin", "product_name").collect()
    assert got == sorted(map(str, want))
    assert 0 < len(got) < 500


def test_a_repeated_batch_replaces_its_rows(spark, canonical, tmp_path):
    """What a crash between the write and the checkpoint leaves behind is written over."""
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    lookups(spark, 0, 300).write.parquet(inbox)
    for checkpoint in ("a", "b"):  # a fresh checkpoint numbers the same batch again
        stream = spark.readStream.schema(lookups(spark, 0, 1).schema).parquet(inbox)
        write_stream(stream, canonical, out, str(tmp_path / checkpoint)).awaitTermination()
    once = enrich(lookups(spark, 0, 300), canonical).count()
    assert read_enriched(spark, out).count() == once


def scan_of(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return next(line for line in text.splitlines() if "FileScan parquet" in line and "product_name" in line)


def test_a_batch_reads_only_the_buckets_it_names(spark, canonical):
    few = spark.createDataFrame([(1, "3"), (2, "3"), (3, "999"), (4, None)], "event_id int, gtin string")
    scan = scan_of(enrich(few, canonical))
    buckets = spark.createDataFrame([("3",), ("999",)], "gtin string").select(F.pmod(F.xxhash64("gtin"), F.lit(16))).distinct()
    wanted = ",".join(str(r[0]) for r in sorted(buckets.collect()))
    assert "PartitionFilters" in scan and f"IN ({wanted})" in scan
    assert [r["event_id"] for r in enrich(few, canonical).orderBy("event_id").collect()] == [1, 2]


def test_maps_empty_batches_and_a_hot_bare_barcode(spark, canonical):
    maps = spark.sql("select map('a', 1) m, array(map(1, id)) n, '7' gtin from range(5)")
    assert enrich(maps, canonical).count() == 5
    assert enrich(maps.limit(0), canonical).count() == 0
    bare = spark.range(0, 32_000, 1, 64).select(F.lit("7").alias("gtin"))
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "200"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        sizes = [r["count"] for r in enrich(bare, canonical).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 32_000 and len(sizes) > 32 and max(sizes) <= 32_000 / 8


def test_work_dir_is_shared_and_fresh(spark):
    a, b = work_dir(spark, "x"), work_dir(spark, "x")
    assert a != b
    assert a.startswith(spark.conf.get("spark.checkpoint.dir"))
