"""Barcode lookups arriving as a stream, enriched from the canonical table.

The canonical table lies in folders, one for each hash bucket of the barcode. A micro-batch
opens the folders of the buckets that its barcodes fall into and no others, so its cost follows the
batch, not the catalogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from pantryline.operators.skew import hot_from, hot_sketch, join_parent

BUCKETS = 256
_LAYOUT = "key string, buckets int"


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(f"`{key}`"), F.lit(buckets)).cast("int")


def store_canonical(products: DataFrame, path: str, key: str = "gtin", buckets: int = BUCKETS) -> None:
    """Write the canonical table below `path` in one folder a bucket, sorted by the key within files.

    `buckets` sets how finely a micro-batch can choose: take more for more products, some millions each.
    """
    (
        products.withColumn("__bucket", _bucket(key, buckets))
        .repartition(buckets, "__bucket")
        .sortWithinPartitions("__bucket", key)
        .write.partitionBy("__bucket")
        .option(f"parquet.bloom.filter.enabled#{key}", "true")
        .parquet(f"{path}/rows")
    )
    products.sparkSession.createDataFrame([(key, buckets)], _LAYOUT).coalesce(1).write.json(f"{path}/layout")


def enrich(lookups: DataFrame, path: str) -> DataFrame:
    """Lookups of a batch with their product; those without one are dropped.

    Further columns of any type are kept, also maps. Runs a job when called, a single pass over the
    keys: it names the buckets, at most as many as there are, and finds barcodes that many lookups ask
    for, whose rows are spread however equal they are.
    """
    spark = lookups.sparkSession
    key, buckets = spark.read.schema(_LAYOUT).json(f"{path}/layout").first()
    asked = lookups.filter(F.col(f"`{key}`").isNotNull())
    seen = asked.agg(F.collect_set(_bucket(key, buckets)).alias("buckets"), *hot_sketch(key)).first()
    rows = spark.read.parquet(f"{path}/rows")
    named = rows.filter(F.col("__bucket").isin(sorted(seen["buckets"]))).drop("__bucket")
    found = join_parent(asked, named, key, "inner", hot=hot_from(seen))
    return found.filter(F.col("data_sources").isNotNull())


def write_stream(
    lookups: DataFrame, path: str, out: str, checkpoint: str, available_now: bool = True, **trigger: str
) -> StreamingQuery:
    """Enrich a stream of lookups from the canonical table below `path` into Parquet files below `out`.

    Stateless: a barcode has one product, so no watermark is needed. Every batch has a folder of its own
    that a repeated batch writes anew, so a restart from the checkpoint gives each lookup once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            enrich(batch, path).write.mode("overwrite").parquet(f"{out}/batch={number}")
        finally:
            batch.unpersist()

    writer = lookups.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return writer.trigger(**(trigger or {"availableNow": available_now})).start()


def read_enriched(spark: SparkSession, out: str) -> DataFrame:
    """What a stream has written, without the numbers of its batches."""
    return spark.read.parquet(out).drop("batch")
