"""Tables stored in equal hash buckets of a key: joins, semi-joins and groupings on it need no exchange.

Two tables with the same number of buckets of the same key meet bucket by bucket, and a lookup of
literal keys opens the files of their buckets only. Spark keeps bucketing in its catalog, which a
later session doesn't share, so a folder has the layout beside the rows and is made known to the
catalog of whichever session reads it.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

#: Rows of a bucket that `buckets_for` aims at.
BUCKET_ROWS = 2_000_000


def buckets_for(rows: int, at_least: int = 8) -> int:
    """A power of two of buckets, so that tables of different sizes still divide each other."""
    return max(at_least, 1 << max(0, -(-rows // BUCKET_ROWS) - 1).bit_length())


def _name(path: str) -> str:
    return "stored_" + hashlib.sha256(path.encode()).hexdigest()[:24]


def store_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """Write `df` into the folder `path`, one sorted file a bucket, and return it read back.

    One shuffle, by the key; rows without a key share a bucket. What exists is an error. The files carry bloom filters of the key.
    """
    spark, name = df.sparkSession, _name(path)
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    (
        df.repartition(buckets, key)
        .write.format("parquet")
        .mode("errorifexists")
        .option("path", f"{path}/rows")
        .option(f"parquet.bloom.filter.enabled#{key}", "true")
        .bucketBy(buckets, key)
        .sortBy(key)
        .saveAsTable(name)
    )
    layout = [(key, buckets, df.schema.json())]
    spark.createDataFrame(layout, "key string, buckets int, schema string").coalesce(1).write.json(f"{path}/layout")
    return spark.table(name)


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """A stored table with its buckets, in this session or any later one."""
    name = _name(path)
    if not spark.catalog.tableExists(name):
        layout = spark.read.schema("key string, buckets int, schema string").json(f"{path}/layout").first()
        fields = StructType.fromJson(json.loads(layout["schema"])).fields
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        spark.sql(
            f"CREATE TABLE `{name}` ({columns}) USING parquet CLUSTERED BY (`{layout['key']}`)"
            f" SORTED BY (`{layout['key']}`) INTO {layout['buckets']} BUCKETS LOCATION '{path}/rows'"
        )
    return spark.table(name)


def only_keys(df: DataFrame, key: str, keys: list[str] | DataFrame | None) -> DataFrame:
    """Restrict to keys. A list prunes buckets; of a DataFrame (first column) only its own keys are shuffled."""
    if keys is None:
        return df
    if isinstance(keys, DataFrame):
        wanted = keys.select(F.col(f"`{keys.columns[0]}`").alias(key)).filter(F.col(key).isNotNull()).distinct()
        return df.join(wanted, key, "left_semi")
    return df.filter(F.col(key).isin([k for k in keys if k is not None]))
