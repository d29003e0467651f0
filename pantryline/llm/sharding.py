"""Contiguous shards of nearly equal bytes, by prefix sums over the whole table.

Rows are dealt into ranges of their order. Every range is summed up, the totals give each range
its start, and a running sum inside the range gives each row its place in the whole: no task ever
sees more than a range. The line of all bytes is cut at equal targets; a row belongs to the shard
in which its middle byte lies, so a shard misses its target by less than one longest row.

Results: rows are ordered by doc_id, nulls first; equal ids by the text's crc32 and size, then by
their place in the scan, which only equal rows can notice. A null text has no bytes and crc32 0.
An empty table has no rows. Other columns, also ones named like ours, play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from pantryline.session import staged

N_SHARDS = 40
ROW_BYTES = 16
ORDER = ["doc_id", "text_crc32", "size", "__row"]


def assign_shards(docs: DataFrame, n_shards: int = N_SHARDS, ranges: int | None = None, whole: bool = False) -> DataFrame:
    """Per row: doc_id, size, text_crc32, shard, slot (place in the shard, from 0); with `whole` also `document`.

    Runs jobs when called: the ranges and then the places are written to the shared folder, so that
    every later reader sees the same ones.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    spark = docs.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document")] if whole else []
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *kept,
    ).withColumn("__row", F.monotonically_increasing_id())
    split = staged(sized.repartitionByRange(ranges, *ORDER).withColumn("__range", F.spark_partition_id()), "ranges")

    # One row per range.
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = (
        split.groupBy("__range")
        .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        .select(
            "__range",
            F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("__bytes"),
            F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("__rows"),
            F.sum("bytes").over(everything).alias("__total"),
        )
    )
    within = Window.partitionBy("__range").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept_names = ["document"] if whole else []
    placed = (
        split.withColumns({"__run": F.sum("size").over(within), "__at": F.row_number().over(Window.partitionBy("__range").orderBy(*ORDER))})
        .join(F.broadcast(starts), "__range")
        .select(
            "doc_id", "size", "text_crc32", *kept_names,
            (F.col("__rows") + F.col("__at") - 1).alias("__place"),
            # Twice the middle of the row, times the shards, over twice the total.
            F.expr(
                f"cast(cast(2 * (__bytes + __run) - size as decimal(28,0)) * {n_shards} div (2 * __total) as int)"
            ).alias("shard"),
        )
    )
    placed = staged(placed, "places")
    first = placed.groupBy("shard").agg(F.min("__place").alias("__first"))
    # At most one row per shard.
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", *kept_names, "shard", (F.col("__place") - F.col("__first")).alias("slot")
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = N_SHARDS, ranges: int | None = None) -> None:
    """Write the whole rows as `document`, a folder per shard, each in the order of `slot`."""
    placed = assign_shards(docs, n_shards, ranges, whole=True).select("shard", "slot", "document")
    (
        placed.repartitionByRange(n_shards, "shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )


#: The same for DuckDB, the checksum byte by byte from its table.
ORACLE = """
WITH RECURSIVE steps AS (
  SELECT b, b AS c, 0 AS k FROM (SELECT unnest(range(256)) AS b)
  UNION ALL
  SELECT b, CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
), crc AS (SELECT list(c ORDER BY b) AS lut FROM steps WHERE k = 8),
raw AS (SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
pairs AS (SELECT doc_id, size, regexp_extract_all(h, '..') AS p FROM raw),
sized AS (
  SELECT doc_id, size, xor(list_reduce(
      list_transform(p, lambda x: cast('0x' || x AS BIGINT)), lambda a, x: xor(a >> 8, lut[(xor(a, x) & 255) + 1]),
      4294967295), 4294967295) AS text_crc32
  FROM pairs, crc
), placed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS run, sum(size) OVER () AS total FROM sized
), cut AS (SELECT *, cast((2 * run - size) * 40 // (2 * total) AS INTEGER) AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, cast(NULL AS INTEGER) AS grown_shard
FROM cut
"""
