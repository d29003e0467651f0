"""Helpers shared by the operators: tables, ids, sampling keys and Arrow batches."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pantryline.session import staged, work_dir

#: Any letter of any script; digits and `_` are not letters.
LETTER = re.compile(r"[^\W\d_]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of_id(column: str) -> Column:
    """crc32 of an id written as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def texts_of(batch: pa.RecordBatch, column: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Tuples as Arrow batches of at most `size` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, names, types)
            held = []
    if held:
        yield _batch(held, names, types)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = [pa.array(values, kind) for values, kind in zip(zip(*rows), types, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names)


def bounded_sample(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """At most `limit` rows, the same ones however the rows are partitioned: those whose key hashes lowest.

    A top-k, so every task keeps `limit` rows at most.
    """
    return rows.orderBy(F.xxhash64(F.lit("sample"), F.col(key)), F.col(key)).limit(limit)


#: Bytes of a batch that a task hands to Python at once, and rows of one that it filters at once.
BATCH_BYTES, FILTER_ROWS = "8m", 512


def small_batches(df: DataFrame) -> DataFrame:
    """Bound what a task and its Python worker hold of a table of long texts at a time.

    Sets the session's limit on the bytes of a batch where nobody has changed it from Spark's 64 MB.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(name, None) in ("67108864", "67108864b", "64MB", "64m"):
        df.sparkSession.conf.set(name, BATCH_BYTES)
    return df


def filtered(parts: Iterator[pa.RecordBatch], keep: Callable[[pa.RecordBatch], list[bool]]) -> Iterator[pa.RecordBatch]:
    """The rows of which `keep` says True, a few at a time."""
    for part in parts:
        for at in range(0, part.num_rows, FILTER_ROWS):
            some = part.slice(at, FILTER_ROWS)
            yield some.filter(pa.array(keep(some), pa.bool_()))


def relieve() -> None:
    """Give the memory that an ended task has freed back to the machine: the worker goes on with other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


__all__ = ["LETTER", "batches", "bounded_sample", "crc_of_id", "filtered", "relieve", "small_batches", "staged", "table", "texts_of", "work_dir"]
