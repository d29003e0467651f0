"""Versioned Parquet tables: write into a folder of the run, then publish by an entry of a log.

A version is a name; what holds its tables is the folder of the run that wrote them. So nothing
that is published is ever written to again, and readers keep their files while a version is
imported anew. Entries are files named by number, created only where no such file is, so two
imports that end at the same time get different numbers, and the higher one is current.

Rows of a file are sorted by their key, and files carry bloom filters of all codes, so a lookup by
code skips the row groups that can't hold it.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from pantryline.schemas import TAXONOMY_TABLES

_LOG = "version string, folder string, published_at timestamp"
_DIGITS = 12
#: Bytes of a row group of a checked table: small enough that skipping all but one pays.
ROW_GROUP = 16 << 20


def new_run(version: str) -> str:
    """The name of a fresh folder for a version's tables."""
    return f"{version}-{uuid.uuid4().hex}"


def table_path(root: str, folder: str, name: str) -> str:
    return f"{root}/versions/{folder}/{name}"


def write_tables(
    tables: dict[str, DataFrame], root: str, folder: str, partition_by: str | None = None,
    options: dict[str, str] | None = None,
) -> None:
    """Write tables below a run's folder. Nothing is visible before `publish`; what exists is an error."""
    for name, df in tables.items():
        writer = df.write.mode("errorifexists").options(**(options or {}))
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(table_path(root, folder, name))


def _log_files(spark: SparkSession, root: str) -> tuple[object, object, list[str]]:
    """The file system, the folder of the log, and the names of its entries: one for each publication."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/published")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return fs, folder, sorted(n for n in names if n.endswith(".json") and n[0] not in "._")


def _entries(spark: SparkSession, root: str) -> list:
    """The last entry of each version, newest first: as many rows as there are versions."""
    if not _log_files(spark, root)[2]:
        return []
    number = F.substring_index(F.element_at(F.split("_metadata.file_path", "/"), -1), ".", 1).cast("long")
    log = spark.read.schema(_LOG).json(f"{root}/published/*.json").select("*", number.alias("seq"))
    last = log.filter("folder is not null").groupBy("version").agg(F.max(F.struct("seq", "published_at", "folder")).alias("last"))
    return last.select("version", "last.*").orderBy(F.desc("seq")).collect()


def publish(spark: SparkSession, root: str, version: str, folder: str) -> int:
    """Make a completely written folder the current one, and the one of its version; returns the entry's number.

    Readers follow this log, so they see what was published before until now; an
    interrupted run leaves nothing published. An entry's file is created only if no other import
    took its number in the meantime; else the next number is tried. Clocks don't matter.
    """
    exists = "org.apache.hadoop.fs.FileAlreadyExistsException"
    fs, log, names = _log_files(spark, root)
    seq = int(names[-1].split(".")[0]) if names else 0
    stamp = spark.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")).first()[0]
    entry = json.dumps({"version": version, "folder": folder, "published_at": stamp}) + "\n"
    while True:
        seq += 1
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(log, f"{seq:0{_DIGITS}d}.json")
        try:
            out = fs.create(path, False)
        except Py4JJavaError as error:
            if error.java_exception.getClass().getName() != exists:
                raise
            continue
        try:
            out.write(bytearray(entry.encode()))
        finally:
            out.close()
        return seq


def unpublished(spark: SparkSession, root: str, older_than_hours: float = 24) -> list[str]:
    """Folders below `versions` that no entry names, last changed so many hours ago: what failed imports left.

    An import that still runs looks the same, hence the hours. One name for each, as from a listing.
    """
    fs, log, names = _log_files(spark, root)
    versions = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/versions")
    if not fs.exists(versions):
        return []
    named = set()
    if names:
        entries = spark.read.schema(_LOG).json(f"{root}/published/*.json")
        named = {r["folder"] for r in entries.select("folder").distinct().collect()}
    latest = (time.time() - older_than_hours * 3600) * 1000
    found = [s for s in fs.listStatus(versions) if s.isDirectory() and s.getModificationTime() <= latest]
    return sorted(s.getPath().getName() for s in found if s.getPath().getName() not in named)


def remove_unpublished(spark: SparkSession, root: str, older_than_hours: float = 24) -> list[str]:
    """Delete the folders that `unpublished` names; published ones and their files stay."""
    gone = unpublished(spark, root, older_than_hours)
    fs = _log_files(spark, root)[0]
    for folder in gone:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/versions/{folder}"), True)
    return gone


def current_version(spark: SparkSession, root: str) -> str | None:
    """The version published last, or None when nothing is published yet."""
    entries = _entries(spark, root)
    return entries[0]["version"] if entries else None


def folder_of(spark: SparkSession, root: str, version: str | None = None) -> str:
    """The folder last published for a version, the current one by default."""
    entries = _entries(spark, root)
    if not entries:
        raise FileNotFoundError(f"no published version below {root}")
    found = [e["folder"] for e in entries if version in (None, e["version"])]
    if not found:
        raise FileNotFoundError(f"version {version} is not published below {root}")
    return found[0]


def read_table(
    spark: SparkSession, root: str, name: str, version: str | None = None, schema: StructType | None = None,
    folder: str | None = None,
) -> DataFrame:
    """One table of a published version, the current one by default, or of a run's `folder`.

    `schema` allows for no rows at all.
    """
    folder = folder or folder_of(spark, root, version)
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(table_path(root, folder, name))


def write_checked(name: str, rows: DataFrame, root: str, folder: str) -> None:
    """Write a taxonomy table with its `reason` column; sound and rejected rows in folders of their own.

    Sorted within files by key, with bloom filters of keys and parents: see `lookup_options`.
    """
    flagged = rows.withColumn("ok", F.col("reason").isNull())
    _, keys, parents = TAXONOMY_TABLES[name]
    sorted_rows = flagged.sortWithinPartitions("ok", *keys)
    write_tables({name: sorted_rows}, root, folder, "ok", lookup_options([*keys, *parents]))


def lookup_options(codes: list[str]) -> dict[str, str]:
    """Parquet options by which a lookup of these columns reads only the row groups that may hold a code."""
    blooms = {f"parquet.bloom.filter.enabled#{c}": "true" for c in dict.fromkeys(codes)}
    return {**blooms, "parquet.block.size": str(ROW_GROUP)}


def read_checked(
    spark: SparkSession, name: str, root: str, version: str | None = None, folder: str | None = None
) -> DataFrame:
    """All rows of a taxonomy table with `reason` and `ok`; a filter on `ok` prunes the folders."""
    columns = [*TAXONOMY_TABLES[name][0], "reason"]
    schema = StructType([StructField(c, StringType()) for c in columns] + [StructField("ok", BooleanType())])
    return read_table(spark, root, name, version, schema, folder)
