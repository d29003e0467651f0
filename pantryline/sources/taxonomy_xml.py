"""Classification XML, read with an explicit schema."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from pantryline.functions.versions import UNKNOWN
from pantryline.schemas import SEGMENT


#: Bytes of packed files that a task unpacks, which are many times as long then: Spark would give it a whole partition's.
#: Each file counts as OPEN_BYTES more, as it does when Spark deals files out.
PACKED_BYTES = 24 << 20
OPEN_BYTES = 4 << 20


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """One row per `segment` element with its nested children; `ord` is its place.

    A malformed file is an error. A file is one task, and a segment one row of it, so large
    catalogues come as folders of many files. Within a file the running id follows document
    order; files follow each other by name, of which their number in `ord` is made. Packed files are
    read in batches that give each task PACKED_BYTES or a file; any others as Spark deals them out.
    """
    reader = spark.read.format("xml").option("rowTag", "segment").option("mode", "FAILFAST").schema(SEGMENT)
    rows = reader.load(path)
    batches = _batches(spark, path, len(rows.inputFiles()))
    if len(batches) > 1:
        rows = reduce(DataFrame.unionByName, [reader.load(batch) for batch in batches])
    # One row a file, from the listing that the reader has made; both name files in the same way.
    files = spark.createDataFrame(list(enumerate(sorted(rows.inputFiles()))), "file int, name string")
    named = rows.select("*", F.input_file_name().alias("name"), F.monotonically_increasing_id().alias("at"))
    unknown = F.raise_error(F.concat(F.lit("not among the files listed: "), F.col("name"))).cast("int")
    place = F.struct(F.coalesce("file", unknown).alias("file"), "at")
    return named.join(F.broadcast(files), "name", "left").select(
        place.alias("ord"), F.lit(True).alias("lead"), "_code", "_text", "family"
    )


def _batches(spark: SparkSession, path: str, n: int) -> list[list[str]]:
    """The packed files below a path, `n` if it has no others, in lists of PACKED_BYTES for each core; else none."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    codecs = spark.sparkContext._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    files = [s for s in _files(spark, path) if codecs.getCodec(s.getPath()) is not None]
    if len(files) != n:
        return []
    most, batches, size = PACKED_BYTES * spark.sparkContext.defaultParallelism, [], 0
    for s in sorted(files, key=lambda s: s.getPath().toString()):
        if not batches or size + s.getLen() + OPEN_BYTES > most:
            batches.append([])
            size = 0
        size += s.getLen() + OPEN_BYTES
        # Paths given to a reader are patterns.
        batches[-1].append(re.sub(r"([\\*?\[\]{}])", r"\\\1", s.getPath().toString()))
    return batches


def _files(spark: SparkSession, path: str) -> list:
    """The status of each file that a path, folder or pattern names."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s for top in fs.globStatus(root) or [] for s in fs.listStatus(top.getPath())]
    return [s for s in found if s.isFile() and s.getPath().getName()[0] not in "_."]


def spread_families(docs: DataFrame) -> DataFrame:
    """One row per family instead of one per segment, spread over all tasks.

    A whole segment is a single XML row; everything below it would stay in one task.
    `lead` marks the one row that counts as the visit of the segment itself.
    """
    return (
        docs.select("ord", "_code", "_text", F.posexplode_outer("family").alias("at", "node"))
        .select(
            F.struct("ord", F.coalesce("at", F.lit(-1)).alias("at")).alias("ord"),
            (F.coalesce("at", F.lit(0)) == 0).alias("lead"),
            "_code",
            "_text",
            F.when(F.col("node").isNotNull(), F.array("node")).alias("family"),
        )
        .repartition("ord")
    )


# What may come before the root: comments, declarations and instructions; a doctype may hold brackets.
_PROLOGUE = re.compile(rb"<!--.*?-->|<\?.*?\?>|<![A-Za-z](?:[^\[>]|\[.*?\])*>", re.S)
_START_TAG = re.compile(rb"""<[^\W\d!?](?:[^>"']|"[^"]*"|'[^']*')*>""")


def _first_tag(spark: SparkSession, path, chunk: int = 1 << 14) -> str:
    """A file's first start tag outside comments; empty when it has none. Read through the codec of its name."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    stream = path.getFileSystem(conf).open(path)
    codec = spark.sparkContext._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
    if codec is not None:
        stream = codec.createInputStream(stream)
    try:
        data = b""
        while True:
            more = bytes(stream.readNBytes(chunk))
            data = _PROLOGUE.sub(b"", data + more)
            # A comment that hasn't ended hides what follows it.
            found = _START_TAG.search(data.split(b"<!--", 1)[0])
            if found or not more:
                return found[0].decode("utf-8", "replace") if found else ""
    finally:
        stream.close()


def read_document_date(spark: SparkSession, path: str, at_once: int = 32) -> DataFrame:
    """(xml_source, xml_date): the `dateUtc` of each file's root element, else `unknown`.

    A read of metadata when called: the driver opens so many files at a time, and each only up to the end of its
    root's start tag, which for a task would be the shortest of jobs. The root's name need not be known.
    Compressed files are read through their codec; tags in comments don't count.
    """
    files = [s.getPath() for s in _files(spark, path)]

    def date(file) -> tuple[str, str]:
        value = re.search(r"\sdateUtc\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", _first_tag(spark, file))
        return file.toString(), next((v for v in value.groups() if v is not None), UNKNOWN) if value else UNKNOWN

    with ThreadPoolExecutor(at_once) as pool:
        return spark.createDataFrame(list(pool.map(date, files)), "xml_source string, xml_date string")


def write_segments(docs: DataFrame, path: str, date: str | None = None, compression: str = "none") -> None:
    """Write `segment` rows as XML files of the same shape, without the blanks of an indent, which are read as events too.

    Packed by gzip, texts that repeat take a tenth of the space or less.
    """
    root = f'schema dateUtc="{date}"' if date else "schema"
    (
        docs.select("_code", "_text", "family")
        .write.mode("overwrite")
        .format("xml")
        .option("rootTag", root)
        .option("rowTag", "segment")
        .option("indent", "")
        .option("compression", compression)
        .save(path)
    )
