"""Rows that contain a text anywhere, by a stored index of q-grams.

"Contains" reads every row of a table. Here the rows lie in hash buckets of their key, a folder each, beside
a table of postings: for every place of a searched column the gram of Q characters that begins there (fewer at
a text's end), folded as the search folds, with the row's key and bucket. Postings are sorted by gram, so
the grams of a query read only the row groups that hold them; a common gram is spread over many files by
key. The keys that have all grams of a query, in one column, name the buckets to open; the caller's own
predicate decides there, so an index changes what is read and never the result.

A query of fewer than Q characters is a range of grams. Wildcards split a query into pieces; one
without any literal character reads all rows.
"""

from __future__ import annotations

import json
import re
import string

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from pantryline.functions.text import ascii_fold
from pantryline.session import staged
from pantryline.sources.buckets import buckets_for
from pantryline.sources.tables import ROW_GROUP

Q = 3
_FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_BUCKET = "search_bucket"


def _grams(texts: DataFrame) -> DataFrame:
    """`texts` with a row for each place of its column `text`: the folded `gram` there. None for a null or empty text.

    A gram that a text repeats is there again, which costs less than finding out.
    """
    places = F.when(F.char_length("text") > 0, F.sequence(F.lit(1), F.char_length("text")))
    gram = F.substr("text", "place", F.lit(Q))
    return texts.withColumn("text", ascii_fold(F.col("text"))).select("*", F.explode(places).alias("place")).select(
        *[c for c in texts.columns if c != "text"], gram.alias("gram")
    )


def store_index(rows: DataFrame, key: str, columns: list[str], path: str, buckets: int | None = None) -> None:
    """Write `rows` into buckets of `key` below `path`, and the grams of `columns` beside them.

    Keys may repeat or be null. What exists is an error. Postings are as many as the texts have
    characters, at most. `buckets` follows the number of rows by default, which is counted for it.
    """
    buckets = buckets or buckets_for(rows.count())
    placed = rows.withColumn(_BUCKET, F.pmod(F.xxhash64(f"`{key}`"), F.lit(buckets)).cast("int"))
    options = {"parquet.block.size": str(ROW_GROUP)}
    # A key that many rows share is dealt over files by the rows' other columns; its folder is still one.
    spread = [F.col(f"`{c}`") for c in columns]
    ordered = placed.repartitionByRange(_BUCKET, F.col(f"`{key}`"), *spread).sortWithinPartitions(_BUCKET, f"`{key}`")
    ordered.write.mode("errorifexists").options(**options).partitionBy(_BUCKET).parquet(f"{path}/rows")

    # Folders can't tell the columns of an empty table, so they are kept beside it.
    layout = rows.sparkSession.createDataFrame([(placed.schema.json(),)], "schema string")
    layout.coalesce(1).write.json(f"{path}/layout")

    texts = F.array(*[F.struct(F.lit(i).alias("column"), F.col(f"`{c}`").alias("text")) for i, c in enumerate(columns)])
    # Read back as stored: files small enough to give every core some, whatever the input's files are.
    stored = rows.sparkSession.read.schema(placed.schema).parquet(f"{path}/rows")
    found = stored.select(F.col(f"`{key}`").alias("key"), F.col(_BUCKET), F.explode(texts).alias("of"))
    postings = (
        _grams(found.select("key", _BUCKET, "of.column", "of.text"))
        .repartitionByRange("gram", "key")
        .sortWithinPartitions("gram", "key")
    )
    postings.write.mode("errorifexists").options(**options).parquet(f"{path}/grams")


def _wanted(q: str) -> tuple[list[str], bool]:
    """The grams that a text containing `q` must have; whether they are the first letters of grams only."""
    pieces = [p for p in re.split("[%_]+", q.translate(_FOLD)) if p]
    whole = sorted({p[i : i + Q] for p in pieces for i in range(len(p) - Q + 1)})
    return (whole, False) if whole else (sorted(set(pieces)), True)


def candidate_keys(spark: SparkSession, path: str, q: str) -> DataFrame | None:
    """(key, search_bucket) of the rows with all grams of `q` in one column; None where `q` has no literal character."""
    wanted, begin = _wanted(q)
    if not wanted:
        return None
    gram = F.col("gram")
    tests = [gram.startswith(g) if begin else gram == g for g in wanted]
    any_test = tests[0]
    for test in tests[1:]:
        any_test = any_test | test
    postings = spark.read.parquet(f"{path}/grams").filter(any_test if begin else gram.isin(wanted))
    # A flag for each gram, so a key that several rows share is no harm; combined before the shuffle.
    flags = [F.bool_or(test).alias(f"has{i}") for i, test in enumerate(tests)]
    held = postings.groupBy("key", _BUCKET, "column").agg(*flags)
    for i in range(len(tests)):
        held = held.filter(f"has{i}")
    return held.select("key", _BUCKET).distinct()


def read_candidates(spark: SparkSession, path: str, key: str, q: str | None, ascii_only: bool = True) -> DataFrame:
    """The stored rows that may contain `q`, a superset of those that do; all of them for an empty `q`.

    Runs a job when called: the keys found are written to the shared folder, and their buckets, as many
    as the table has at most, are the only folders that are opened. Other letters than A to Z are
    indexed as they are, so `ascii_only=False` reads all rows.
    """
    layout = spark.read.schema("schema string").json(f"{path}/layout").first()
    rows = spark.read.schema(StructType.fromJson(json.loads(layout["schema"]))).parquet(f"{path}/rows")
    keys = candidate_keys(spark, path, q) if q and ascii_only else None
    if keys is None:
        return rows.drop(_BUCKET)
    keys = staged(keys, "search-keys")
    opened = [r[0] for r in keys.select(_BUCKET).distinct().collect()]
    found = rows.filter(F.col(_BUCKET).isin(opened)) if opened else rows.limit(0)
    own, theirs = found.alias("own"), keys.select(F.col("key").alias("search_key")).distinct()
    return own.join(theirs, F.col(f"own.`{key}`").eqNullSafe(F.col("search_key")), "left_semi").drop(_BUCKET)
