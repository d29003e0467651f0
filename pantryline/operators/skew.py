"""Joins of many rows to unique parents that don't gather a hot key in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

#: A key is hot when it holds more than one of so many parts of the rows; so there are fewer hot keys than this.
SHARE = 200
#: Groups that all rows together would be spread over; a hot key gets its share of them.
SPREAD = 256
#: Counters of a task's sketch. A key above one in 0.75 times as many rows is never lost, which is far below SHARE.
COUNTERS = 4096
#: Groups for rows without a key.
KEYLESS = 32


def _hashable(kind: DataType) -> bool:
    """Whether rows of this type can be hashed: no map anywhere inside."""
    if isinstance(kind, StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return _hashable(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, MapType)


def hot_sketch(key: str) -> tuple[Column, Column]:
    """Aggregates over rows that have a key, for `hot_from`: a frequent-items sketch of COUNTERS counters, and a count.

    Every task keeps a sketch, and the sketches are merged once; nothing is shuffled by key.
    """
    return F.expr(f"approx_top_k(xxhash64(`{key}`), {SHARE}, {COUNTERS})").alias("__top"), F.count(F.lit(1)).alias("__rows")


def hot_from(row: Row) -> dict[int, int]:
    """Hash of each hot key, with the number of groups its rows are to be spread over: fewer than SHARE entries."""
    total = row["__rows"]
    return {x["item"]: math.ceil(SPREAD * x["count"] / total) for x in row["__top"] or [] if x["count"] * SHARE > total}


def hot_groups(rows: DataFrame, key: str) -> dict[int, int]:
    """The hot keys of a relation. Runs a job that reads its keys."""
    return hot_from(rows.filter(F.col(f"`{key}`").isNotNull()).agg(*hot_sketch(key)).first())


def hot_groups_of(counts: DataFrame, key: str, n: str) -> dict[int, int]:
    """The same from a table that has each key with its number of rows. Runs a job."""
    total = counts.agg(F.sum(n)).scalar()
    found = counts.select(F.xxhash64(f"`{key}`"), n, total.alias("total")).filter(F.col(n) * SHARE > F.col("total"))
    return {hashed: math.ceil(SPREAD * count / total) for hashed, count, total in found.collect()}


def _groups(key: str, hot: dict[int, int]) -> Column:
    """How many groups the rows of a key are spread over."""
    hashed = F.xxhash64(f"`{key}`")
    if not hot:
        return F.lit(1)
    keys = ", ".join(f"{h}L" for h in hot)
    counts = F.expr(f"map_from_arrays(array({keys}), array({', '.join(map(str, hot.values()))}))")
    return F.coalesce(F.try_element_at(counts, hashed), F.lit(1))


def join_parent(
    rows: DataFrame, parents: DataFrame, key: str, how: str = "left", counted: DataFrame | None = None,
    hot: dict[int, int] | None = None,
) -> DataFrame:
    """Join `rows` to `parents`, mostly unique by `key`; rows of hot keys and without a key are spread.

    The parent of a hot key is repeated for each of its groups, any other is there once. `how` is a
    join type that keeps rows of the left side only: inner, left, left_semi or left_anti. `counted` may
    name a cheaper relation with the same keys to find the hot ones in; reading its keys is a job that runs
    when this is called, unless `hot` gives what is known already. A row's group follows from its values and from the partition it is read
    in, so it stays the same when a task is run again, and equal rows of several partitions part too.
    """
    hot = hot_groups(rows if counted is None else counted, key) if hot is None else hot
    values = [f"`{f.name}`" for f in rows.schema.fields if _hashable(f.dataType)]
    place = F.xxhash64(*values).bitwiseXOR(F.xxhash64(F.spark_partition_id()))
    groups = F.when(F.col(f"`{key}`").isNull(), KEYLESS).otherwise(_groups(key, hot))
    spread = rows.withColumn("__salt", F.pmod(place, groups).cast("int"))
    if hot:
        repeated = parents.withColumn("__salt", F.explode(F.sequence(F.lit(0), _groups(key, hot) - 1)))
    else:
        repeated = parents.withColumn("__salt", F.lit(0))
    return spread.join(repeated, [key, "__salt"], how).drop("__salt")
