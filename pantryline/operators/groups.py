"""Children of parents: ordered rows of one shape for any size, and nested lists for asked-for parents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pantryline.operators.paging import number_rows
from pantryline.operators.skew import join_parent


def numbered_children(children: DataFrame, parent: str, child: str, size: str) -> DataFrame:
    """Add `position`, from 1 in the order of `child` among its parent's rows, and `size`, their number.

    Rows are numbered over ranges of the whole (parent, child) order, and a parent's first number is
    taken off, so a parent with a third of all rows is worked on by many tasks. Runs a job when
    called, and writes the ranges to the shared folder.
    """
    numbered = number_rows(children, [parent, child], "__number")
    first = numbered.groupBy(parent).agg(F.min("__number").alias("__first"), F.count(F.lit(1)).alias(size))
    return join_parent(numbered, first, parent, "inner").select(
        *children.columns, (F.col("__number") - F.col("__first") + 1).alias("position"), size
    )


def with_children(parents: DataFrame, children: DataFrame, key: str, size: str) -> DataFrame:
    """A row per child with its parent's columns; a parent without any has one row, position null and size 0."""
    rest = [c for c in children.columns if c != key]
    found = join_parent(children, parents, key, "inner").select(*parents.columns, *rest)
    alone = parents.join(children.select(key).distinct(), key, "left_anti")
    none = [(F.lit(0) if c == size else F.lit(None)).cast(children.schema[c].dataType).alias(c) for c in rest]
    return found.unionByName(alone.select(*parents.columns, *none))


def with_numbered_children(parents: DataFrame, children: DataFrame, key: str, child: str, size: str) -> DataFrame:
    """`with_children` of `numbered_children`, of which the children are joined once: a parent brings its first number.

    Runs jobs when called; the ranges it writes also tell the hot keys.
    """
    numbered = number_rows(children, [key, child], "__number")
    first = numbered.groupBy(key).agg(F.min("__number").alias("__first"), F.count(F.lit(1)).alias(size))
    sized = parents.join(first, key, "left")
    rest = [c for c in children.columns if c != key]
    found = join_parent(numbered, sized, key, "inner").select(
        *parents.columns, *rest, (F.col("__number") - F.col("__first") + 1).alias("position"), size
    )
    none = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in [*rest, "position"]]
    alone = sized.filter(F.col(size).isNull()).select(*parents.columns, *none, F.lit(0).cast("bigint").alias(size))
    return found.unionByName(alone)


def nested_list(df: DataFrame, key: str, items: list[str], name: str) -> DataFrame:
    """(key, name): all items of each key as one array of structs ordered by the first item.

    For the keys of a request: a list is one value in one task.
    """
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*items))).alias(name))


def attach_lists(parents: DataFrame, lists: DataFrame, key: str, name: str) -> DataFrame:
    """Left join the lists to their parents; a parent without items gets `[]`."""
    return parents.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array()))
