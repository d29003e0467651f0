"""Key and reference checks as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pantryline.operators.skew import join_parent


def missing_keys(wanted: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """The distinct wanted keys that `table` does not have."""
    return wanted.select(key).distinct().join(table.select(key), key, "left_anti")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose (non-null) reference matches no parent row.

    References are made distinct first, so a reference shared by a third of the
    child rows is checked once; the rows themselves meet only the absent keys.
    """
    named = child.filter(F.col(child_key).isNotNull())
    absent = missing_keys(
        named.select(F.col(child_key).alias("__key")), parent.select(F.col(parent_key).alias("__key")), "__key"
    )
    return join_parent(named, absent.withColumnRenamed("__key", child_key), child_key, "left_semi").select(*child.columns)


def null_keys(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a null in any of the required columns."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull()
    return df.filter(bad)
