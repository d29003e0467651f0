"""Search across the classification levels and in the two product sources."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from pantryline.functions.text import any_contains
from pantryline.operators.paging import Page, capped_hits
from pantryline.operators.trigrams import read_candidates, store_index
from pantryline.plans.taxonomy import LEVELS, Taxonomy, matching

CATEGORIES = {lv.table: name for name, lv in LEVELS.items()}
OFF_MAX_HITS = 100
FDC_MAX_HITS = 200
DEFAULT_HITS = 25


def search_taxonomy(t: Taxonomy, q: str, category: str = "all", ascii_only: bool = True) -> DataFrame:
    """(entity, code, description): all hits of the chosen levels, by level, then code.

    An empty query finds nothing. An unknown category is an error.
    """
    if category != "all" and category not in CATEGORIES:
        raise ValueError(f"unknown category {category!r}; expected all, {', '.join(CATEGORIES)}")
    chosen = list(CATEGORIES) if category == "all" else [category]
    hits = [
        matching(t, CATEGORIES[table], q, ascii_only=ascii_only)
        .filter(F.lit(bool(q)))
        .select(
            F.lit(rank).alias("rank"),
            F.lit(table).alias("entity"),
            F.col(LEVELS[CATEGORIES[table]].code).alias("code"),
            "description",
        )
        for rank, table in enumerate(CATEGORIES)
        if table in chosen
    ]
    return reduce(DataFrame.unionByName, hits).orderBy("rank", "code").drop("rank")


def index_taxonomy(t: Taxonomy, path: str) -> None:
    """Store the four levels with an index of the grams of codes and descriptions, for `narrowed_taxonomy`."""
    for lv in LEVELS.values():
        store_index(getattr(t, lv.table), lv.code, [lv.code, "description"], f"{path}/{lv.table}")


def narrowed_taxonomy(t: Taxonomy, spark: SparkSession, path: str, q: str, category: str = "all") -> Taxonomy:
    """`t` with the levels to search cut down to the stored rows that may contain `q`; search finds the same in it."""
    levels = {
        lv.table: read_candidates(spark, f"{path}/{lv.table}", lv.code, q)
        for lv in LEVELS.values()
        if category in ("all", lv.table)
    }
    return replace(t, **levels)


def index_products(off: DataFrame, path: str) -> None:
    """Store shaped products with an index of what `search_products` looks at."""
    store_index(off, "barcode", ["product_name", "brands"], path)


def index_foods(fdc: DataFrame, path: str) -> None:
    """Store foods with an index of what `search_foods` looks at."""
    store_index(fdc, "fdc_id", ["description", "brand_owner", "brand_name"], path)


def search_products(off: DataFrame, q: str, n: int = DEFAULT_HITS) -> Page:
    """Shaped products whose name or brands contain `q`: the first `n` by barcode, and the total.

    Products without a name are found too; only the barcode lookup drops them.
    """
    hits = off.filter(any_contains([F.col("product_name"), F.col("brands")], q))
    return capped_hits(hits, "barcode", n, OFF_MAX_HITS, "total")


def search_foods(fdc: DataFrame, q: str, n: int = DEFAULT_HITS) -> Page:
    """Foods whose description or brand contains `q`: the first `n` by id, and the total."""
    columns = ["fdc_id", "description", "data_type", "brand_owner", "brand_name"]
    hits = fdc.select(*columns).filter(
        any_contains([F.col("description"), F.col("brand_owner"), F.col("brand_name")], q)
    )
    return capped_hits(hits, "fdc_id", n, FDC_MAX_HITS, "total_hits")
