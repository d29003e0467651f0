"""Shaping the two product sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pantryline.functions.nutrients import (
    FDC_NUTRIENTS,
    last_amount,
    last_wins_map,
    off_nutrient_map,
    off_nutrient_struct,
)
from pantryline.functions.text import truthy
from pantryline.operators.dedup import first_wins, last_wins

_FDC_SCALARS = [
    "fdc_id", "description", "data_type", "brand_owner", "brand_name",
    "ingredients", "serving_size", "serving_size_unit",
]


def _restrict(df: DataFrame, column: str, keys: DataFrame | None) -> DataFrame:
    if keys is None:
        return df
    return df.join(keys.select(F.col(keys.columns[0]).alias(column)).distinct(), column, "left_semi")


# ---- crowdsourced ---------------------------------------------------------------


def shape_off(raw: DataFrame) -> DataFrame:
    """Renamed fields, missing arrays empty, nutrients as a struct of eight numbers."""
    return raw.select(
        F.col("code").alias("barcode"),
        "product_name",
        "brands",
        "image_url",
        "ingredients_text",
        "quantity",
        "serving_size",
        F.coalesce("categories_tags", F.array()).alias("categories"),
        F.coalesce("allergens_tags", F.array()).alias("allergens"),
        F.coalesce("labels_tags", F.array()).alias("labels"),
        off_nutrient_struct(F.col("nutriments")).alias("nutrients"),
    )


def named_only(shaped: DataFrame) -> DataFrame:
    """Drop products with a null or empty name (barcode lookups only, not searches)."""
    return shaped.filter(truthy(F.col("product_name")).isNotNull())


def with_nutrient_map(shaped: DataFrame) -> DataFrame:
    """Replace the nutrient struct by `nutrients_per_100g`, a map of the known values."""
    return shaped.withColumn("nutrients_per_100g", off_nutrient_map(F.col("nutrients"))).drop("nutrients")


def off_products(raw: DataFrame, gtins: DataFrame | None = None) -> DataFrame:
    """Named, shaped products, all or those of the given barcodes."""
    return with_nutrient_map(_restrict(named_only(shape_off(raw)), "barcode", gtins))


# ---- laboratory -----------------------------------------------------------------


def fdc_foods(raw: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Full food records with nutrients as a map; of equal names the last one stays."""
    foods = _restrict(raw, "fdc_id", ids)
    return foods.select(*_FDC_SCALARS, last_wins_map(F.col("nutrients")).alias("nutrients"))


def nutrient_rows(rows: DataFrame, seq: str) -> DataFrame:
    """(fdc_id, name, amount, unit_name): the last row of each name of a food, by `seq`."""
    return last_wins(rows, ["fdc_id", "name"], F.col(seq), ["amount", "unit_name"])


def nutrients_wide(rows: DataFrame, seq: str, energy_unit: str | None = None) -> DataFrame:
    """One row per food with the canonical amounts, from one row per nutrient.

    A single aggregation on `fdc_id`, combined map-side. Energy takes the last row
    whatever its unit, unless `energy_unit` restricts it.
    """
    def amount(field: str, name: str) -> Column:
        wanted = F.col("name") == name
        if field == "energy" and energy_unit:
            wanted = wanted & (F.upper("unit_name") == energy_unit.upper())
        return F.max_by("amount", F.when(wanted, F.col(seq))).alias(field)

    return rows.groupBy("fdc_id").agg(*[amount(f, n) for f, n in FDC_NUTRIENTS.items()])


def with_wide_nutrients(raw: DataFrame, energy_unit: str | None = None) -> DataFrame:
    """The canonical amounts as columns, straight from the nested list; no shuffle."""
    return raw.select(
        *_FDC_SCALARS,
        "gtin",
        *[
            last_amount(F.col("nutrients"), name, energy_unit if field == "energy" else None).alias(field)
            for field, name in FDC_NUTRIENTS.items()
        ],
    )


def fdc_by_gtin(
    fdc: DataFrame, gtins: DataFrame | None = None, data_type: str = "Branded"
) -> DataFrame:
    """The first branded record of each barcode, by smallest id, with all its columns."""
    hits = fdc.filter((F.col("data_type") == data_type) & F.col("gtin").isNotNull())
    rest = [c for c in fdc.columns if c not in ("gtin", "fdc_id")]
    picked = first_wins(_restrict(hits, "gtin", gtins), ["gtin"], F.col("fdc_id"), ["fdc_id", *rest])
    return picked
