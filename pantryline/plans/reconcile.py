"""One canonical product per barcode from both sources and the classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pantryline.functions.nutrients import nutrient_value
from pantryline.functions.text import truthy
from pantryline.operators.dedup import one_per_key
from pantryline.plans.categories import map_categories
from pantryline.plans.taxonomy import Taxonomy
from pantryline.sources.buckets import only_keys, read_bucketed, store_bucketed

# Source names, in the order they are listed.
OFF, FDC, GPC = "OpenFoodFacts", "USDA_FDC", "GS1_GPC"

_GRAMS = {
    "protein": "protein_g",
    "fat": "fat_g",
    "carbohydrates": "carbohydrates_g",
    "fiber": "fiber_g",
    "sugars": "sugars_g",
}


def _layered(fdc: Column, fdc_unit: str, off: Column, off_unit: str) -> Column:
    """The laboratory amount if there is one, else the crowdsourced one, each with its unit."""
    return F.coalesce(nutrient_value(fdc, fdc_unit), nutrient_value(off, off_unit))


def reconcile(
    off: DataFrame, fdc: DataFrame, t: Taxonomy, gtins: DataFrame | None = None
) -> DataFrame:
    """Canonical products of the asked-for barcodes, or of the whole catalogue.

    `off` is `named_only(shape_off(...))`, `fdc` one wide row per barcode as
    `fdc_by_gtin` gives. Both sources are restricted to the asked-for barcodes before
    anything else, and have one row per barcode before they meet, so a barcode cannot
    multiply rows or make a join partition hot. Of several crowdsourced records of a barcode
    the one with most fields filled counts. Rows without a barcode and barcodes without any
    source are dropped. Runs jobs when called, as the mapping of tags does.
    """
    off, fdc = off.filter(F.col("barcode").isNotNull()), fdc.filter(F.col("gtin").isNotNull())
    if gtins is not None:
        wanted = gtins.select(F.col(gtins.columns[0]).alias("gtin")).filter(F.col("gtin").isNotNull()).distinct()
        off = off.join(wanted.withColumnRenamed("gtin", "barcode"), "barcode", "left_semi")
        fdc = fdc.join(wanted, "gtin", "left_semi")
    return _merged(_one_per_barcode(off, t), fdc)


def _one_per_barcode(off: DataFrame, t: Taxonomy) -> DataFrame:
    """Crowdsourced products with their categories, one per barcode, as `gtin`.

    Mapped before de-duplication: the latter leaves rows partitioned for the joins.
    """
    return one_per_key(map_categories(off, t), "barcode").withColumnRenamed("barcode", "gtin")


def store_sources(off: DataFrame, fdc: DataFrame, t: Taxonomy, path: str, buckets: int) -> None:
    """Write both sources below `path`, each with one row per barcode, in equal buckets of it.

    The inputs are those of `reconcile`. Mapping of categories and choice of records happen here, once;
    `reconcile_stored` then needs no exchange of either source.
    """
    store_bucketed(_one_per_barcode(off.filter(F.col("barcode").isNotNull()), t), f"{path}/off", "gtin", buckets)
    store_bucketed(fdc.filter(F.col("gtin").isNotNull()), f"{path}/fdc", "gtin", buckets)


def reconcile_stored(spark: SparkSession, path: str, gtins: list[str] | DataFrame | None = None) -> DataFrame:
    """What `reconcile` gives, from stored sources: bucket meets bucket, and neither side is shuffled.

    A list of barcodes opens only their buckets; of a table of barcodes (first column) only these are
    dealt into buckets.
    """
    off, fdc = (only_keys(read_bucketed(spark, f"{path}/{name}"), "gtin", gtins) for name in ("off", "fdc"))
    return _merged(off, fdc)


def _merged(off: DataFrame, fdc: DataFrame) -> DataFrame:
    """Canonical products from one row per barcode of each source."""
    left = off.select("gtin", F.struct(*[c for c in off.columns if c != "gtin"]).alias("o"))
    right = fdc.select("gtin", F.struct(*[c for c in fdc.columns if c != "gtin"]).alias("u"))
    both = left.join(right, "gtin", "full")

    o, u = F.col("o"), F.col("u")
    sources = F.array_compact(
        F.array(
            F.when(o.isNotNull(), OFF),
            F.when(u.isNotNull(), FDC),
            F.when(o["mapped"], GPC),
        )
    )
    product = both.select(
        "gtin",
        F.coalesce(truthy(u["description"]), truthy(o["product_name"]), F.lit("Unknown")).alias(
            "product_name"
        ),
        F.coalesce(truthy(u["brand_owner"]), truthy(u["brand_name"]), truthy(o["brands"])).alias("brand"),
        F.coalesce(o["category_hierarchy"], F.array()).alias("category_hierarchy"),
        F.coalesce(u["energy"], o["nutrients"]["calories_kcal"]).alias("calories_kcal"),
        *[
            _layered(u[name], "g", o["nutrients"][off_name], "g").alias(name)
            for name, off_name in _GRAMS.items()
        ],
        _layered(u["sodium"], "mg", o["nutrients"]["sodium_g"], "g").alias("sodium"),
        o["image_url"].alias("image_url"),
        F.coalesce(
            truthy(o["ingredients_text"]), truthy(u["ingredients"]), o["ingredients_text"]
        ).alias("ingredients_text"),
        F.coalesce(o["allergens"], F.array()).alias("allergens"),
        F.coalesce(o["labels"], F.array()).alias("labels"),
        sources.alias("data_sources"),
    )
    return product.filter(F.size("data_sources") > 0)


def sodium_in_mg(products: DataFrame) -> DataFrame:
    """Bring every sodium value to mg; off by default, since sources keep their own unit."""
    grams = F.col("sodium.unit") == "g"
    value = F.when(grams, F.col("sodium.value") * 1000).otherwise(F.col("sodium.value"))
    return products.withColumn("sodium", nutrient_value(value, "mg"))
