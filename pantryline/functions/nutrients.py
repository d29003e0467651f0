"""Nutrient extraction and precedence as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Keys of the crowdsourced nutrient map and the names they get.
OFF_NUTRIENTS = {
    "energy-kcal_100g": "calories_kcal",
    "proteins_100g": "protein_g",
    "fat_100g": "fat_g",
    "carbohydrates_100g": "carbohydrates_g",
    "fiber_100g": "fiber_g",
    "sugars_100g": "sugars_g",
    "sodium_100g": "sodium_g",
    "salt_100g": "salt_g",
}

# Laboratory nutrient names by canonical field.
FDC_NUTRIENTS = {
    "energy": "Energy",
    "protein": "Protein",
    "fat": "Total lipid (fat)",
    "carbohydrates": "Carbohydrate, by difference",
    "fiber": "Fiber, total dietary",
    "sugars": "Sugars, total including NLEA",
    "sodium": "Sodium, Na",
}


def off_nutrient_struct(nutriments: Column) -> Column:
    """The eight known nutrients as numbers; unreadable text becomes null."""
    return F.struct(
        *[
            F.try_element_at(nutriments, F.lit(key)).try_cast("double").alias(name)
            for key, name in OFF_NUTRIENTS.items()
        ]
    )


def off_nutrient_map(nutrients: Column) -> Column:
    """The non-null members of `off_nutrient_struct` as a map."""
    pairs = []
    for name in OFF_NUTRIENTS.values():
        pairs += [F.lit(name), nutrients[name]]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def last_wins_map(entries: Column) -> Column:
    """Nutrient list -> map name -> (amount, unit); of equal names the last one stays.

    Entries are sorted by name and place, so the last of a name is the one before the next name.
    """
    placed = F.transform(
        F.coalesce(entries, F.array()),
        lambda e, i: F.struct(e["name"].alias("name"), i.alias("at"), e["amount"].alias("amount"), e["unit_name"].alias("unit")),
    )
    ordered = F.array_sort(F.filter(placed, lambda e: e["name"].isNotNull()))
    following = F.concat(
        F.transform(F.slice(ordered, 2, F.greatest(F.size(ordered), F.lit(1))), lambda e: e["name"]),
        F.array(F.lit(None).cast("string")),
    )
    # A name is there once more at the end of an empty list; its entry is null and is dropped.
    paired = F.arrays_zip(ordered.alias("entry"), following.alias("next"))
    last = F.filter(paired, lambda p: p["entry"].isNotNull() & ~p["entry"]["name"].eqNullSafe(p["next"]))
    return F.map_from_entries(
        F.transform(
            last,
            lambda p: F.struct(
                p["entry"]["name"].alias("key"),
                F.struct(p["entry"]["amount"].alias("amount"), p["entry"]["unit"].alias("unit")).alias("value"),
            ),
        )
    )


def last_amount(entries: Column, name: str, unit: str | None = None) -> Column:
    """Amount of the last entry called `name`, optionally only among one unit."""

    def wanted(e: Column) -> Column:
        hit = e["name"] == name
        return hit & (F.upper(e["unit_name"]) == unit.upper()) if unit else hit

    return F.try_element_at(F.filter(entries, wanted), F.lit(-1))["amount"]


def amount_of(nutrients: Column, name: str) -> Column:
    """Amount under `name` in a nutrient map, null when absent."""
    return F.try_element_at(nutrients, F.lit(name))["amount"]


def nutrient_value(value: Column, unit: str | Column = "g") -> Column:
    """`{value, unit}`, or null without a value."""
    unit_col = F.lit(unit) if isinstance(unit, str) else unit
    return F.when(
        value.isNotNull(), F.struct(value.cast("double").alias("value"), unit_col.alias("unit"))
    )
