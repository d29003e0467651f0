"""Explicit schemas. Codes are text everywhere and never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_STR = T.StringType()


def _node(children: str | None = None, child_type: T.DataType | None = None) -> T.StructType:
    """One XML element: its two attributes and, optionally, its repeated child element."""
    fields = [T.StructField("_code", _STR), T.StructField("_text", _STR)]
    if children:
        fields.append(T.StructField(children, T.ArrayType(child_type)))
    return T.StructType(fields)


ATT_VALUE = _node()
ATT_TYPE = _node("attValue", ATT_VALUE)
BRICK = _node("attType", ATT_TYPE)
CLASS = _node("brick", BRICK)
FAMILY = _node("class", CLASS)
SEGMENT = _node("family", FAMILY)

# table -> (columns, key columns, {parent column: (parent table, parent key)})
TAXONOMY_TABLES: dict[str, tuple[list[str], list[str], dict[str, tuple[str, str]]]] = {
    "segments": (["segment_code", "description"], ["segment_code"], {}),
    "families": (
        ["family_code", "description", "segment_code"],
        ["family_code"],
        {"segment_code": ("segments", "segment_code")},
    ),
    "classes": (
        ["class_code", "description", "family_code"],
        ["class_code"],
        {"family_code": ("families", "family_code")},
    ),
    "bricks": (
        ["brick_code", "description", "class_code"],
        ["brick_code"],
        {"class_code": ("classes", "class_code")},
    ),
    "attribute_types": (["att_type_code", "att_type_text"], ["att_type_code"], {}),
    "attribute_values": (["att_value_code", "att_value_text"], ["att_value_code"], {}),
    "brick_attribute_types": (
        ["brick_code", "att_type_code"],
        ["brick_code", "att_type_code"],
        {
            "brick_code": ("bricks", "brick_code"),
            "att_type_code": ("attribute_types", "att_type_code"),
        },
    ),
    "attribute_type_values": (
        ["att_type_code", "att_value_code"],
        ["att_type_code", "att_value_code"],
        {
            "att_type_code": ("attribute_types", "att_type_code"),
            "att_value_code": ("attribute_values", "att_value_code"),
        },
    ),
}

METADATA = T.StructType([T.StructField("key", _STR), T.StructField("value", _STR)])

OFF_RAW = T.StructType(
    [
        T.StructField(name, _STR)
        for name in (
            "code", "product_name", "brands", "image_url",
            "ingredients_text", "quantity", "serving_size",
        )
    ]
    + [
        T.StructField(name, T.ArrayType(_STR))
        for name in ("categories_tags", "allergens_tags", "labels_tags")
    ]
    + [T.StructField("nutriments", T.MapType(_STR, _STR))]
)

FDC_NUTRIENT = T.StructType(
    [
        T.StructField("name", _STR),
        T.StructField("amount", T.DoubleType()),
        T.StructField("unit_name", _STR),
    ]
)

FDC_RAW = T.StructType(
    [
        T.StructField("fdc_id", T.LongType()),
        T.StructField("description", _STR),
        T.StructField("data_type", _STR),
        T.StructField("brand_owner", _STR),
        T.StructField("brand_name", _STR),
        T.StructField("ingredients", _STR),
        T.StructField("serving_size", T.DoubleType()),
        T.StructField("serving_size_unit", _STR),
        T.StructField("nutrients", T.ArrayType(FDC_NUTRIENT)),
        T.StructField("gtin", _STR),
    ]
)

NUTRIENT_VALUE = T.StructType(
    [T.StructField("value", T.DoubleType()), T.StructField("unit", _STR)]
)

CANONICAL = T.StructType(
    [
        T.StructField("gtin", _STR),
        T.StructField("product_name", _STR),
        T.StructField("brand", _STR),
        T.StructField("category_hierarchy", T.ArrayType(_STR)),
        T.StructField("calories_kcal", T.DoubleType()),
    ]
    + [
        T.StructField(name, NUTRIENT_VALUE)
        for name in ("protein", "fat", "carbohydrates", "fiber", "sugars", "sodium")
    ]
    + [
        T.StructField("image_url", _STR),
        T.StructField("ingredients_text", _STR),
        T.StructField("allergens", T.ArrayType(_STR)),
        T.StructField("labels", T.ArrayType(_STR)),
        T.StructField("data_sources", T.ArrayType(_STR)),
    ]
)
