from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from pantryline.functions.nutrients import FDC_NUTRIENTS, amount_of, last_wins_map
from pantryline.plans import products, search
from pantryline.schemas import FDC_RAW, OFF_RAW
from pantryline.sources.products import read_fdc, read_off

OFF_LINES = [
    {"code": "1", "product_name": "Oat Drink", "brands": "Oaty", "categories_tags": ["en:beverages"],
     "nutriments": {"energy-kcal_100g": 46, "proteins_100g": "1.0", "fat_100g": "n/a", "fiber_100g": None, "x": "9",
                    "salt_100g": 0}, "ignored": True},
    {"code": "2", "product_name": "", "brands": "OAT co"},
    {"code": "3", "brands": None, "allergens_tags": ["en:milk"], "labels_tags": []},
    {"code": "4", "product_name": "Tea", "nutriments": {}},
]


@pytest.fixture(scope="module")
def off(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("off") / "dump.jsonl"
    path.write_text("\n".join(map(json.dumps, OFF_LINES)))
    return read_off(spark, str(path))


def test_off_products(spark, off):
    got = {r["barcode"]: r.asDict(True) for r in products.off_products(off).collect()}
    assert set(got) == {"1", "4"}
    assert got["1"]["nutrients_per_100g"] == {"calories_kcal": 46.0, "protein_g": 1.0, "salt_g": 0.0}
    assert got["1"]["categories"] == ["en:beverages"] and got["1"]["allergens"] == [] and got["1"]["labels"] == []
    assert got["4"]["nutrients_per_100g"] == {}
    asked = spark.createDataFrame([("4",), ("2",), ("4",)], "g string")
    assert [r["barcode"] for r in products.off_products(off, asked).collect()] == ["4"]


def test_null_nutriments_keep_the_product(off):
    shaped = products.with_nutrient_map(products.shape_off(off))
    got = {r["barcode"]: r["nutrients_per_100g"] for r in shaped.collect()}
    assert got["2"] == {} and got["3"] == {}


def test_off_search_keeps_unnamed(off):
    page = search.search_products(products.shape_off(off), "oat", n=1)
    assert [r["barcode"] for r in page.rows.collect()] == ["1"]
    assert page.info.first()["total"] == 2
    with pytest.raises(ValueError):
        search.search_products(products.shape_off(off), "oat", n=101)


def nutrient(name, amount, unit="G"):
    return {"name": name, "amount": amount, "unit_name": unit}


FDC_LINES = [
    {"fdc_id": 7, "description": "Oat milk", "data_type": "Branded", "brand_owner": "O", "gtin": "1",
     "serving_size": 240.0, "serving_size_unit": "ml",
     "nutrients": [nutrient("Energy", 46.0, "KCAL"), nutrient("Protein", 1.0), nutrient("Energy", 192.0, "kJ"),
                   nutrient("Protein", None), nutrient("Sodium, Na", 40.0, "MG")]},
    {"fdc_id": 5, "description": "Oats", "data_type": "Foundation", "gtin": "1", "nutrients": []},
    {"fdc_id": 9, "description": "Oat milk again", "data_type": "Branded", "gtin": "1"},
    {"fdc_id": 3, "description": "Tea", "data_type": "Branded", "brand_name": "oaty", "gtin": "2"},
    {"fdc_id": 4, "description": "No code", "data_type": "Branded"},
]


@pytest.fixture(scope="module")
def fdc(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("fdc") / "dump.jsonl"
    path.write_text("\n".join(map(json.dumps, FDC_LINES)))
    return read_fdc(spark, str(path)).repartition(4)


def test_fdc_foods_last_nutrient_wins(spark, fdc):
    ids = spark.createDataFrame([(7,), (5,)], "i long")
    got = {r["fdc_id"]: r for r in products.fdc_foods(fdc, ids).collect()}
    assert set(got) == {7, 5}
    assert {k: tuple(v) for k, v in got[7]["nutrients"].items()} == {
        "Energy": (192.0, "kJ"), "Protein": (None, "G"), "Sodium, Na": (40.0, "MG"),
    }
    assert got[5]["nutrients"] == {}
    assert got[7]["serving_size"] == 240.0


def test_amount_of(spark, fdc):
    foods = products.fdc_foods(fdc)
    got = {r[0]: r[1] for r in foods.select("fdc_id", amount_of(F.col("nutrients"), "Sodium, Na")).collect()}
    assert got[7] == 40.0 and got[3] is None


def test_last_wins_map_drops_null_names(spark):
    rows = [([{"name": None, "amount": 1.0, "unit_name": "G"}, {"name": "a", "amount": 2.0, "unit_name": "G"}],)]
    df = spark.createDataFrame(rows, FDC_RAW["nutrients"].dataType.simpleString().join(["n ", ""]))
    assert {k: v["amount"] for k, v in df.select(last_wins_map(F.col("n"))).first()[0].items()} == {"a": 2.0}


def test_wide_forms_agree(spark, fdc):
    nested = {r["fdc_id"]: r for r in products.with_wide_nutrients(fdc).collect()}
    long = fdc.select("fdc_id", F.posexplode("nutrients").alias("seq", "n")).select("fdc_id", "seq", "n.*")
    wide = {r["fdc_id"]: r for r in products.nutrients_wide(long.repartition(3), "seq").collect()}
    for fields in [list(FDC_NUTRIENTS)]:
        assert [nested[7][f] for f in fields] == [wide[7][f] for f in fields]
    assert (nested[7]["energy"], nested[7]["protein"], nested[7]["sodium"]) == (192.0, None, 40.0)
    assert {r["fdc_id"]: r["energy"] for r in products.with_wide_nutrients(fdc, "kcal").collect()}[7] == 46.0
    assert products.nutrients_wide(long, "seq", "KCAL").filter("fdc_id = 7").first()["energy"] == 46.0


def test_first_branded_per_barcode(spark, fdc):
    got = {r["gtin"]: r["fdc_id"] for r in products.fdc_by_gtin(fdc).collect()}
    assert got == {"1": 7, "2": 3}
    asked = spark.createDataFrame([("2",), ("x",)], "g string")
    assert [r["fdc_id"] for r in products.fdc_by_gtin(fdc, asked).collect()] == [3]


def test_food_search(fdc):
    page = search.search_foods(fdc, "OAT", 2)
    assert [r["fdc_id"] for r in page.rows.collect()] == [3, 5]
    assert page.rows.columns == ["fdc_id", "description", "data_type", "brand_owner", "brand_name"]
    assert page.info.first()["total_hits"] == 4


def test_dump_formats(spark, tmp_path, off):
    off.write.parquet(str(tmp_path / "p"))
    assert read_off(spark, str(tmp_path / "p"), "parquet").schema == OFF_RAW
    off.write.orc(str(tmp_path / "o"))
    assert read_off(spark, str(tmp_path / "o"), "orc").count() == 4
    with pytest.raises(ValueError):
        read_off(spark, str(tmp_path), "csv")
