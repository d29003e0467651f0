"""Reconciliation against the rules written out one product at a time."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F, types as T

from pantryline.functions.nutrients import FDC_NUTRIENTS, OFF_NUTRIENTS
from pantryline.plans.categories import map_categories
from pantryline.plans.products import fdc_by_gtin, named_only, shape_off, with_wide_nutrients
from pantryline.plans.reconcile import reconcile, reconcile_stored, sodium_in_mg, store_sources
from pantryline.plans.taxonomy import Taxonomy
from pantryline.schemas import CANONICAL, FDC_RAW, OFF_RAW, TAXONOMY_TABLES
from pantryline.sources.buckets import _name, buckets_for, only_keys, read_bucketed, store_bucketed

BRICKS = [
    ("b3", "Beverages (Cold)", "c1"), ("b1", "Cold beverages", "c2"), ("b2", "Oat Milk", "c1"), ("b0", "", "none"),
]
TAXONOMY = {
    "segments": [("s1", "Food")],
    "families": [("f1", "Drinks", "s1"), ("f2", "", "s1")],
    "classes": [("c1", "Soft", "f1"), ("c2", None, "f2")],
    "bricks": BRICKS,
}
PATHS = {"b3": ["Food", "Drinks", "Soft", "Beverages (Cold)"], "b1": ["Food", "Cold beverages"],
         "b2": ["Food", "Drinks", "Soft", "Oat Milk"], "b0": []}


def taxonomy(spark):
    return Taxonomy(
        **{
            n: spark.createDataFrame(TAXONOMY.get(n, []), ",".join(f"{c} string" for c in spec[0]))
            for n, spec in TAXONOMY_TABLES.items()
        }
    )


# tag list -> (path or labels, whether a brick was found), written by hand
HIERARCHIES = {
    (): ([], False),
    ("en:beverages",): (PATHS["b1"], True),
    ("en:xyz", "en:oat-milk"): (PATHS["b2"], True),
    ("en:x", "en:y", "en:z", "en:oat-milk"): (["X", "Y", "Z", "Oat Milk"], False),
    ("en:",): ([""], False),
    ("plain", "en:o'brien-3rd"): (["plain", "O'Brien 3Rd"], False),
    ("a", "b", "c", "d", "e", "f"): (PATHS["b1"], True),
    ("fr:x:cold-beverages",): (PATHS["b1"], True),
    ("OAT MILK",): (PATHS["b2"], True),
}


def hierarchy(tags):
    return HIERARCHIES[tuple(tags)]


def number(text):
    try:
        return float(text)
    except (TypeError, ValueError):
        return None


def expected(gtin, o, u):
    """One product from its raw crowdsourced and laboratory record."""
    off = {n: number((o["nutriments"] or {}).get(k)) for k, n in OFF_NUTRIENTS.items()} if o else {}
    last = {}
    for n in (u["nutrients"] or []) if u else []:
        last[n["name"]] = n["amount"]
    lab = {f: last.get(n) for f, n in FDC_NUTRIENTS.items()}
    tags = (o["categories_tags"] or []) if o else []
    path, mapped = hierarchy(tags)

    def pick(field, off_field, lab_unit="g"):
        if lab[field] is not None:
            return (lab[field], lab_unit)
        return (off[off_field], "g") if off.get(off_field) is not None else None

    return {
        "gtin": gtin,
        "product_name": (u and u["description"]) or (o and o["product_name"]) or "Unknown",
        "brand": (u and (u["brand_owner"] or u["brand_name"])) or (o and o["brands"]) or None,
        "category_hierarchy": path,
        "calories_kcal": lab["energy"] if lab["energy"] is not None else off.get("calories_kcal"),
        "protein": pick("protein", "protein_g"),
        "fat": pick("fat", "fat_g"),
        "carbohydrates": pick("carbohydrates", "carbohydrates_g"),
        "fiber": pick("fiber", "fiber_g"),
        "sugars": pick("sugars", "sugars_g"),
        "sodium": pick("sodium", "sodium_g", "mg"),
        "image_url": o["image_url"] if o else None,
        "ingredients_text": (o and o["ingredients_text"]) or (u and u["ingredients"]) or (o["ingredients_text"] if o else None),
        "allergens": (o["allergens_tags"] or []) if o else [],
        "labels": (o["labels_tags"] or []) if o else [],
        "data_sources": ["OpenFoodFacts"] * bool(o) + ["USDA_FDC"] * bool(u) + ["GS1_GPC"] * mapped,
    }


TAG_LISTS = [
    None, [], ["en:beverages"], ["en:xyz", "en:oat-milk"], ["en:x", "en:y", "en:z", "en:oat-milk"], ["en:"],
    ["plain", "en:o'brien-3rd"], ["a", "b", "c", "d", "e", "f"], ["fr:x:cold-beverages"], ["OAT MILK"],
]


def make(seed, n=120):
    rng = random.Random(seed)
    text = lambda *extra: rng.choice([None, "", *extra])
    off, fdc = [], []
    for i in range(n):
        if rng.random() < 0.7:
            nutriments = rng.choice([None, {}, {k: rng.choice(["1.5", "0", "bad", "7"]) for k in OFF_NUTRIENTS if rng.random() < 0.6}])
            off.append(
                (str(i), text(f"off {i}", f"off {i}", f"off {i}"), text("b"), text("u"), text("ing"), None, None,
                 rng.choice(TAG_LISTS), rng.choice([None, ["en:milk"]]), rng.choice([None, ["l"]]), nutriments)
            )
        for _ in range(rng.choice([0, 1, 1, 2])):
            nutrients = rng.choice(
                [None, [], [(rng.choice(list(FDC_NUTRIENTS.values())), rng.choice([None, 0.0, 3.0]), "G") for _ in range(9)]]
            )
            fdc.append(
                (len(fdc), text(f"lab {i}"), rng.choice(["Branded", "Foundation"]), text("owner"), text("name"),
                 text("lab ing"), None, None, nutrients, str(i))
            )
    return off, fdc


def model(off, fdc):
    o = {r[0]: dict(zip(OFF_RAW.names, r)) for r in off if r[1]}
    u = {}
    for r in fdc:
        if r[2] == "Branded" and r[9] not in u:
            food = dict(zip(FDC_RAW.names, r))
            food["nutrients"] = [dict(zip(("name", "amount", "unit"), n)) for n in food["nutrients"] or []]
            u[r[9]] = food
    return {g: expected(g, o.get(g), u.get(g)) for g in set(o) | set(u)}


def frames(spark, off, fdc):
    o = spark.createDataFrame(off, OFF_RAW).repartition(4)
    u = spark.createDataFrame(fdc, FDC_RAW).repartition(3)
    return named_only(shape_off(o)), fdc_by_gtin(with_wide_nutrients(u))


def plain(row):
    out = row.asDict()
    return {k: tuple(v) if isinstance(v, T.Row) else v for k, v in out.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_catalogue_matches_the_rules(spark, seed):
    off, fdc = make(seed)
    want = model(off, fdc)
    o, u = frames(spark, off, fdc)
    df = reconcile(o, u, taxonomy(spark))
    assert [(f.name, f.dataType.simpleString()) for f in df.schema] == [
        (f.name, f.dataType.simpleString()) for f in CANONICAL
    ]
    rows = [plain(r) for r in df.collect()]
    assert len(rows) == len(want)
    for r in rows:
        assert r == want[r["gtin"]]


def test_asked_for_barcodes(spark):
    off, fdc = make(3)
    want = model(off, fdc)
    o, u = frames(spark, off, fdc)
    asked = spark.createDataFrame([(str(i),) for i in [*range(40), 7, 7, 9999]], "g string")
    rows = [plain(r) for r in reconcile(o, u, taxonomy(spark), asked).collect()]
    assert {r["gtin"]: r for r in rows} == {g: r for g, r in want.items() if int(g) < 40}
    assert len(rows) == len({r["gtin"] for r in rows})


def test_repeated_products_do_not_multiply(spark):
    off, fdc = make(4, 40)
    o, u = frames(spark, off + off, fdc)
    rows = [plain(r) for r in reconcile(o, u, taxonomy(spark)).collect()]
    assert {r["gtin"]: r for r in rows} == model(off, fdc) and len(rows) == len(model(off, fdc))


def test_map_categories(spark):
    df = spark.createDataFrame([(i, t or []) for i, t in enumerate(TAG_LISTS)], "i int, categories array<string>")
    for r in map_categories(df, taxonomy(spark)).collect():
        path, mapped = hierarchy(TAG_LISTS[r["i"]] or [])
        assert (r["category_hierarchy"], r["mapped"]) == (path, mapped), TAG_LISTS[r["i"]]


def test_rows_without_a_barcode_are_left_out(spark):
    off, fdc = make(6, 40)
    no_off = [(None, *off[0][1:]), (None, "nameless barcode", *off[1][2:])]
    no_fdc = [(10_000, "x", "Branded", *fdc[0][3:9], None)]
    o, u = frames(spark, off + no_off, fdc + no_fdc)
    asked = spark.createDataFrame([(str(i),) for i in range(40)] + [(None,)], "g string")
    for gtins in (None, asked):
        assert {r["gtin"] for r in reconcile(o, u, taxonomy(spark), gtins).collect()} == set(model(off, fdc))


def test_the_filled_record_of_a_barcode_counts(spark):
    empty = ("7", "a name", *[None] * 9)
    full = ("7", "b name", "brand", "image", "flour", "1 kg", None, [], ["en:milk"], ["l"], {"fat_100g": "2"})
    o, u = frames(spark, [empty, full, empty], [])
    (row,) = reconcile(o, u, taxonomy(spark)).collect()
    assert (row["product_name"], row["brand"], row["image_url"]) == ("b name", "brand", "image")


def test_only_asked_for_products_are_mapped(spark):
    off, fdc = make(7)
    o, u = frames(spark, off, fdc)
    asked = spark.createDataFrame([("3",)], "g string")
    text = reconcile(o, u, taxonomy(spark), asked)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Join LeftSemi") >= 2  # of either source, wherever its rows are read


def test_sodium_in_mg(spark):
    off, fdc = make(5, 60)
    o, u = frames(spark, off, fdc)
    df = reconcile(o, u, taxonomy(spark))
    before = {r["gtin"]: r["sodium"] for r in df.collect()}
    for r in sodium_in_mg(df).collect():
        if before[r["gtin"]] is None:
            assert r["sodium"] is None
        else:
            value, unit = before[r["gtin"]]
            assert tuple(r["sodium"]) == (value * 1000 if unit == "g" else value, "mg")


def test_hot_tag_list(spark):
    """A third of the products share their tags; each still gets its own row."""
    df = spark.range(3000).select(
        F.col("id"), F.when(F.col("id") < 1000, F.array(F.lit("en:oat-milk"))).otherwise(
            F.array(F.concat(F.lit("en:n"), F.col("id").cast("string")))
        ).alias("categories"),
    )
    got = map_categories(df, taxonomy(spark))
    assert got.count() == 3000 and got.filter("mapped").count() == 1000


def test_stored_sources_give_the_same_without_an_exchange(spark, tmp_path):
    """Bucket meets bucket: not even a broadcast may help, and no row of either source is shuffled."""
    off, fdc = make(3)
    off = named_only(shape_off(spark.createDataFrame(off, OFF_RAW)))
    fdc = fdc_by_gtin(with_wide_nutrients(spark.createDataFrame(fdc, FDC_RAW)))
    t, path = taxonomy(spark), str(tmp_path / "sources")
    store_sources(off, fdc, t, path, buckets=8)
    columns = [f.name for f in CANONICAL.fields]
    rows = lambda df: sorted(map(str, df.select(*columns).collect()))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    asked = spark.createDataFrame([("3",), ("5",), ("5",), ("none",), (None,)], "code string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        whole = reconcile_stored(spark, path)
        assert rows(whole) == rows(reconcile(off, fdc, t))
        assert "Exchange" not in plan(whole) and plan(whole).count("Bucketed: true") == 2

        some = reconcile_stored(spark, path, ["3", "5", "none"])
        assert rows(some) == rows(reconcile(off, fdc, t, asked)) == rows(reconcile_stored(spark, path, asked))
        assert "Exchange" not in plan(some)
        one = plan(reconcile_stored(spark, path, ["3"]))
        assert one.count("SelectedBucketsCount: 1 out of 8") == 2

        # Of a table of barcodes only these are dealt: every exchange lies above them, none above a source.
        text = plan(reconcile_stored(spark, path, asked))
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        lines = [x for x in text.split("Initial Plan")[0].splitlines() if x.strip()]
        above = None
        for line in lines:
            if above is not None and depth(line) <= above:
                above = None
            if above is not None:
                assert "Bucketed: true" not in line
            elif "Exchange" in line:
                above = depth(line)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_later_session_reads_stored_buckets(spark, tmp_path):
    path = str(tmp_path / "rows")
    df = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "gtin string, x int")
    store_bucketed(df, path, "gtin", 4)
    other = spark.newSession()
    other.sql(f"DROP TABLE IF EXISTS `{_name(path)}`")
    assert sorted(map(str, read_bucketed(other, path).collect())) == sorted(map(str, df.collect()))
    assert [r["x"] for r in only_keys(read_bucketed(other, path), "gtin", ["b", None]).collect()] == [3]
    assert [buckets_for(n) for n in (0, 16_000_000, 16_000_001, 10**9)] == [8, 8, 16, 512]
