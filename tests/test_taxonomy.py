from __future__ import annotations

import re
from dataclasses import replace

import pytest

from pantryline.plans import search, taxonomy as tx
from pantryline.plans.refresh import catalog_summary

T = {
    "segments": [("1", "Food"), ("2", None), ("3", "")],
    "families": [("11", "Fruit", "1"), ("12", None, "1"), ("21", "Misc", "2"), ("13", "fruit juice", "1")],
    "classes": [("111", "Fresh", "11"), ("112", "", "11"), ("211", "Odd", "21"), ("999", "Lost", "gone")],
    "bricks": [
        ("1111", "Apple", "111"), ("1112", "100% Pear_x", "111"), ("1121", "Fig", "112"), ("2111", None, "211"),
        ("9991", "Stray", "999"), ("8881", "Orphan", ""),
    ],
    "attribute_types": [("t1", "Colour"), ("t2", "Size"), ("t3", "Unused")],
    "attribute_values": [("v1", "Red"), ("v2", "Green"), ("v3", "Big")],
    "brick_attribute_types": [("1111", "t2"), ("1111", "t1"), ("1112", "t1"), ("1121", "t9")],
    "attribute_type_values": [("t1", "v2"), ("t1", "v1"), ("t2", "v9")],
}


@pytest.fixture(scope="module")
def t(spark):
    from pantryline.schemas import TAXONOMY_TABLES

    return tx.Taxonomy(
        **{
            n: spark.createDataFrame(r, ",".join(f"{c} string" for c in TAXONOMY_TABLES[n][0])).repartition(3)
            for n, r in T.items()
        }
    )


def test_brick_path(t):
    got = {r["brick_code"]: (r["full_path"], r["path_parts"]) for r in tx.brick_path(t).collect()}
    assert got == {
        "1111": ("Food > Fruit > Fresh > Apple", ["Food", "Fruit", "Fresh", "Apple"]),
        "1112": ("Food > Fruit > Fresh > 100% Pear_x", ["Food", "Fruit", "Fresh", "100% Pear_x"]),
        "1121": ("Food > Fruit > Fig", ["Food", "Fruit", "Fig"]),
        "2111": ("Misc > Odd", ["Misc", "Odd"]),
        "9991": ("Lost > Stray", ["Lost", "Stray"]),
        "8881": ("Orphan", ["Orphan"]),
    }


def test_segment_detail(t):
    details = tx.segment_detail(t, ["1", "2", "3"]).collect()
    got = {r["segment_code"]: [f["family_code"] for f in r["families"]] for r in details}
    assert got == {"1": ["11", "12", "13"], "2": ["21"], "3": []}
    one = tx.segment_detail(t, ["2"]).collect()
    assert len(one) == 1 and one[0]["families"][0]["description"] == "Misc"
    assert tx.segment_detail(t, ["nope"]).count() == 0


def test_family_detail(t):
    got = {r["family_code"]: r for r in tx.family_detail(t, ["11", "12", "21"]).collect()}
    assert got["11"]["full_path"] == "Food > Fruit"
    assert got["11"]["segment_code_details"].asDict() == {"segment_code": "1", "segment_description": "Food"}
    assert [(c["class_code"], c["description"]) for c in got["11"]["classes"]] == [("111", "Fresh"), ("112", "")]
    assert got["12"]["full_path"] == "Food" and got["12"]["classes"] == []
    assert got["21"]["full_path"] == "Misc"


def test_class_detail(t):
    got = {r["class_code"]: r for r in tx.class_detail(t, ["111", "999"]).collect()}
    assert got["111"]["full_path"] == "Food > Fruit > Fresh"
    assert got["111"]["family_code_details"].asDict() == {
        "family_code": "11", "description": "Fruit", "segment_code": "1", "segment_description": "Food",
    }
    # The reference survives an absent family: its code is known, the rest is null.
    assert got["999"]["family_code_details"].asDict() == {
        "family_code": "gone", "description": None, "segment_code": None, "segment_description": None,
    }
    assert [b["brick_code"] for b in got["111"]["bricks"]] == ["1111", "1112"]


def test_brick_detail_lookup(spark, t):
    codes = spark.createDataFrame([("1111",), ("8881",), ("1121",), ("zzz",)], "c string")
    for asked in (["1111", "8881", "1121", "zzz"], codes):
        got = {r["brick_code"]: r for r in tx.brick_detail(t, asked).collect()}
        assert set(got) == {"1111", "8881", "1121"}
        assert [
            (a["att_type_code"], [v["att_value_code"] for v in a["values"]]) for a in got["1111"]["attributes"]
        ] == [("t1", ["v1", "v2"]), ("t2", [])]
        assert got["8881"]["class_code_details"] is None and got["8881"]["attributes"] == []
        assert got["1121"]["attributes"] == []
        assert got["1111"]["class_code_details"]["segment_description"] == "Food"


def test_brick_detail_in_ranges_sends_a_list_once_to_each(spark, t, monkeypatch):
    """A type of 50 values under 400 bricks: few of its lists are moved, and the result is the same in any ranges."""
    codes = [f"{i:04}" for i in range(400)]
    wide = replace(
        t,
        bricks=spark.createDataFrame([(c, "x", "111") for c in codes], "brick_code string, description string, class_code string"),
        attribute_values=spark.createDataFrame([(f"w{i:02}", "text") for i in range(50)], "att_value_code string, att_value_text string"),
        brick_attribute_types=spark.createDataFrame([(c, "t1") for c in codes], "brick_code string, att_type_code string"),
        attribute_type_values=spark.createDataFrame([("t1", f"w{i:02}") for i in range(50)], "att_type_code string, att_value_code string"),
    )
    for links in (150_000, 20):
        monkeypatch.setattr(tx, "RANGE_LINKS", links)
        df = tx.brick_detail(wide, codes)
        got = {r["brick_code"]: r["attributes"] for r in df.collect()}
        assert set(got) == set(codes)
        assert all(len(a) == 1 and [v[0] for v in a[0]["values"]] == [f"w{i:02}" for i in range(50)] for a in got.values())
    text = df._jdf.queryExecution().executedPlan().toString()
    # After the ranges are dealt nothing is shuffled by brick.
    assert "hashpartitioning(range" in text and "hashpartitioning(brick_code" not in text


def test_brick_detail_moves_numbers_of_values(spark, t, monkeypatch):
    """What goes to the ranges has no value's text while the values are few; beyond that it has, with the same result."""
    twice = replace(
        t,
        attribute_values=spark.createDataFrame([("v2", None), ("v1", "b"), ("v1", "a"), ("v1", "a"), (None, "x")], "att_value_code string, att_value_text string"),
        attribute_type_values=spark.createDataFrame(
            [("t1", "v1"), ("t1", "v2"), ("t1", "gone"), ("t1", None), (None, "v1")], "att_type_code string, att_value_code string"
        ),
    )

    def dealt(node):
        found = [node.schema().catalogString()] if "RepartitionByExpression [range" in node.nodeName() + " " + node.simpleString(9) else []
        below = node.children()
        return found + [x for i in range(below.size()) for x in dealt(below.apply(i))]

    got = []
    for most, text in ((1 << 20, False), (1, True)):
        monkeypatch.setattr(tx, "DICTIONARY_BYTES", most)
        df = tx.brick_detail(twice, ["1111", "8881", "1121", "zzz"])
        schemas = dealt(df._jdf.queryExecution().optimizedPlan())
        assert schemas and all(("att_value_text" in x) == text for x in schemas)
        got.append({r["brick_code"]: r.asDict(True) for r in df.collect()})
    assert got[0] == got[1] and set(got[0]) == {"1111", "8881", "1121"}
    lists = {a["att_type_code"]: [tuple(v.values()) for v in a["values"]] for a in got[0]["1111"]["attributes"]}
    assert lists == {"t1": [("v1", "a"), ("v1", "a"), ("v1", "b"), ("v2", None)], "t2": []}


def test_brick_detail_bundles_hold_every_brick(spark, t, monkeypatch):
    """Many bundles to a range, or one: the result is the same."""
    codes = [b[0] for b in T["bricks"]]
    want = sorted(map(str, tx.brick_detail(t, codes).collect()))
    monkeypatch.setattr(tx, "BUNDLE", 1)
    assert len(want) == len(codes) and sorted(map(str, tx.brick_detail(t, codes).collect())) == want


def test_children_are_joined_once(t):
    """The links of all bricks meet the bricks a single time, numbers and sizes included."""
    text = tx.brick_attributes(t)._jdf.queryExecution().executedPlan().toString()
    assert text.split("Initial Plan")[0].count("__salt") and len(re.findall(r"FileScan parquet \[[^\]]*att_type_text", text)) == 1


def test_whole_table_form_has_the_same_content(t):
    codes = [b[0] for b in T["bricks"]]
    detail = {
        (r["brick_code"], a["att_type_code"]): [tuple(v) for v in a["values"]]
        for r in tx.brick_detail(t, codes).collect()
        for a in r["attributes"]
    }
    values = {}
    for r in tx.type_values(t).orderBy("att_type_code", "position").collect():
        values.setdefault(r["att_type_code"], []).append((r["att_value_code"], r["att_value_text"]))
        assert r["position"] == len(values[r["att_type_code"]])
    factored = {}
    for r in tx.brick_attributes(t).collect():
        if r["n_types"]:
            factored[r["brick_code"], r["att_type_code"]] = values.get(r["att_type_code"], [])
            assert r["n_values"] == len(values.get(r["att_type_code"], []))
    assert factored == detail
    assert {r["brick_code"] for r in tx.brick_attributes(t).collect()} == set(codes)


def test_child_rows(t):
    got = sorted(tuple(r) for r in tx.child_rows(t, "segment").select("segment_code", "position", "family_code", "n_families").collect() if r[1])
    assert got == [("1", 1, "11", 3), ("1", 2, "12", 3), ("1", 3, "13", 3), ("2", 1, "21", 1)]
    alone = [tuple(r) for r in tx.child_rows(t, "segment").filter("n_families = 0").collect()]
    assert alone == [("3", "", None, None, None, 0)]


def test_lists(t):
    page = tx.list_level(t, "family", search="FRUIT", parent="1", page_size=1)
    assert [tuple(r) for r in page.flat().collect()] == [("11", "Fruit", 2, 2, None)]
    assert tx.list_level(t, "family", search="", parent="").info.first()["count"] == 4
    assert [r[0] for r in tx.list_level(t, "brick", search="0%p").rows.collect()] == ["1112"]
    assert [r[0] for r in tx.list_level(t, "brick", search="111").rows.collect()] == ["1111", "1112", "2111"]
    with pytest.raises(ValueError):
        tx.list_level(t, "shelf")
    with pytest.raises(ValueError):
        tx.list_level(t, "segment", parent="1")


def test_missing_codes(spark, t):
    asked = spark.createDataFrame([("111",), ("5",), ("5",)], "c string")
    assert [r[0] for r in tx.missing_codes(t, "class", asked).collect()] == ["5"]


def test_search(t):
    got = [tuple(r) for r in search.search_taxonomy(t, "fru").collect()]
    assert got == [("families", "11", "Fruit"), ("families", "13", "fruit juice")]
    assert [r["code"] for r in search.search_taxonomy(t, "11", "bricks").collect()] == ["1111", "1112", "1121", "2111"]
    entities = [r["entity"] for r in search.search_taxonomy(t, "1").collect()]
    assert entities == sorted(entities, key=["segments", "families", "classes", "bricks"].index)
    assert search.search_taxonomy(t, "").count() == 0
    with pytest.raises(ValueError):
        search.search_taxonomy(t, "x", "shelves")


def test_catalog_summary(spark, t):
    meta = spark.createDataFrame([("gpc_version", "9"), ("xml_date", "d")], "key string, value string")
    assert tuple(catalog_summary(t, meta).first()) == (3, "9", "d", None)
    assert tuple(catalog_summary(t, meta.limit(0)).first()) == (3, None, None, None)
