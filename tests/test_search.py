"""Search through stored grams against the same search over all rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pantryline.functions.text import any_contains
from pantryline.operators.trigrams import _grams, candidate_keys, read_candidates, store_index
from pantryline.plans import search

ROWS = [
    ("k1", "Orange Juice", "Ju"), ("k2", "juice of oranges", None), ("k3", None, "ORANGE"), ("k4", "", "a"),
    ("k4", "Same key", "orange"), ("k4", "same key, other row", "jui ce"), (None, "No key, orange", "x"),
    ("k5", "100% juice_pack \\ new", "é"), ("k6", "ÉCLAIR É", "\U0001f34a fruit"), ("k7", "ran", "ora nge"),
    ("k8", "Ju", "an"), ("k9", "jx juice", "%"), (None, None, None), ("k1", "Orange Juice", "Ju"),
]
QUERIES = [
    "orange", "JUICE", "an", "j", "é", "É", "ora%ge", "r_nge", "ju%ora", "%", "_", "__%", "100%", "\\", "\U0001f34a f",
    "zzz", "nge, x", "", "j%x", "ce_", " ", "key, o", None,
]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows = spark.createDataFrame(ROWS, "key string, name string, `brand.name` string")
    path = str(tmp_path_factory.mktemp("search") / "index")
    store_index(rows, "key", ["name", "brand.name"], path, buckets=4)
    return rows, path


def sorted_rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("ascii_only", [True, False])
@pytest.mark.parametrize("q", QUERIES)
def test_an_index_never_changes_the_result(spark, stored, q, ascii_only):
    rows, path = stored
    hit = any_contains([F.col("name"), F.col("`brand.name`")], q, ascii_only)
    narrowed = read_candidates(spark, path, "key", q, ascii_only)
    assert narrowed.columns == rows.columns
    assert sorted_rows(narrowed.filter(hit)) == sorted_rows(rows.filter(hit))


def test_candidates_have_all_grams_in_one_column(spark, stored):
    keys = {r["key"] for r in candidate_keys(spark, stored[1], "orange").collect()}
    assert keys == {"k1", "k2", "k3", "k4", None}
    assert candidate_keys(spark, stored[1], "%_") is None
    assert read_candidates(spark, stored[1], "key", "zzz").count() == 0


def test_an_empty_table(spark, tmp_path):
    rows = spark.createDataFrame([], "key string, name string")
    store_index(rows, "key", ["name"], str(tmp_path / "index"))
    for q in ("abc", "a", "%", ""):
        assert read_candidates(spark, str(tmp_path / "index"), "key", q).collect() == []


def scans(df):
    """(rows out, files read) of every scan of a plan that has run."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif node.nodeName().startswith("Scan"):
            found.append((node.metrics().apply("numOutputRows").value(), node.metrics().apply("numFiles").value()))
        else:
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
            if node.nodeName().endswith("QueryStage"):
                todo.append(node.plan())
    return found


def test_a_rare_text_reads_few_rows(spark, tmp_path):
    """One text of 200,000: a twentieth of the postings at most, and one bucket of 64."""
    n = 200_000
    rows = spark.range(n).select(
        F.col("id").cast("string").alias("key"),
        F.when(F.col("id") == 77_777, "a rare quince").otherwise(F.sha2(F.col("id").cast("string"), 256)).alias("name"),
    )
    path = str(tmp_path / "index")
    store_index(rows, "key", ["name"], path, buckets=64)
    postings = spark.read.parquet(f"{path}/grams").count()
    ((seen, _),) = scans(candidate_keys(spark, path, "Quince"))
    assert seen < postings / 20
    found = read_candidates(spark, path, "key", "Quince")
    assert sum(out for out, _ in scans(found)) < n / 20
    assert [r["key"] for r in found.collect()] == ["77777"]


def test_grams_are_cut_without_a_lambda(spark):
    """A row for each place, folded; nothing for a null or empty text; no function that runs uncompiled."""
    df = _grams(spark.createDataFrame([("1", "AbaB"), ("2", ""), ("3", None)], "key string, text string"))
    assert sorted(map(tuple, df.collect())) == [("1", "ab"), ("1", "aba"), ("1", "b"), ("1", "bab")]
    assert "lambda" not in df._jdf.queryExecution().executedPlan().toString()


def test_products_and_foods_through_an_index(spark, tmp_path):
    off = spark.createDataFrame([("1", "Oat milk", "Acme"), ("2", None, "oaty"), ("3", "Rye", "x")], "barcode string, product_name string, brands string")
    search.index_products(off, str(tmp_path / "off"))
    page = search.search_products(read_candidates(spark, str(tmp_path / "off"), "barcode", "OAT"), "OAT", 1)
    assert [r["barcode"] for r in page.rows.collect()] == ["1"] and page.info.first()["total"] == 2
