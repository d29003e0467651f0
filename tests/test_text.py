"""Text rules against plain Python on hand-picked and generated inputs."""

from __future__ import annotations

import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from pantryline.functions import text as tx


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_truthy(spark):
    assert column(spark, ["a", "", None, " "], tx.truthy) == ["a", None, None, " "]


@pytest.mark.parametrize(
    "parts, path",
    [
        (("a", "b", "c"), "a > b > c"),
        ((None, "b", "c"), "b > c"),
        (("", "b", None), "b"),
        ((None, None, ""), ""),
    ],
)
def test_breadcrumb(spark, parts, path):
    df = spark.createDataFrame([parts], "a string, b string, c string")
    cols = [F.col(c) for c in "abc"]
    row = df.select(tx.breadcrumb(*cols).alias("p"), tx.path_parts(*cols).alias("a")).first()
    assert row["p"] == path
    assert row["a"] == [p for p in parts if p]


# tag -> (label, title-cased label of a tag with a colon), written by hand
TAGS = {
    "en:plant-based-foods": ("plant based foods", "Plant Based Foods"),
    "plain-tag": ("plain-tag", "plain-tag"),
    "fr:x:two-colons": ("two colons", "Two Colons"),
    "en:": ("", ""),
    ":": ("", ""),
    "a:b:c-d-e": ("c d e", "C D E"),
    "": ("", ""),
    "en:o'brien-3rd": ("o'brien 3rd", "O'Brien 3Rd"),
}


def test_tag_label(spark):
    assert column(spark, list(TAGS), tx.tag_label) == [pair[0] for pair in TAGS.values()]


def test_fallback_label(spark):
    assert column(spark, list(TAGS), tx.fallback_label) == [pair[1] for pair in TAGS.values()]


TITLES = [
    "o'brien 3rd", "ß straße", "élan VITAL", "ΑΣ ΑΣΑ", "ﬁne ﬁ", "ǆemal", "a中b", "ⅷ ⓐb", "ŉa",
    "don't  stop\nnew-line\ttab", "nº5", "İstanbul I", "", "123", "x﷐ y z'q", "ᾳ x", "àb",
]


def test_title_case_examples(spark):
    assert column(spark, TITLES, tx.title_case) == [t.title() for t in TITLES]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aBzßéÉñÑ '-.,0159\n\tüÜ日ж", max_size=40), min_size=20, max_size=40))
def test_title_case_generated(spark, values):
    assert column(spark, values, tx.title_case) == [v.title() for v in values]


def sql_like(text: str | None, needle: str) -> bool | None:
    """LIKE '%needle%' folding ASCII case only, without an escape character."""
    if text is None:
        return None
    fold = lambda s: re.sub("[A-Z]", lambda m: m.group().lower(), s)
    pattern = "".join({"%": ".*", "_": "."}.get(c) or re.escape(c) for c in fold(needle))
    return re.search(pattern, fold(text), re.S) is not None


TEXTS = ["Fresh Milk", "100% juice", "a_b", "back\\slash", "É clair", "é clair", None, "", "new\nline", "x.y*z", "a\\Eb"]
NEEDLES = ["milk", "MILK", "0%", "_", "a_b", "\\", "é", "É", "h m", "w_l", ".", "*", "%", "r%m", "a\\E", "$", "k$"]


@pytest.mark.parametrize("needle", NEEDLES)
def test_contains_ascii(spark, needle):
    assert column(spark, TEXTS, lambda c: tx.contains(c, needle)) == [sql_like(t, needle) for t in TEXTS]


def test_contains_unicode(spark):
    got = column(spark, TEXTS, lambda c: tx.contains(c, "É", ascii_only=False))
    assert got[4] and got[5]
    assert column(spark, ["a\\b"], lambda c: tx.contains(c, "a\\b", ascii_only=False)) == [True]


def test_empty_search_keeps_all(spark):
    assert column(spark, TEXTS, lambda c: tx.any_contains([c], "")) == [True] * len(TEXTS)
    assert column(spark, TEXTS, lambda c: tx.any_contains([c], None)) == [True] * len(TEXTS)


def test_sorted_csv(spark):
    df = spark.range(1).select(tx.sorted_csv(F.array(F.lit("b"), F.lit("a"), F.lit("b"))).alias("v"))
    assert df.first()["v"] == "a,b"
