from __future__ import annotations

import random
import re
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from pantryline.operators.containment import _anchors, _postings, first_containing
from pantryline.operators.dedup import first_wins, last_wins, one_per_key
from pantryline.operators.groups import attach_lists, nested_list, numbered_children, with_children
from pantryline.operators.integrity import missing_keys, null_keys, orphans
from pantryline.operators import paging
from pantryline.operators.paging import number_rows, numbered_page, page_after, page_of, read_page, store_pages
from pantryline.operators.skew import SHARE, hot_groups, join_parent


def test_first_wins_ignores_input_order(spark):
    rows = [("a", 2, "late"), ("a", 1, None), ("b", 5, "only"), ("a", 3, "later")]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "k string, at int, text string").repartition(4)
        assert sorted(map(tuple, first_wins(df, ["k"], F.col("at"), ["text"]).collect())) == [
            ("a", None), ("b", "only"),
        ]
        assert sorted(map(tuple, last_wins(df, ["k"], F.col("at"), ["text"]).collect())) == [
            ("a", "later"), ("b", "only"),
        ]


def test_one_per_key_is_deterministic(spark):
    rows = [("a", "y", 1), ("a", "x", 9), ("b", None, 1)]
    df = spark.createDataFrame(rows * 3, "k string, n string, v int").repartition(5)
    assert sorted(map(tuple, one_per_key(df, "k").collect())) == [("a", "x", 9), ("b", None, 1)]


def skewed(spark):
    """One parent holds a third of all children."""
    rows = [("hot", f"c{i:05d}") for i in range(3000)]
    rows += [(f"p{i % 700}", f"c{i:05d}") for i in range(6000)]
    return spark.createDataFrame(rows, "p string, c string"), rows


def test_children_of_a_hot_parent_keep_their_order(spark):
    df, rows = skewed(spark)
    got = numbered_children(df.repartition(7), "p", "c", "n").collect()
    want = {}
    for p, c in sorted(rows):
        want.setdefault(p, []).append(c)
    assert len(got) == len(rows)
    for r in got:
        assert want[r["p"]][r["position"] - 1] == r["c"] and r["n"] == len(want[r["p"]])


def test_childless_parents_have_one_row(spark):
    parents = spark.createDataFrame([("hot", 1), ("none", 2)], "p string, x int")
    df, _ = skewed(spark)
    got = with_children(parents, numbered_children(df, "p", "c", "n"), "p", "n")
    assert got.filter("p = 'hot'").count() == 3000
    assert [tuple(r) for r in got.filter("p = 'none'").collect()] == [("none", 2, None, None, 0)]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_parent_equals_a_plain_join(spark, how):
    df, _ = skewed(spark)
    rows = df.unionByName(spark.createDataFrame([(None, f"n{i}") for i in range(50)] + [("absent", "z")], "p string, c string"))
    parents = df.select("p").distinct().filter("p <> 'p5'").withColumn("x", F.length("p"))
    if how in ("left_semi", "left_anti"):
        parents = parents.select("p")
    got = join_parent(rows, parents, "p", how)
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(parents, "p", how).collect()))
    assert join_parent(rows.limit(0), parents, "p", how).count() == 0


def test_hot_keys_are_few_and_have_their_share_of_groups(spark):
    df, _ = skewed(spark)
    assert list(hot_groups(df, "p").values()) == [86]  # a third of all rows
    assert hot_groups(df.limit(0), "p") == {} and hot_groups(df.withColumn("p", F.lit(None)), "p") == {}
    many = spark.range(60_000).withColumn("k", F.array(F.col("id") % 150))
    assert len(hot_groups(many, "k")) == 150 < SHARE
    # Among more keys than a sketch has counters, one in a hundred rows is found still.
    rare = spark.range(300_000).withColumn("k", F.when(F.col("id") % 100 == 0, "hot").otherwise(F.col("id").cast("string")))
    assert list(hot_groups(rare, "k").values()) == [3]


@contextmanager
def plain_shuffles(spark, partitions):
    """Nothing broadcast, nothing planned anew, so many partitions."""
    plain = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false",
        "spark.sql.shuffle.partitions": str(partitions),
    }
    before = {k: spark.conf.get(k) for k in plain}
    try:
        for k, v in plain.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("equal", [True, False])
def test_half_of_all_rows_on_one_key_are_dealt_to_many_tasks(spark, equal):
    """Rows that differ make up to 128 groups; of equal ones each of the 64 partitions makes one."""
    half = F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string"))
    rows = spark.range(0, 40_000, 1, 64).select(half.alias("p"), F.lit("same") if equal else "id")
    parents = rows.select("p").distinct().withColumn("x", F.lit(1))
    with plain_shuffles(spark, 200):
        joined = join_parent(rows, parents, "p", "inner").filter("p = 'hot'")
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 20_000 and len(sizes) > 32 and max(sizes) < 20_000 / 8


def test_join_parent_takes_maps_and_dotted_names(spark):
    rows = spark.sql("""select id % 3 p, map('a', id) m, array(map('b', id)) n, struct(map(1, id) x) o, id `d.e`
                        from range(60)""")
    parents = spark.range(2).withColumnRenamed("id", "p").withColumn("x", F.lit("y"))
    assert join_parent(rows, parents, "p").count() == 60
    assert join_parent(rows, parents, "p", "inner").agg(F.sum("`d.e`")).first()[0] == sum(i for i in range(60) if i % 3 < 2)


def test_parent_without_children_gets_empty_list(spark):
    parents = spark.createDataFrame([("a",), ("b",)], "p string")
    children = spark.createDataFrame([("a", "2"), ("a", "1")], "p string, c string")
    got = attach_lists(parents, nested_list(children, "p", ["c"], "items"), "p", "items")
    assert {r["p"]: [x["c"] for x in r["items"]] for r in got.collect()} == {"a": ["1", "2"], "b": []}


def test_integrity(spark):
    parent = spark.createDataFrame([("a",), ("b",)], "k string")
    child = spark.createDataFrame([(1, "a"), (2, "x"), (3, None), (4, "x")], "i int, ref string")
    assert sorted(r["i"] for r in orphans(child, parent, "ref", "k").collect()) == [2, 4]
    assert [r["i"] for r in null_keys(child, ["ref"]).collect()] == [3]
    wanted = spark.createDataFrame([("a",), ("z",), ("z",)], "k string")
    assert [r["k"] for r in missing_keys(wanted, parent, "k").collect()] == ["z"]


@pytest.mark.parametrize("size", [1, 7, 20, 100])
def test_pages_cover_the_list(spark, size):
    codes = [str(i) for i in range(40)]
    df = spark.createDataFrame([(c,) for c in codes], "code string").repartition(3)
    seen, page = [], 1
    while page:
        p = page_of(df, "code", page, size)
        info = p.info.first()
        assert info["count"] == 40
        assert info["previous"] == (page - 1 if page > 1 else None)
        seen += [r["code"] for r in p.rows.collect()]
        page = info["next"]
        if size == 1 and len(seen) >= 3:
            break
    assert seen == sorted(codes)[: len(seen)]
    assert size == 1 or len(seen) == 40


def test_page_past_the_end_and_keyset(spark):
    df = spark.createDataFrame([(str(i),) for i in range(40)], "code string")
    p = page_of(df, "code", 9, 20)
    assert p.rows.count() == 0
    assert tuple(p.info.first()) == (40, None, 8)
    whole, last = [], None
    while True:
        rows = [r["code"] for r in page_after(df, "code", last, 20).collect()]
        if not rows:
            break
        whole, last = whole + rows, rows[-1]
    assert whole == sorted(str(i) for i in range(40))
    for page, size in [(0, 20), (1, 0), (1, 101)]:
        with pytest.raises(ValueError):
            page_of(df, "code", page, size)


def brute_first(labels, texts):
    fold = lambda s: re.sub("[A-Z]", lambda m: m.group().lower(), s)
    out = {}
    for label in labels:
        pattern = "".join({"%": ".*", "_": "."}.get(c) or re.escape(c) for c in fold(label))
        hits = [c for c, t in texts if t is not None and re.search(pattern, fold(t), re.S)]
        if hits:
            out[label] = min(hits)
    return out


def test_first_containing_matches_brute_force(spark):
    texts = [
        ("10", "Fresh Milk"), ("2", "milk chocolate"), ("3", "100% Fruit Juice"), ("4", ""), ("5", None),
        ("6", "a_b c"), ("7", "back\\slash"), ("8", "É clair"), ("9", "aab"), ("1", "x"), ("30", "10 juice%s"),
    ]
    labels = [
        "milk", "MILK", "juice", "100% fruit", "1%j", "", "%", "_", "__", "a_b", "a__", "_l_", "é", "É", "\\",
        "k\\s", "zzz", "%%x", "x_", "fresh milk and more", "k%", "e", "________________", "_%_",
    ]
    rng = random.Random(5)
    alphabet = "abcAB _%\\"
    texts += [(str(100 + i), "".join(rng.choices(alphabet[:7], k=rng.randint(0, 8)))) for i in range(150)]
    labels += ["".join(rng.choices(alphabet, k=rng.randint(0, 5))) for _ in range(200)]
    t = spark.createDataFrame(texts, "code string, text string").repartition(4)
    lab = spark.createDataFrame([(x,) for x in labels] + [(None,)], "label string").repartition(3)
    rows = first_containing(lab, t).collect()
    got = {r["label"]: r["code"] for r in rows}
    assert len(rows) == len(got)
    assert got == brute_first(set(labels), texts)


def test_first_containing_without_wildcards_or_texts(spark):
    lab = spark.createDataFrame([("a",), ("b",)], "label string")
    t = spark.createDataFrame([("1", "xa"), ("0", "za")], "code string, text string")
    assert [tuple(r) for r in first_containing(lab, t).collect()] == [("a", "0")]
    assert first_containing(lab, t.limit(0)).count() == 0
    assert first_containing(lab.limit(0), t).count() == 0


def test_first_containing_in_long_texts(spark):
    """Texts of 10,000 characters, an anchor that all of them have, and nothing broadcast."""
    rng = random.Random(8)
    texts = [(f"{i:03}", "".join(rng.choices("abcdefgh o", k=10_000))) for i in range(30)]
    texts.append(("900", "a plain needle in it"))
    labels = ["o", "o%", "%o_a%", "needle", "o%zzz", "_" * 9_999, "_" * 10_001, "%", "need__"]
    t = spark.createDataFrame(texts, "code string, text string").repartition(4)
    lab = spark.createDataFrame([(x,) for x in labels], "label string")
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for name in names:
        spark.conf.set(name, "-1")
    try:
        got = {r["label"]: r["code"] for r in first_containing(lab, t).collect()}
    finally:
        for name in names:
            spark.conf.unset(name)
    assert got == brute_first(labels, texts)


def test_short_labels_and_every_length(spark):
    """Labels shorter than a gram, of its length and longer, and pieces of such lengths between wildcards."""
    rng = random.Random(11)
    texts = [(f"{i:03}", "".join(rng.choices("abcAB ü", k=rng.randint(0, 14)))) for i in range(300)]
    plain = ["".join(rng.choices("abc ü", k=k)) for k in range(1, 9) for _ in range(25)]
    wild = ["".join(rng.choices("abü%_", k=k)) for k in range(2, 8) for _ in range(25)]
    t = spark.createDataFrame(texts, "code string, text string")
    got = {r["label"]: r["code"] for r in first_containing(spark.createDataFrame([(x,) for x in plain + wild], "label string"), t).collect()}
    assert got == brute_first({*plain, *wild}, texts)


def test_postings_follow_the_texts_not_the_labels(spark):
    """A posting a character, whatever the number and lengths of labels."""
    texts = spark.range(50).select(F.col("id").cast("string").alias("code"), F.repeat(F.lit("some words "), 20).alias("text"))
    assert _postings(texts, spark.createDataFrame([(3,)], "n int")).count() == 50 * (220 - 2)
    anchors = _anchors(
        spark.createDataFrame([("zebra words", "zebra words", 11), ("qqq", "qqq", 3)], "folded string, piece string, n int"),
        spark.createDataFrame([(g, 1 if g == "ra " else 9) for g in ("zeb", "ebr", "bra", "ra ", "a w", " wo", "wor", "ord", "rds")], "gram string, n_postings long"),
    )
    assert [tuple(r)[0::3] for r in anchors.select("folded", "n", "gram", "offset").collect()] == [("zebra words", 4)]


def test_a_gram_of_nearly_all_texts_is_spread(spark):
    texts = spark.range(0, 20_000, 1, 32).select(
        F.format_string("%06d", "id").alias("code"), F.concat(F.lit("aab"), F.col("id").cast("string")).alias("text")
    )
    labels = spark.createDataFrame([("aab19999",), ("a%b1234",), ("aab",), ("aab9_9",)], "label string")
    with plain_shuffles(spark, 64):
        got = {r["label"]: r["code"] for r in first_containing(labels, texts).collect()}
    assert got == {"aab19999": "019999", "a%b1234": "001234", "aab": "000000", "aab9_9": "000909"}


@pytest.mark.parametrize("partitions", [1, 5])
def test_number_rows(spark, partitions):
    codes = [str(i) for i in range(500)]
    df = spark.createDataFrame([(c,) for c in codes], "code string").repartition(partitions)
    got = {r["code"]: r["position"] for r in number_rows(df, "code").collect()}
    assert got == {c: i for i, c in enumerate(sorted(codes), 1)}
    assert number_rows(df.limit(0), "code").count() == 0


def test_every_way_to_a_page_gives_the_same(spark):
    codes = sorted(str(i) for i in range(300))
    df = spark.createDataFrame([(c,) for c in codes], "code string").repartition(3)
    for page in (1, 7, 15, 16):
        want = codes[(page - 1) * 20 : page * 20]
        for way in (page_of, numbered_page):
            got = way(df, "code", page, 20)
            assert [r[0] for r in got.rows.collect()] == want
            assert got.info.first()["count"] == 300


def test_a_page_far_down_is_read_from_ranges(spark, monkeypatch):
    df = spark.range(5000).select(F.format_string("%05d", "id").alias("code"), F.create_map("id", "id").alias("m"))
    monkeypatch.setattr(paging, "TOP_ROWS", 1000)
    p = page_of(df, "code", 41, 100)
    assert [r["code"] for r in p.rows.collect()] == [f"{i:05}" for i in range(4000, 4100)]
    assert tuple(p.info.first()) == (5000, 42, 40)


def test_a_stored_page_opens_its_ranges_only(spark, tmp_path):
    """The last page costs what the first does: at most two of fifty ranges."""
    path = str(tmp_path / "pages")
    store_pages(spark.range(5000).select(F.format_string("%05d", "id").alias("code"), "id"), "code", path, range_rows=100)
    for page, size in ((1, 100), (2, 70), (50, 100), (167, 30), (5000, 1), (51, 100)):
        p = read_page(spark, path, page, size)
        assert [r["id"] for r in p.rows.collect()] == list(range(5000))[(page - 1) * size : page * size]
        assert tuple(p.info.first()) == (5000, page + 1 if page * size < 5000 else None, page - 1 or None)
    folders = {f.name: f for f in (tmp_path / "pages" / "rows").iterdir() if f.is_dir()}
    assert len(folders) > 40
    keep = read_page(spark, path, 25, 100).rows.first()["id"]
    # Without the files of other ranges the page is still there.
    for f in folders.values():
        ids = [r["id"] for r in spark.read.parquet(str(f)).collect()]
        if max(ids) < keep - 100 or min(ids) > keep + 200:
            for part in f.iterdir():
                part.unlink()
    assert [r["id"] for r in read_page(spark, path, 25, 100).rows.collect()] == list(range(2400, 2500))


def test_short_ranges_are_small_files_of_few_tasks(spark, tmp_path, monkeypatch):
    """Fifty ranges of 100 rows: a few kilobytes each, written by five tasks, and exactly 100 rows in most."""
    monkeypatch.setattr(paging, "TASK_ROWS", 1000)
    path = tmp_path / "pages"
    store_pages(spark.range(5000).select(F.format_string("%05d", "id").alias("code")), "code", str(path), range_rows=100)
    files = list((path / "rows").glob("*/*.parquet"))
    assert len(files) >= 50 and max(f.stat().st_size for f in files) < 20_000
    assert len({f.name.split("-")[1] for f in files}) <= 5
    sizes = [r["n"] for r in spark.read.parquet(str(path / "directory")).collect()]
    assert sum(sizes) == 5000 and max(sizes) == 100 and sizes.count(100) >= 45
    assert [r[0] for r in read_page(spark, str(path), 9, 90).rows.collect()] == [f"{i:05}" for i in range(720, 810)]


def test_a_page_is_one_pass(spark):
    """The rows and their number come from one scan, counted by the rows that it lets through."""
    passed = spark.sparkContext.accumulator(0)
    count = F.udf(lambda x: passed.add(1) or x)
    df = spark.range(0, 500, 1, 4).select(count("id").alias("code"))
    assert page_of(df, "code", 2, 20).flat().count() == 20
    assert passed.value == 500


def test_an_empty_page_has_its_envelope(spark):
    df = spark.createDataFrame([(str(i),) for i in range(40)], "code string")
    for way in (page_of, numbered_page):
        assert [tuple(r) for r in way(df, "code", 9, 20).flat().collect()] == [(None, 40, None, 8)]
        assert [tuple(r) for r in way(df.limit(0), "code", 1, 20).flat().collect()] == [(None, 0, None, None)]
        assert len(way(df, "code", 2, 20).flat().collect()) == 20


def test_numbering_by_several_columns_and_few_ranges(spark):
    df, rows = skewed(spark)
    got = {(r["p"], r["c"]): r["position"] for r in number_rows(df, ["p", "c"], ranges=2).collect()}
    assert got == {row: i for i, row in enumerate(sorted(rows), 1)}
