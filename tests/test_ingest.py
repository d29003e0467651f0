from __future__ import annotations

import gzip
import os
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from pantryline.plans import ingest
from pantryline.plans.taxonomy import PUSHED, Taxonomy, _only, brick_detail
from pantryline.schemas import TAXONOMY_TABLES
from pantryline.sources import metadata, tables, taxonomy_xml
from pantryline.sources.taxonomy_xml import read_document_date, read_segments, spread_families, write_segments

XML = os.path.join(os.path.dirname(__file__), "data", "en-v20251127.xml")

SEGMENTS = {("50000000", "Food/Beverage")}
FAMILIES = {
    ("50100000", "Fruit & Nuts", "50000000"), ("50200000", "", "50000000"), ("50300000", "Empty family", "50000000"),
}
CLASSES = {
    ("50101500", "Fresh Fruit", "50100000"), ("50101600", None, "50100000"), ("50202200", "Drinks", "50200000"),
}
BRICKS = {
    ("10000001", "Apples", "50101500"), ("10000002", "Pears", "50101500"), ("10000003", "Plums", "50101500"),
    ("10000004", "Juice", "50202200"),
}
TYPES = {("20000001", "Type of Apple"), ("20000002", "If Organic"), ("20000003", "No values")}
VALUES = {
    ("30000001", "Green"), ("30000002", "Red"), ("30000003", "Yes"), ("30000004", "No"), ("30000005", "Blue"),
}
BRICK_TYPES = {
    ("10000001", "20000001"), ("10000001", "20000002"), ("10000002", "20000002"), ("10000002", "20000003"),
    ("10000004", "20000001"),
}
TYPE_VALUES = {
    ("20000001", "30000001"), ("20000001", "30000002"), ("20000001", "30000005"), ("20000002", "30000003"),
    ("20000002", "30000004"),
}
GOLDEN = dict(zip(TAXONOMY_TABLES, [SEGMENTS, FAMILIES, CLASSES, BRICKS, TYPES, VALUES, BRICK_TYPES, TYPE_VALUES]))
# (occurrences, unique rows)
COUNTS = {
    "segments": (2, 1), "families": (4, 3), "classes": (4, 3), "bricks": (5, 4), "attribute_types": (5, 3),
    "attribute_values": (7, 5), "brick_attribute_types": (5, 5), "attribute_type_values": (7, 5),
    "total": (39, 29),
}


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def published(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("catalogue"))
    counts = ingest.ingest_taxonomy(spark, XML, out, "20251127")
    return out, {r["table_name"]: (r["occurrences"], r["unique_rows"]) for r in counts.collect()}


@pytest.mark.parametrize("table", TAXONOMY_TABLES)
def test_tables(spark, published, table):
    got = rows(Taxonomy.read(spark, published[0]).tables()[table])
    assert len(got) == len(set(got))
    assert set(got) == GOLDEN[table]


def test_counts(published):
    assert published[1] == COUNTS


def test_metadata(spark, published):
    stored = tables.read_table(spark, published[0], "gpc_metadata")
    got = dict(rows(stored))
    assert datetime.fromisoformat(got.pop("import_timestamp")).tzinfo == timezone.utc
    assert got == {
        "xml_date": "2/12/2024", "xml_source": XML, "food_segments": "50000000", "gpc_version": "20251127",
    }
    assert metadata.value_of(stored, "gpc_version") == "20251127"
    assert metadata.value_of(stored, "last_version_check") is None


def test_unspread_documents_give_the_same(spark):
    docs = ingest.keep_segments(read_segments(spark, XML))
    for variant in (docs, spread_families(docs)):
        seen = ingest.visits(variant)
        assert {n: set(rows(df)) for n, df in ingest.tables_of(seen).items()} == GOLDEN
        got = {r["table_name"]: (r["occurrences"], r["unique_rows"]) for r in ingest.import_counts(seen).collect()}
        assert got == COUNTS


def test_visits_of_some_levels(spark):
    docs = ingest.keep_segments(read_segments(spark, XML))
    whole = ingest.visits(docs).select("table_name", "parent_code", "code", "text")
    for levels in (("segments",), ("families", "bricks"), ("attribute_types",)):
        part = ingest.visits(docs, levels).drop("ord")
        want = rows(whole.filter(F.col("table_name").isin(list(levels))))
        assert sorted(map(str, rows(part))) == sorted(map(str, want))


def test_no_segment_kept(spark, tmp_path):
    counts = ingest.ingest_taxonomy(spark, XML, str(tmp_path), "1", segments=("99",))
    assert {tuple(r) for r in counts.collect()} == {(n, 0, 0) for n in [*TAXONOMY_TABLES, "total"]}
    assert Taxonomy.read(spark, str(tmp_path)).bricks.count() == 0


def test_root_date(spark, tmp_path):
    assert rows(read_document_date(spark, XML).select("xml_date")) == [("2/12/2024",)]
    other = tmp_path / "none.xml"
    other.write_text('<?xml version="1.0"?>\n<root><segment dateUtc="1/1/2020" code="1"/></root>')
    assert rows(read_document_date(spark, str(other)).select("xml_date")) == [("unknown",)]


def test_malformed_file_is_an_error(spark, tmp_path):
    bad = tmp_path / "bad.xml"
    bad.write_text('<schema><segment code="50000000"><family code="1"></segment></schema>')
    with pytest.raises(Exception):
        ingest.visits(read_segments(spark, str(bad))).collect()


NULLS = """<schema><segment code="50000000" text="s">
  <family code="f1" text="ok"><class text="no code"><brick code="b1" text="lost"/></class>
    <class code="c1" text="kept"><brick code="b2" text="kept"><attType text="no code"><attValue code="v1"/></attType></brick></class>
  </family></segment></schema>"""


def test_null_keys_are_set_aside(spark, tmp_path):
    path = tmp_path / "nulls.xml"
    path.write_text(NULLS)
    out = str(tmp_path / "out")
    ingest.ingest_taxonomy(spark, str(path), out, "1", on_violation="quarantine")
    t = Taxonomy.read(spark, out)
    assert rows(t.classes) == [("c1", "kept", "f1")]
    assert rows(t.bricks) == [("b2", "kept", "c1")]
    got = sorted(rows(ingest.read_rejects(spark, out, "1")))
    assert got == [
        ("attribute_type_values", "null", "|v1"), ("attribute_types", "null", ""), ("brick_attribute_types", "null", "b2|"),
        ("bricks", "null", "b1"), ("classes", "null", ""),
    ]


def test_broken_reference(spark, tmp_path):
    t = {name: spark.createDataFrame([], ",".join(f"{c} string" for c in spec[0])) for name, spec in TAXONOMY_TABLES.items()}
    t["segments"] = spark.createDataFrame([("s", "S")], t["segments"].schema)
    t["families"] = spark.createDataFrame([("f", "F", "s"), ("g", "G", "absent")], t["families"].schema)
    t["classes"] = spark.createDataFrame([("c", "C", "f"), ("d", "D", "g")], t["classes"].schema)
    checked = ingest.check_tables(t)
    assert rows(checked.tables["families"]) == [("f", "F", "s")]
    assert rows(checked.tables["classes"]) == [("c", "C", "f")]
    assert sorted(rows(checked.rejects)) == [
        ("classes", "orphan family_code", "d"), ("families", "orphan segment_code", "g"),
    ]


# The family has no code, so its class has no parent and is set aside, and the brick is left
# with a reference to an absent class.
ORPHANS = """<schema><segment code="50000000"><family><class code="c1"><brick code="b1"/></class></family></segment></schema>"""


def test_fail_on_broken_reference(spark, tmp_path):
    path = tmp_path / "orphans.xml"
    path.write_text(ORPHANS)
    with pytest.raises(ValueError, match="orphan class_code"):
        ingest.ingest_taxonomy(spark, str(path), str(tmp_path / "out"), "1")
    assert tables.current_version(spark, str(tmp_path / "out")) is None
    ingest.ingest_taxonomy(spark, str(path), str(tmp_path / "out"), "1", on_violation="quarantine")
    assert tables.current_version(spark, str(tmp_path / "out")) == "1"


def test_refresh_replaces_the_current_version(spark, tmp_path):
    out = str(tmp_path)
    assert tables.current_version(spark, out) is None
    ingest.ingest_taxonomy(spark, XML, out, "1")
    ingest.ingest_taxonomy(spark, XML, out, "2", segments=("60000000",))
    assert tables.current_version(spark, out) == "2"
    assert rows(Taxonomy.read(spark, out).bricks) == [("10000009", "Yarn", "60101500")]
    assert Taxonomy.read(spark, out, "1").bricks.count() == 4


FIRST_UNSOUND = """<schema><segment code="50000000" text="s"><family code="f1" text="f">
  <class text="no code"><brick code="b1" text="without a class"/><brick code="b1" text="again"/></class>
  <class code="c1" text="kept"><brick code="b1" text="sound"/><brick code="b1" text="late"/></class></family></segment></schema>"""


def test_a_later_sound_visit_wins(spark, tmp_path):
    path, out = tmp_path / "first.xml", str(tmp_path / "out")
    path.write_text(FIRST_UNSOUND)
    ingest.ingest_taxonomy(spark, str(path), out, "1")
    assert rows(Taxonomy.read(spark, out).bricks) == [("b1", "sound", "c1")]
    assert rows(tables.read_table(spark, out, "skipped_visits")) == [("bricks", "b1", 2)]


def test_a_failed_import_leaves_the_published_version(spark, tmp_path):
    path, out = tmp_path / "broken.xml", str(tmp_path / "out")
    path.write_text(ORPHANS)
    ingest.ingest_taxonomy(spark, XML, out, "1")
    held = Taxonomy.read(spark, out, "1").bricks
    with pytest.raises(ValueError):
        ingest.ingest_taxonomy(spark, str(path), out, "1")
    assert tables.current_version(spark, out) == "1"
    assert set(rows(held)) == set(rows(Taxonomy.read(spark, out).bricks)) == BRICKS
    # A new import of the same version replaces it for new readers only.
    ingest.ingest_taxonomy(spark, XML, out, "1", segments=("60000000",))
    assert set(rows(held)) == BRICKS
    assert rows(Taxonomy.read(spark, out, "1").bricks) == [("10000009", "Yarn", "60101500")]
    with pytest.raises(FileNotFoundError):
        tables.folder_of(spark, out, "9")


def test_interleaved_imports_both_publish_in_an_order(spark, tmp_path, monkeypatch):
    """The second takes the number that the first had read as free."""
    root = str(tmp_path)
    real, raced = tables._log_files, []

    def slow(*args):
        found = real(*args)
        if not raced:
            raced.append(True)
            tables.publish(spark, root, "b", "folder-b")  # ends in between
        return found

    monkeypatch.setattr(tables, "_log_files", slow)
    assert tables.publish(spark, root, "a", "folder-a") == 2
    monkeypatch.undo()
    assert tables.current_version(spark, root) == "a"
    assert tables.folder_of(spark, root, "b") == "folder-b"
    assert [e["seq"] for e in tables._entries(spark, root)] == [2, 1]
    assert tables.publish(spark, root, "b", "folder-c") == 3
    assert tables.folder_of(spark, root) == tables.folder_of(spark, root, "b") == "folder-c"


def test_leftovers_of_failed_imports_can_go(spark, tmp_path):
    out = str(tmp_path / "out")
    ingest.ingest_taxonomy(spark, XML, out, "1")
    (tmp_path / "broken.xml").write_text(ORPHANS)
    with pytest.raises(ValueError):
        ingest.ingest_taxonomy(spark, str(tmp_path / "broken.xml"), out, "2")
    assert tables.unpublished(spark, out) == []  # too young
    left = tables.remove_unpublished(spark, out, older_than_hours=0)
    assert len(left) == 1 and left[0].startswith("2-")
    assert tables.unpublished(spark, out, 0) == []
    assert set(rows(Taxonomy.read(spark, out).bricks)) == BRICKS


def test_dates_behind_comments_and_codecs(spark, tmp_path):
    head = """<?xml version="1.0"?><!DOCTYPE schema [<!ENTITY x "y>">]>
<!-- <schema dateUtc="1/1/1999"> --><!-- a > b -->"""
    texts = {
        "a.xml": head + """<schema note="dateUtc='0'" dateUtc='2/12/2024'><segment/></schema>""",
        "b.xml.gz": head + '<schema dateUtc="3/1/2024"/>',
        "c.xml": "<!--" + "x>" * 20_000 + '--><s dateUtc="it\'s"/>',
        "d.xml": "<!-- never ends <schema dateUtc='1/1/1999'>",
        "e.xml": "<schema><segment dateUtc='1/1/1999'/></schema>",
        "f.xml": "",
    }
    for name, text in texts.items():
        data = text.encode()
        (tmp_path / name).write_bytes(gzip.compress(data) if name.endswith("gz") else data)
    got = {r[0].rsplit("/", 1)[1]: r[1] for r in read_document_date(spark, str(tmp_path)).collect()}
    assert got == {
        "a.xml": "2/12/2024", "b.xml.gz": "3/1/2024", "c.xml": "it's", "d.xml": "unknown", "e.xml": "unknown", "f.xml": "unknown",
    }


def test_dates_of_many_files(spark, tmp_path):
    for i in range(1000):
        (tmp_path / f"{i:04}.xml").write_text(f'<!-- {i} --><schema dateUtc="{i}/1/2024"/>')
    got = dict(map(tuple, read_document_date(spark, str(tmp_path)).collect()))
    assert {k.rsplit("/", 1)[1]: v for k, v in got.items()} == {f"{i:04}.xml": f"{i}/1/2024" for i in range(1000)}


def rows_scanned(df):
    """Rows that the scans handed on, after row groups and pages were skipped."""
    df.collect()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif node.nodeName().startswith("Scan"):
            found += node.metrics().apply("numOutputRows").value()
        else:
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
            if node.nodeName().endswith("QueryStage"):
                todo.append(node.plan())
    return found


def test_a_lookup_by_code_skips_row_groups(spark, tmp_path, monkeypatch):
    """Five codes of 400,000 bricks read fewer than a tenth of the rows, an absent one none; long lists are whole."""
    n = 400_000
    bricks = spark.range(0, n, 1, 8).select(
        F.format_string("%08d", F.pmod(F.xxhash64("id"), F.lit(10**8))).alias("brick_code"),
        F.sha2(F.col("id").cast("string"), 256).alias("description"),
        F.format_string("c%07d", (F.col("id") * 7919) % 100_000).alias("class_code"),
        F.lit(None).cast("string").alias("reason"),
    )
    monkeypatch.setattr(tables, "ROW_GROUP", 128 << 10)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        tables.write_checked("bricks", bricks, str(tmp_path), "f")
        stored = tables.read_checked(spark, "bricks", str(tmp_path), folder="f").filter("ok").select("brick_code", "description", "class_code")
        empty = {name: spark.createDataFrame([], ", ".join(f"{c} string" for c in spec[0])) for name, spec in TAXONOMY_TABLES.items()}
        t = Taxonomy(**{**empty, "bricks": stored})
        codes = [r[0] for r in stored.select("brick_code").limit(5).collect()]
        found = _only(t.bricks, "brick_code", codes)
        assert found.count() >= 5 and rows_scanned(found) < n / 10
        assert rows_scanned(_only(t.bricks, "brick_code", ["00000000x"])) == 0
        many = [r[0] for r in stored.select("brick_code").sample(0.0002, 1).collect()]
        assert len(many) > 3 * PUSHED
        assert {r[0] for r in _only(t.bricks, "brick_code", [*many, None]).select("brick_code").collect()} == set(many)
        assert _only(t.bricks, "brick_code", []).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_metadata_upsert(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    new = spark.createDataFrame([("b", "1"), ("c", "3")], "key string, value string")
    assert sorted(rows(metadata.upsert(old, new))) == [("a", "1"), ("b", "1"), ("c", "3")]
    assert metadata.as_map(old).first()[0] == {"a": "1", "b": "2"}


def test_detail_of_ingested_brick(spark, published):
    row = brick_detail(Taxonomy.read(spark, published[0]), ["10000002"]).first()
    assert row["full_path"] == "Food/Beverage > Fruit & Nuts > Fresh Fruit > Pears"
    # Values hang off the type, so the pear shows every value its type has anywhere.
    assert [
        (a["att_type_code"], a["att_type_text"], [(v["att_value_code"], v["att_value_text"]) for v in a["values"]])
        for a in row["attributes"]
    ] == [
        ("20000002", "If Organic", [("30000003", "Yes"), ("30000004", "No")]),
        ("20000003", "No values", []),
    ]


def random_segments(rng, n):
    """Segments whose codes repeat, with other texts and parents, or are missing."""
    def node(tag, level, below):
        code = None if rng.random() < 0.15 else rng.randrange(20 * 3**level)
        attrs = "" if code is None else f' code="{level}{code}"'
        text = rng.choice(["", f' text="t{rng.randrange(3)}"'])
        inner = "".join(node(below[0], level + 1, below[1:]) for _ in range(rng.randrange(4))) if below else ""
        return f"<{tag}{attrs}{text}>{inner}</{tag}>"

    return "".join(node("segment", 0, ["family", "class", "brick", "attType", "attValue"]) for _ in range(n))


def test_summed_visits_give_what_visits_one_by_one_do(spark, tmp_path):
    """Files whose sizes rise and fall by name, in a folder whose name is encoded in paths."""
    rng, folder, out = random.Random(3), tmp_path / "a b%20c", str(tmp_path / "out")
    folder.mkdir()
    for i, size in enumerate([1, 40, 3, 25, 2, 60]):
        (folder / f"{i} %.xml").write_text(f"<schema>{random_segments(rng, size)}</schema>")
    seen = ingest.visits(read_segments(spark, str(folder))).cache()
    want = ingest.check_tables(ingest.tables_of(seen))
    orphans = want.rejects.filter("reason like 'orphan%'").select("table_name").distinct()
    assert {r[0] for r in orphans.collect()} == {"classes", "bricks", "brick_attribute_types"}
    counts = ingest.ingest_taxonomy(spark, str(folder), out, "1", segments=None, on_violation="quarantine")
    for name, got in Taxonomy.read(spark, out).tables().items():
        assert sorted(rows(got), key=str) == sorted(rows(want.tables[name]), key=str)
    assert sorted(rows(ingest.read_rejects(spark, out, "1"))) == sorted(rows(want.rejects))
    assert sorted(rows(counts)) == sorted(rows(ingest.import_counts(seen)))
    skipped = rows(tables.read_table(spark, out, "skipped_visits"))
    assert skipped and sorted(skipped) == sorted(rows(ingest.skipped_visits(ingest.first_visits(seen))))
    seen.unpersist()


def test_visits_are_hashed_where_they_are_read(spark):
    """One exchange, behind an aggregation; no visit is sorted or shuffled by itself."""
    text = ingest.summed_visits(read_segments(spark, XML))._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and text.count("HashAggregate") == 2
    assert "Sort" not in text
    assert "HashAggregate" in text[text.index("Exchange hashpartitioning"):]


def test_sound_documents_meet_no_table(spark, tmp_path, monkeypatch):
    """References are joined to what was rejected only; here that is nothing."""
    monkeypatch.setattr(ingest, "join_parent", None)
    ingest.ingest_taxonomy(spark, XML, str(tmp_path), "1")
    assert set(rows(Taxonomy.read(spark, str(tmp_path)).brick_attribute_types)) == BRICK_TYPES


def test_written_documents_have_no_indent(spark, tmp_path):
    docs = read_segments(spark, XML)
    write_segments(docs, str(tmp_path / "x"), "1/1/2025")
    text = "".join(p.read_text() for p in (tmp_path / "x").glob("part*"))
    assert "<family" in text and not any(line.startswith(" ") for line in text.splitlines())
    assert sorted(map(str, rows(read_segments(spark, str(tmp_path / "x")).select("_code", "_text", "family")))) == sorted(
        map(str, rows(docs.select("_code", "_text", "family")))
    )


def test_packed_documents_are_read_in_small_batches(spark, tmp_path, monkeypatch):
    """What is packed gives the same rows, file for file in one order, and is dealt out by its packed size."""
    rng, plain, packed = random.Random(5), tmp_path / "plain", tmp_path / "a b%20[c]"
    for folder in (plain, packed):
        folder.mkdir()
    for i, size in enumerate([1, 40, 3, 25, 2, 60]):
        text = f"<schema>{random_segments(rng, size)}</schema>".encode()
        (plain / f"{i}.xml").write_bytes(text)
        (packed / f"{i}.xml.gz").write_bytes(gzip.compress(text))
    columns = ["_code", "_text", "family"]
    in_order = lambda path: [tuple(r) for r in read_segments(spark, path).orderBy("ord").select(*columns).collect()]
    folder = str(packed).replace("[", "\\[").replace("]", "\\]")
    want = in_order(str(plain))
    assert len(want) == 131 and in_order(folder) == want
    monkeypatch.setattr(taxonomy_xml, "PACKED_BYTES", 1)
    assert in_order(folder) == want
    one_each = read_segments(spark, folder).select(F.spark_partition_id(), "ord.file").distinct().collect()
    assert len(one_each) == len({r[0] for r in one_each}) == 6


def test_documents_are_written_packed(spark, tmp_path):
    docs = read_segments(spark, XML)
    write_segments(docs, str(tmp_path / "x"), "1/1/2025", compression="gzip")
    assert {p.name.split(".", 1)[1] for p in (tmp_path / "x").glob("part*")} == {"xml.gz"}
    assert sorted(map(str, rows(read_segments(spark, str(tmp_path / "x")).select("_code", "_text", "family")))) == sorted(
        map(str, rows(docs.select("_code", "_text", "family")))
    )
    assert {r["xml_date"] for r in read_document_date(spark, str(tmp_path / "x")).collect()} == {"1/1/2025"}


def test_junctions_have_no_order(spark):
    """Only a level's visits need the place of the first; pairs of parent and child go without."""
    summed = ingest.summed_visits(read_segments(spark, XML))
    got = summed.groupBy((F.col("kind") < ingest.JUNCTIONS).alias("level")).agg(F.count("ord"), F.count(F.lit(1))).collect()
    assert {r[0]: r[1] == r[2] if r[0] else r[1] for r in got} == {True: True, False: 0}
