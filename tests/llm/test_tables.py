"""Shards, archives, neighbours and licenses against plain Python."""

from __future__ import annotations

import base64
import hashlib
import zlib
from difflib import SequenceMatcher

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pantryline.llm import licenses, neighbours, sharding, warc


def expected_shards(rows, n):
    sized = [(d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows]
    sized.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1]))
    total, run, out, slots = sum(r[1] for r in sized), 0, [], {}
    for d, size, crc in sized:
        shard = (2 * run + size) * n // (2 * total)
        out.append((d, size, crc, shard, slots.get(shard, 0)))
        slots[shard], run = slots.get(shard, 0) + 1, run + size
    return out


@pytest.mark.parametrize("ranges", [1, 5])
def test_shards(edge_docs, no_docs, ranges):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    got = [tuple(r) for r in sharding.assign_shards(edge_docs, 3, ranges).collect()]
    order = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(got, key=order) == sorted([(d, s, c, k, p) for d, s, c, k, p in expected_shards(rows, 3)], key=order)
    assert sharding.assign_shards(no_docs, 3).collect() == []


def test_shards_are_balanced_and_written_whole(spark, tmp_path):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    placed = sharding.assign_shards(docs, 10)
    sizes = [r.n for r in placed.groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(sizes) == 10 and max(sizes) - min(sizes) <= 2 * (50 + 16)
    sharding.write_shards(docs, str(tmp_path / "shards"), 10)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.select("document.*").orderBy("doc_id").collect() == docs.orderBy("doc_id").collect()


PAGES = [
    (1, "http://a", "x" * 100), (2, "http://b", "x" * 100), (3, None, None), (4, "http://c", ""), (5, "http://d", "é" * 9000),
    (5, "http://d", "é" * 9000), (6, "http://e", "é" * 9000), (None, "http://f", "x" * 100), (None, "http://g", "alone"),
    (7, "http://h\r\ni", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n0\r\n\r\n"), (8, "http://i", "y" * 200_000),
]


@pytest.mark.parametrize(("segment", "least"), [(1 << 14, 0), (70, 0), (1 << 14, 150)])
def test_archives_round_trip(spark, tmp_path, segment, least):
    pages = spark.createDataFrame([(*p, "kept") for p in PAGES], "page_id long, url string, html string, digest string")
    path = str(tmp_path / "warc")
    warc.write_warc(pages, path, least, segment, file_records=3)
    got = warc.read_warc(spark, path).collect()
    want = []
    for page_id, _, html in PAGES:
        payload = (html or "").encode()
        same = [p for p, _, h in PAGES if p is not None and (h or "").encode() == payload]
        first = min(same, default=None) if len(payload) >= least else page_id
        revisit = first is not None and page_id != first
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        want.append((page_id, len(payload), digest, "revisit" if revisit else "response", first if revisit else None, None if revisit else payload))
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted([(*r[:5], None if r[5] is None else bytes(r[5])) for r in got], key=order) == sorted(want, key=order)


def test_no_pages(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "warc"))
    assert warc.read_warc(spark, str(tmp_path / "warc")).collect() == []


@given(st.binary(max_size=300), st.integers(1, 50))
def test_chunked_framing(payload, size):
    assert warc.unchunked(warc.chunked(payload, size)) == payload


def test_broken_archives_are_told():
    with pytest.raises(ValueError, match="follow"):
        warc.reassemble([1, 3], [b"a", b"b"], 2)
    with pytest.raises(ValueError, match="bytes"):
        warc.reassemble([1, 2], [b"a", b"b"], 3)
    with pytest.raises(ValueError, match="digest"):
        warc.checked_payload(b"HTTP/1.1 200 OK\r\n\r\nbody", "A")
    with pytest.raises(ValueError, match="shorter"):
        warc.unchunked(b"3\r\nab\r\n0\r\n\r\n")
    with pytest.raises(ValueError, match="begins"):
        list(warc.parse(b"something else"))


def nearest(rows, query_id, query, k):
    scored = [(-float(np.dot(np.float32(v).astype(float), np.float32(query).astype(float))), i) for i, v in rows if i != query_id]
    return [i for _, i in sorted(scored)[:k]]


def test_all_are_found_where_there_are_few(spark):
    rows = [(i, [float(x) for x in np.random.default_rng(i).normal(size=6)]) for i in range(12)]
    odd = [
        (20, None), (40, [0.0] * 6), (60, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (80, [float("nan")] * 6), (100, [1.0, 2.0]),
        (120, [float("inf")] * 6), (None, [1.0] * 6), (140, []),
    ]
    vectors = spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id long, embedding array<float>, id int")
    got = neighbours.search(vectors, F.col("id") % 4 == 0, 20).orderBy("query_id", "rank").collect()
    for q in (0, 4, 8):
        own = [r for r in got if r.query_id == q]
        assert [r.id for r in own] == nearest(rows, q, rows[q][1], 20)
        assert [r["rank"] for r in own] == list(range(1, 12))
    assert {r.query_id for r in got} == {0, 4, 8}
    assert neighbours.search(vectors.limit(0), F.col("id") % 4 == 0).collect() == []


def test_doubles_are_searched_as_doubles(spark):
    """Scores on the original vectors, and none lost for being beyond single precision."""
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=8) * (1e39 if i == 7 else 1)).tolist()) for i in range(60)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(vectors, F.pmod(F.col("id"), F.lit(20)) == 0, 20).collect()
    own = dict(rows)
    assert {r.query_id for r in got} == {0, 20, 40} and any(r.id == 7 for r in got)
    assert all(r.score == sum(np.array(own[r.query_id]) * np.array(own[r.id])) or np.isclose(r.score, np.dot(own[r.query_id], own[r.id]), rtol=1e-14) for r in got)


def test_ties_and_repeated_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(30)] + [(0, [0.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.search(vectors, F.col("id") == 0, 5).orderBy("query_id", "score", "rank").collect()
    assert [r.id for r in got if r.score == 1.0] == [1, 2, 3, 4, 5]
    assert [r.id for r in got if r.score == 0.0] == [1, 2, 3, 4, 5]  # the second row with id 0


@pytest.mark.parametrize("scale", [0.0, 1.0])
def test_recall(spark, scale):
    """On clustered vectors, of equal and of different lengths."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 32))[rng.integers(0, 40, 4000)] + 0.6 * rng.normal(size=(4000, 32))
    x = x / np.linalg.norm(x, axis=1)[:, None] * (1 + scale * rng.random(4000))[:, None]
    rows = [(i, [float(v) for v in np.float32(r)]) for i, r in enumerate(x)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.search(vectors, F.col("id") % 50 == 0, 10).collect()
    found = 0
    for q in range(0, 4000, 50):
        found += len({r.id for r in got if r.query_id == q} & set(nearest(rows, q, rows[q][1], 10)))
    assert found / 800 >= 0.9


def test_index_finds_every_code_within_the_radius():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 1 << 63, 500, dtype=np.uint64) & np.uint64(0xFFFFF)
    index = neighbours.MultiIndex(np.arange(500), np.zeros((500, 1)), codes, 20, 3)
    for radius in (0, 2, 5, 9):
        want = np.nonzero(np.bitwise_count(codes ^ codes[7]) <= radius)[0]
        assert (index.within(codes[7], radius) == want).all()


SCANNER = licenses.Scanner(licenses.TEMPLATES, 0.8, licenses.NAMES)


def lcs(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
    return table[-1, -1]


@settings(max_examples=200)
@given(st.lists(st.integers(0, 30), max_size=30), st.lists(st.integers(0, 30), max_size=30))
def test_alignment_is_a_common_subsequence(a, b):
    found = licenses.align(a, b)
    assert all(a[i] == b[j] for i, j in found)
    assert all(p < q and s < t for (p, s), (q, t) in zip(found, found[1:]))
    assert len(found) <= lcs(a, b)


@given(st.lists(st.integers(0, 12), unique=True, max_size=12), st.lists(st.integers(0, 12), unique=True, max_size=12))
def test_alignment_of_unique_words_is_the_longest(a, b):
    assert len(licenses.align(a, b)) == lcs(a, b)


@pytest.mark.parametrize("name", list(licenses.TEMPLATES))
def test_edited_templates_are_found_in_long_texts(name):
    words = licenses.TEMPLATES[name].split()
    edited = [w for i, w in enumerate(words) if i != len(words) // 2 or len(words) < 10]
    filler = " ".join(f"the word {i} of this" for i in range(5000))
    text = f"{filler} {' '.join(edited)} {filler}\n{' '.join(words).upper()}"
    hits = [h for h in SCANNER.scan(text) if h["template"] == name]
    assert len(hits) == 2 and hits[1]["coverage"] == 1.0
    got = licenses.WORD.findall(text[hits[0]["start"] : hits[0]["stop"]].lower())
    want = licenses.WORD.findall(" ".join(edited).lower())
    assert SequenceMatcher(None, got, want, autojunk=False).ratio() > 0.9


def test_other_texts_have_no_license():
    assert SCANNER.scan("The license of the poet is to use words without restriction of any kind.") == []
    assert SCANNER.scan(licenses.TEMPLATES["MIT"][: len(licenses.TEMPLATES["MIT"]) // 2]) == []


def test_scanning_documents(spark, edge_docs, no_docs):
    rows = licenses.scan_licenses(edge_docs).collect()
    assert len(rows) == edge_docs.count() and all(r.hits == [] for r in rows)
    assert licenses.scan_licenses(no_docs).collect() == []
    text = "x " + licenses.TEMPLATES["MIT-notice"] + " y " + licenses.TEMPLATES["MIT-notice"]
    hits = licenses.scan_licenses(spark.createDataFrame([(None, text)], "doc_id long, text string")).first().hits
    assert [text[h.start : h.stop] for h in hits] == ["Released under the MIT License"] * 2


def found_in(text):
    return [(h["template"], h["matched"]) for h in SCANNER.scan(text)]


def test_repeated_phrases_and_broken_runs_hide_no_license():
    gpl = licenses.TEMPLATES["GPL-3.0"]
    repeated = gpl.replace("Public License as", "Public License (the GNU General Public License, GPL) as")
    assert found_in(repeated) == [("GPL-3.0", 80)]
    assert found_in(f"{repeated} and once more: {repeated}") == [("GPL-3.0", 80)] * 2
    words = gpl.split()
    broken = " ".join(w if i % 2 else f"{w} x{i}" for i, w in enumerate(words))
    assert found_in(f"some text {broken} some text") == [("GPL-3.0", 80)]
    assert found_in("Released under MIT License") == [("MIT-notice", 4)]


NOTICES = {
    "Released under the GPL License.": [],
    "Released under the Apache License.": [],
    "Released under the BSD License.": [],
    "Released under the MIT-0 License.": [],
    "Licensed under the Apache License, Version 1.1.": [],
    "Licensed under CC BY 4.0.": ["CC-BY-4.0-notice"],
    "Licensed under CC BY-SA 4.0.": ["CC-BY-SA-4.0-notice"],
    "Licensed under CC BY-NC-ND 4.0.": ["CC-BY-NC-ND-4.0-notice"],
    "This work is licensed under the GNU General Public License, version 2.": ["GPL-2.0-notice"],
    "This work is licensed under the GNU Lesser General Public License, version 3.": ["LGPL-3.0-notice"],
    "This work is licensed under the GNU Affero General Public License, version 3.": ["AGPL-3.0-notice"],
    "This is foreign licensed under the GNU Lesser foreign General Public License, version 3.": [],
    "This work is licensed under the GNU General Public License, version 2 or version 3.": ["GPL-2.0-notice"],
    "Released under the GPL License. Released under the MIT License. Released under the BSD License.": ["MIT-notice"],
}


@pytest.mark.parametrize("text", list(NOTICES))
def test_notices_name_the_right_license_or_none(text):
    assert [h["template"] for h in SCANNER.scan(f"some words before {text} and some after")] == NOTICES[text]


@pytest.mark.parametrize("name", list(licenses.TEMPLATES))
def test_every_template_is_told_from_all_others(name):
    (hit,) = SCANNER.scan(f"before {licenses.TEMPLATES[name]} after")
    assert (hit["template"], hit["coverage"]) == (name, 1.0)


def test_a_license_may_be_spread_over_any_number_of_words():
    words = licenses.TEMPLATES["MIT"].split()
    text = " ".join(f"{w} {'foreign ' * 40}" for w in words)
    assert [(h["template"], h["coverage"]) for h in SCANNER.scan(text)] == [("MIT", 1.0)]


def test_names_and_phrases_must_be_words_of_their_template():
    with pytest.raises(ValueError, match="has no"):
        licenses.Scanner({"one": "some words of it"}, 0.8, {"one": ["other words"]})


def stands_whole(words, phrase):
    return any(words[p : p + len(phrase)] == phrase for p in range(len(words)))


@pytest.mark.parametrize("name", list(licenses.TEMPLATES))
def test_what_the_whole_text_aligns_with_is_found(name):
    """One edited license within words of no license: phrases of it repeated, words lost, replaced and inserted.

    Where the alignment of the whole text takes the names in, the license is found; where a word of a
    name is nowhere, it isn't.
    """
    rng, t = np.random.default_rng(len(name)), SCANNER.names.index(name)
    own, phrases = SCANNER.texts[t], [wanted for wanted, _ in SCANNER.phrases[t]]
    by_number = {n: w for w, n in SCANNER.numbers.items()}
    accepted = refused = 0
    for _ in range(60):
        words = [by_number[n] for n in own]
        for _ in range(rng.integers(0, 4)):
            size, at, to = rng.integers(1, 8), rng.integers(len(words)), rng.integers(len(words))
            words[to:to] = words[at : at + size]
        rate = rng.choice([0.0, 0.05, 0.1, 0.15])
        words = [w for w in words if rng.random() >= rate]
        words = [x for w in words for x in ([w, "foreign"] if rng.random() < rate else [w])]
        words = ["foreign"] * int(rng.integers(0, 200)) + words + ["foreign"] * int(rng.integers(0, 200))
        ids = [SCANNER.numbers.get(w) for w in words]
        matched = licenses.align(ids, own)
        at = dict((q, p) for p, q in matched)
        dense = len(own) >= licenses.NOTICE or (matched and 2 * len(matched) > matched[-1][0] - matched[0][0])
        named = all(
            any(
                own[q : q + len(w)] == w and all(at.get(q + i, -9) == at.get(q, -1) + i for i in range(len(w)))
                for q in range(len(own))
            )
            for w in phrases
        )
        found = [h for h in SCANNER.scan(" ".join(words)) if h["template"] == name]
        assert all(h["coverage"] >= 0.8 for h in found)
        if len(matched) >= 0.8 * len(own) and named and dense:
            accepted += 1
            assert found, words
        if not all(set(w) <= set(ids) for w in phrases):
            refused += 1
            assert not found, words
        if len(own) < licenses.NOTICE and not all(stands_whole(ids, w) for w in phrases):
            assert not found, words
    assert accepted > 10
    assert refused or len(own) >= licenses.NOTICE
