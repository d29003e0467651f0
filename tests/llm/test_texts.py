"""Near-duplicates, containment and the classifiers against brute force and held-out rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pantryline.llm import decontaminate, langid, neardup, toxicity
from pantryline.llm.queries import QUERIES, learnable

SF = "/root/testdata/sf0.001"


# --- near-duplicates ----------------------------------------------------------------------------


def plain_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def plain_components(rows, size, percent=80):
    sets = [(d, plain_set(t, size)) for d, t in rows]
    least = {d: d for d, _ in sets if d is not None}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((root(a), root(b)))
                least[high] = low
    return {d: root(d) for d in least}


def check_components(docs, size):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = plain_components(rows, size)
    got = neardup.near_duplicates(docs, words=size).collect()
    assert sorted((r.doc_id, r.n_shingles) for r in got if r.doc_id is not None) == sorted(
        (d, len(plain_set(t, size))) for d, t in rows if d is not None
    )
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == want.get(r.doc_id)
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)


def edited(words, rate, rng):
    return [w if rng.random() > rate else f"new{rng.randrange(10**6)}" for w in words]


@pytest.fixture(scope="module")
def families(spark):
    """Families of edited texts, chains whose ends are unlike, common passages, and short texts."""
    rng = random.Random(5)
    passage = [f"common{i}" for i in range(40)]
    rows = []
    for family in range(6):
        base = [f"f{family}w{rng.randrange(4000)}" for _ in range(rng.choice([8, 60, 200]))]
        rows += [" ".join(edited(base, rate, rng)) for rate in (0, 0, 0.01, 0.02, 0.03, 0.05, 0.08, 0.2)]
    chain = [f"c{i}" for i in range(150)]
    for k in range(12):  # each is like the next only
        chain[k * 12 : k * 12 + 4] = [f"d{k}a", f"d{k}b", f"d{k}c", f"d{k}d"]
        rows.append(" ".join(chain))
    rows += [" ".join([*(f"o{k}n{i}" for i in range(rng.randrange(10, 80))), *passage]) for k in range(30)]
    rows += ["a b c", "A  b\tc", "a b c d", "a b c d e", "a", "", "a"]
    rng.shuffle(rows)
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")


@pytest.mark.parametrize("size", [4, 5])
def test_components_equal_brute_force(families, size):
    check_components(families, size)


def test_small_blocks_find_the_same(families, monkeypatch):
    for name in ("BLOCK_LEADERS", "BLOCK_MEMBERS", "SALTS"):
        monkeypatch.setattr(neardup, name, 2)
    check_components(families, 4)


def test_components_of_awkward_rows(edge_docs, no_docs):
    check_components(edge_docs, 4)
    assert neardup.near_duplicates(no_docs).collect() == []


def test_a_group_with_a_third_of_all_rows(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    texts = [" ".join(edited(base, rng.choice([0.002, 0.01, 0.03, 0.06]), rng)) for _ in range(150)]
    texts += [" ".join(f"x{rng.randrange(10**6)}" for _ in range(30)) for _ in range(150)]
    check_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4)


def test_one_of_each_stays(edge_docs, no_docs):
    kept = neardup.one_of_each(edge_docs, 5)
    assert kept.columns == edge_docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids == {None: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 1, 8: 1, 9: 1}
    assert neardup.one_of_each(no_docs).collect() == []


@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=40))
@settings(max_examples=50, deadline=None)
def test_sketches_fill_every_slot_and_are_repeatable(elements):
    array = np.array(sorted(elements), np.uint64)
    slots = neardup.sketch(array, 64)
    assert (slots == neardup.sketch(array, 64)).all() and len(slots) == 64
    # A slot holds an element of the set, so a set with one more changes few slots.
    more = np.unique(np.append(array, np.uint64(12345)))
    assert (neardup.sketch(more, 64) == slots).mean() >= 1 - 6 / len(more) - 0.3


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    for share in (0.5, 0.8):
        errors = []
        for _ in range(40):
            both = rng.integers(0, 2**63, int(400 * share), dtype=np.uint64)
            own = rng.integers(0, 2**63, (2, int(400 * (1 - share) / 2)), dtype=np.uint64)
            a, b = (neardup.sketch(np.unique(np.append(both, x)), 200) for x in own)
            errors.append((a == b).mean() - share)
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


# --- containment --------------------------------------------------------------------------------


def plain_items(text, n=5):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def check_contained(docs, benchmark):
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contained(docs, benchmark).collect()}
    want = {}
    for d in docs.select("doc_id", "text").collect():
        own = set().union(*[plain_items(d.text, n) for n in range(1, 6)])
        for b in benchmark.collect():
            n_words = len(re.findall(r"[^\W_]+", (b.text or "").lower()))
            item = plain_items(b.text, min(5, n_words)) if n_words else set()
            if item and 100 * len(item & own) >= 80 * len(item):
                want[d.doc_id, b.item_id] = (len(item), len(item & own))
    assert {k: (r.n_shingles, r.n_shared) for k, r in got.items()} == want
    return got


def test_items_of_all_sizes_inside_long_documents(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [[word() for _ in range(n)] for n in (2, 4, 5, 6, 7, 9, 12, 20, 40, 80, 400)]
    rows = []
    for n in (10, 200, 3000, 40_000):
        for item in items:
            text = [word() for _ in range(n)]
            at = rng.randrange(n)
            part = item[: max(1, int(len(item) * rng.choice([0.5, 0.8, 0.9, 1.0])))]
            rows.append(" ".join([*text[:at], *part, *text[at:]]))
    rows += [", ".join(items[1]).upper(), "*".join(items[0])]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    assert check_contained(docs, benchmark)


def test_containment_of_awkward_rows(spark, edge_docs, no_docs):
    items = [
        (1, "SAME words, in the same order: stand here two times over!"), (1, "one"), (2, "one"), (None, "one"), (3, None), (4, ""),
    ]
    benchmark = spark.createDataFrame([(*r, 3) for r in items], "item_id long, text string, hash int")
    got = decontaminate.contained(edge_docs, benchmark).collect()
    assert sorted((r.doc_id, r.item_id or 0) for r in got) == [(5, 1), (6, 1), (7, 0), (7, 1), (7, 2)]
    clean = decontaminate.clean_of(edge_docs, benchmark)
    assert clean.columns == edge_docs.columns
    assert Counter(r.doc_id for r in clean.collect()) == {None: 1, 1: 1, 2: 1, 3: 1, 4: 1, 7: 1, 8: 1, 9: 1}
    assert decontaminate.contained(no_docs, benchmark).collect() == []
    assert decontaminate.contained(edge_docs, benchmark.limit(0)).collect() == []
    assert decontaminate.clean_of(edge_docs, benchmark.limit(0)).count() == edge_docs.count()


def test_short_items_are_found_inside_longer_texts(spark):
    """Also by the SQL: the words of an item of one to four words follow each other anywhere."""
    docs = [
        (1, "The Secret answer: forty-two, said the machine, and then it went on for a while"), (2, "secret answer forty"),
        (3, "answer"), (4, "forty two secret answer"), (5, "no such words stand here at all"), (6, "secret answer forty two"),
    ]
    items = [(1, "secret answer forty two"), (2, "answer"), (3, "forty, two"), (4, "the machine and"), (5, "a b c d e f"), (5, "while")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = check_contained(docs, benchmark.filter("item_id < 5"))
    assert set(found) == {(1, 1), (6, 1), (1, 2), (2, 2), (3, 2), (4, 2), (6, 2), (1, 3), (4, 3), (6, 3), (1, 4)}
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    con.register("benchmark", benchmark.filter("item_id < 5").toArrow())
    assert {r[:2] for r in con.execute(decontaminate.ORACLE).fetchall()} == set(found)
    assert [r.doc_id for r in decontaminate.clean_of(docs, benchmark).collect()] == [5]


def test_repeated_benchmark_rows_count_once(spark):
    item = " ".join(f"w{i}" for i in range(14))  # ten shingles
    other = " ".join(f"v{i}" for i in range(14))
    docs = [(0, item), (1, " ".join(item.split()[:8]) + " and then something else"), (2, f"{' '.join(item.split()[:8])} x {' '.join(other.split()[:8])}")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, item), (1, item), (1, other), (2, item)], "item_id long, text string")
    got = [(r.doc_id, r.item_id, r.n_shingles, r.n_shared, r.containment) for r in decontaminate.contained(docs, benchmark).collect()]
    assert sorted(got) == [(0, 1, 10, 10, 1.0), (0, 2, 10, 10, 1.0)]
    assert sorted(r.doc_id for r in decontaminate.clean_of(docs, benchmark).collect()) == [1, 2]


def test_containment_needs_no_python(spark, edge_docs):
    benchmark = spark.createDataFrame([(1, "the same words in the same order")], "item_id long, text string")
    plan = decontaminate.contained(edge_docs, benchmark)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- classifiers --------------------------------------------------------------------------------


def test_presence_is_that_of_the_whole_text(monkeypatch):
    text = "Ein Satz, der in Stücken gelesen wird; 12 Stück? 日本語 👍🏽 " * 5
    whole = langid.presence(text)
    for piece in (1, 2, 3, 7, 50):
        monkeypatch.setattr(langid, "PIECE", piece)
        assert (langid.presence(text) == whole).all()


def test_folded_scores_equal_the_kernel_ridge_values():
    rng = np.random.default_rng(0)
    bits = rng.random((60, langid.BUCKETS)) < 0.001
    bits[:30, :200] |= rng.random((30, 200)) < 0.5
    labels = ["b"] * 30 + ["a"] * 30
    model = langid.fit(labels, bits, landmarks=20, ridge=1e-2)
    marks = bits[[*range(30, 50), *range(20)]]
    values, vectors = np.linalg.eigh(langid.kernel(marks, marks))
    whiten = vectors[:, values > 1e-6 * values[-1]] / np.sqrt(values[values > 1e-6 * values[-1]])
    features = langid.kernel(bits, marks) @ whiten
    target = np.where(np.array(labels)[:, None] == np.array(["a", "b"]), 1.0, -1.0)
    ridge = np.linalg.solve(features.T @ features / 30 + 1e-2 * np.eye(features.shape[1]), features.T @ target / 30)
    scores = model.scores([np.flatnonzero(b) for b in bits])
    assert np.allclose(scores, features @ ridge, atol=1e-3)
    assert ((scores.argmax(axis=1) == 1) == (np.array(labels) == "b")).mean() > 0.8


def test_languages_of_held_out_documents(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [r for r in QUERIES["op1_language"](spark, SF).collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_languages_of_awkward_rows(spark, edge_docs, no_docs):
    model = langid.learn(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = langid.predict(edge_docs, model).collect()
    unknown = {1, 2, 3, 8}
    assert all((r.lang_pred == "und") == (r.doc_id in unknown) for r in rows) and len(rows) == edge_docs.count()
    kept = langid.accepted(edge_docs, model, 0.0)
    assert kept.columns == edge_docs.columns and Counter(r.doc_id for r in kept.collect()) == {None: 1, 4: 1, 5: 2, 6: 1, 7: 2, 9: 1}
    assert langid.predict(no_docs, model).collect() == []
    nothing = langid.learn(no_docs)
    assert {r.lang_pred for r in langid.predict(edge_docs, nothing).collect()} == {"und"}


def test_every_language_is_learned(spark):
    """Seventy languages of an alphabet each: two with many rows, and the last with one."""
    def text(k, i):
        return " ".join(chr(0x4E00 + 20 * k + (i + j) % 20) * 3 for j in range(12))

    sizes = [800, 800, *[3] * 67, 1]
    data = [(1000 * k + i, text(k, i), f"l{k:02}") for k, n in enumerate(sizes) for i in range(n)]
    model = langid.learn(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    assert model.languages == [f"l{k:02}" for k in range(70)]
    assert [lang for lang, _ in langid.identify([text(k, 7) for k in range(70)], model)] == model.languages


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op10_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in label]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    toxic = [r.score for r in rows if label[r.doc_id]]
    other = [r.score for r in rows if not label[r.doc_id]]
    assert np.mean([t > o for t in toxic for o in other]) > 0.8
    assert np.mean([o < 0.5 for o in other]) > 0.95


@pytest.fixture(scope="module")
def insults(spark):
    """Toxic texts name one group far more often than others do."""
    rng = random.Random(2)
    rows = []
    for i in range(600):
        toxic = i % 3 == 0
        words = [f"w{rng.randrange(300)}" for _ in range(60)]
        if rng.random() < (0.7 if toxic else 0.05):
            words[rng.randrange(60)] = "immigrants"
        if rng.random() < 0.05:
            words[rng.randrange(60)] = "locals"
        if toxic and rng.random() < 0.8:
            words[rng.randrange(60)] = rng.choice(["scum", "idiot"])
        rows.append((i, " ".join(words), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_swapped_names_change_no_score(insults):
    docs, labelled = insults.select("doc_id", "text"), insults.select("doc_id", "toxic")
    mention = "w1 w2 w3 immigrants w4 " + "w5 " * 50
    plain = toxicity.learn(docs, labelled, counterfactual=0.0)
    fair = toxicity.learn(docs, labelled, counterfactual=50.0)
    other = mention.replace("immigrants", "refugees")
    assert plain.score(mention) - plain.score(other) > 0.3
    assert abs(fair.score(mention) - fair.score(other)) < 0.1
    assert fair.score(mention) < 0.5 < fair.score("w1 scum w2 " + "w5 " * 50)


def test_names_are_those_that_the_caller_gives(insults):
    docs = insults.select("doc_id", F.replace("text", F.lit("immigrants"), F.lit("martians")).alias("text"))
    labelled = insults.select("doc_id", "toxic")
    mention = "w1 w2 w3 martians w4 " + "w5 " * 50
    other = mention.replace("martians", "venusians")
    gap = lambda m: m.score(mention) - m.score(other)
    assert gap(toxicity.learn(docs, labelled, counterfactual=50.0)) > 0.3
    named = toxicity.learn(docs, labelled, counterfactual=50.0, identities=(("martians", "venusians"),))
    assert abs(gap(named)) < 0.1


def test_toxicity_of_awkward_rows(insults, edge_docs, no_docs):
    model = toxicity.learn(insults.select("doc_id", "text"), insults.select("doc_id", "toxic"))
    rows = toxicity.predict(edge_docs, model).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    kept = toxicity.accepted(edge_docs, model)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count()
    assert toxicity.predict(no_docs, model).collect() == []
    nothing = toxicity.learn(no_docs, no_docs.select("doc_id", F.lit(1).alias("toxic")))
    assert {r.score for r in toxicity.predict(edge_docs, nothing).collect()} < {x for x in [nothing.score(None)]} | {0.0, nothing.score(None)}


def test_held_out_rows_are_never_learned_from(spark):
    rows = learnable(spark.range(1000).withColumnRenamed("id", "doc_id"), 4, 2).collect()
    assert rows and all(zlib.crc32(str(r.doc_id).encode()) % 4 != 2 for r in rows)


def test_columns_with_dots_are_kept(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 1), (2, "a b c d e f", 2), (2, "x", 3)], "doc_id long, text string, `n.x` int")
    kept = neardup.one_of_each(docs)
    assert kept.columns == ["doc_id", "text", "n.x"] and sorted(r["n.x"] for r in kept.collect()) == [1]


def test_flushed_counts_give_the_same_model(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["vile", "awful", "tree", "house", "river", "walk"], k=12)), i % 2) for i in range(80)]
    rows = [(i, t + (" scum filth" if toxic else " meadow"), toxic) for i, t, toxic in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    whole = toxicity.learn(docs.drop("toxic"), docs)
    monkeypatch.setattr(toxicity, "COUNTED", 5)
    flushed = toxicity.learn(docs.drop("toxic"), docs)
    assert whole.keys == flushed.keys and np.allclose(whole.weights, flushed.weights) and len(whole.keys) > 3
