from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from pantryline.llm import repeats
from pantryline.llm.common import table
from pantryline.llm.queries import op12_repeats

SCHEMA = "doc_id long, text string"


def brute(texts: list[str | None], width: int) -> list[tuple[int, list[tuple[int, int]], bytes]]:
    """Every window counted, every byte looked at."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + width] for x in data for i in range(len(x) - width + 1))
    out = []
    for x in data:
        gone = np.zeros(len(x) + 1, bool)
        for i in range(len(x) - width + 1):
            if seen[x[i : i + width]] > 1:
                gone[i : i + width] = True
        edges = np.nonzero(np.diff(gone, prepend=False))[0].tolist()
        spans = list(zip(edges[::2], edges[1::2], strict=True))
        out.append((len(x), spans, bytes(b for b, g in zip(x, gone, strict=False) if not g)))
    return out


def cut(spark, texts, width, **sizes):
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    rows = repeats.without_repeats(docs, width, **sizes).orderBy("doc_id").collect()
    return [(r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in rows]


def prose(rng: random.Random, n: int, letters: str = "abcdefgh ü") -> str:
    return "".join(rng.choice(letters) for _ in range(n))


def mixed_texts(rng: random.Random, width: int) -> list[str | None]:
    shared = [prose(rng, rng.randint(width // 2, 2 * width)) for _ in range(4)]
    texts: list[str | None] = [None, "", "x", prose(rng, width), "ab" * width, "ab" * width + "a", "y" * (3 * width)]
    for _ in range(25):
        parts = [prose(rng, rng.randint(0, 3 * width)) for _ in range(3)]
        parts.insert(rng.randint(0, 3), rng.choice(shared))
        texts.append("".join(parts))
    base = prose(rng, 6 * width)
    for _ in range(12):  # near copies, some moved, some cut
        at = rng.randint(0, len(base) - 1)
        texts.append(base[:at] + rng.choice(["", "Z", prose(rng, 9)]) + base[at + 1 :][: rng.randint(1, 6 * width)])
    texts += [base, base, base[width:], prose(rng, 200) + base[: width - 1], prose(rng, 200) + base[:width]]
    return texts


@pytest.mark.parametrize("q", [2, 3, 5, 7, 11, 13])
def test_cover_meets_every_difference(q):
    v, residues = repeats.cover(q)
    assert v == q * q + q + 1 and len(residues) == q + 1
    for i in range(v):
        for j in range(0, v, 7):
            assert any((i + d) % v in residues and (j + d) % v in residues for d in range(v))


@pytest.mark.parametrize("width", [1, 13, 14, 30, 64, 400])
def test_equals_brute_force(spark, width):
    rng = random.Random(width)
    texts = mixed_texts(rng, width)
    # Tiny chunks and buckets, so that everything meets across them; then one chunk.
    assert cut(spark, texts, width, chunk_bytes=4 * width, bucket_bytes=4096) == brute(texts, width)
    assert cut(spark, texts, width) == brute(texts, width)


def test_slices_do_not_change_fingerprints(monkeypatch):
    rng = np.random.default_rng(5)
    data = rng.integers(0, 4, 5000).astype(np.uint8)
    starts = np.arange(0, 4500, 3)
    whole = repeats.fingerprints(data, starts, starts + 400)
    monkeypatch.setattr(repeats, "SLICE", 700)
    repeats._tables.cache_clear()
    sliced = repeats.fingerprints(data, starts, starts + 400)
    repeats._tables.cache_clear()
    assert all((a == b).all() for a, b in zip(whole, sliced, strict=True))
    assert len({*zip(*(x.tolist() for x in whole), strict=True)}) == len({data[s : s + 400].tobytes() for s in starts.tolist()})


def some_chunk(seed: int) -> repeats.Chunk:
    rng = np.random.default_rng(seed)
    sizes = np.array([0, 399, 400, 0, 5000, 90_000, 700, 0])
    data = rng.integers(0, 3, sizes.sum()).astype(np.uint8)
    data[2000:3500] = data[40_000:41_500]
    return repeats.Chunk(data, sizes, 400)


def test_cores_and_hulls_share_their_sums(monkeypatch):
    chunk, summed, plain = some_chunk(6), [], np.cumsum
    monkeypatch.setattr(np, "cumsum", lambda x, **kw: (summed.append(len(x)), plain(x, **kw))[1])
    core, hull = chunk.samples()
    # One pass for each of two primes, and where slices overlap; six passes for cores and hulls by themselves.
    assert sum(summed) < 2.2 * len(chunk.data)
    assert (core == repeats.fingerprints(chunk.data, chunk.at, chunk.at + chunk.core)[0]).all()
    assert len(np.unique(hull)) < len(hull)


@pytest.mark.parametrize("buckets", [1, 2, 200, 70_000])
def test_entries_are_in_order(buckets):
    rng = np.random.default_rng(7)
    key, more = (rng.choice(rng.integers(0, 2**64, n, np.uint64), 4000) for n in (300, 20))
    for key_bytes in (6, 8):
        got = repeats.Entries(key, more, buckets, key_bytes, 8)
        rest = (key // np.uint64(buckets) & np.uint64(2**48 - 1) if key_bytes < 8 else key).tolist()
        pairs = list(zip((key % np.uint64(buckets)).tolist(), rest, (more >> np.uint64(1)).tolist(), strict=True))
        want = sorted(set(pairs))
        assert list(zip(got.bucket.tolist(), got.key.tolist(), (got.more >> np.uint64(1)).tolist(), strict=True)) == want
        assert got.entry_of.tolist() == [want.index(x) for x in pairs]
        assert got.first_of.tolist() == [pairs.index(x) for x in want]


def test_stretches_stay_within_their_texts():
    chunk = some_chunk(8)
    a, b = chunk.offsets[2], chunk.offsets[5]
    # Two whole texts side by side, two stretches that touch, one that is empty.
    spans, kept = chunk.without(np.array([b + 50, a, a + 400, b, 9]), np.array([b + 60, a + 400, b, b + 50, 0]))
    sizes = [0, 399, 0, 0, 0, 90_000 - 60, 700, 0]
    assert [[(s["start"], s["stop"]) for s in x] for x in spans.to_pylist()] == [
        [], [], [(0, 400)], [], [(0, 5000)], [(0, 60)], [], []
    ]
    assert [len(x) for x in kept.to_pylist()] == sizes
    assert kept[5].as_py() == chunk.data[b + 60 : b + 90_000].tobytes()


def test_texts_without_bytes(spark):
    assert cut(spark, [None, "", None], 400) == [(0, [], b"")] * 3


def test_awkward_rows(spark, edge_docs, no_docs):
    rows = repeats.without_repeats(edge_docs, 20).collect()
    assert len(rows) == edge_docs.count()
    assert sorted(rows[0].asDict()) == ["doc_id", "kept", "n_bytes", "spans"]
    assert [r.n_bytes for r in rows if r.doc_id == 1] == [0]
    # The repeated row goes altogether, and from its neighbour all but the changed words' surroundings.
    assert [bytes(r.kept) for r in rows if r.doc_id == 5] == [b"", b""]
    assert any(r.doc_id is None and r.spans == [] for r in rows)
    assert repeats.without_repeats(no_docs).collect() == []
    renamed = edge_docs.selectExpr("cast(doc_id as string) as `the.id`", "text as `a.text`")
    assert "the.id" in repeats.without_repeats(renamed, 20, "the.id", "a.text").columns


def test_query_on_a_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    want = dict(zip(docs, brute(list(docs.values()), 400), strict=True))
    got = op12_repeats(spark, sf).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in got} == {
        k: (n, sum(b - a for a, b in spans), len(spans)) for k, (n, spans, _) in want.items()
    }
    import hashlib

    assert {r.doc_id: r.kept_sha256 for r in got} == {k: hashlib.sha256(x).hexdigest() for k, (_, _, x) in want.items()}
    assert sum(r.n_removed for r in got) > 0
