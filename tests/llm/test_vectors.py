from __future__ import annotations

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pantryline.llm import centroids, whitening
from pantryline.llm.common import table
from pantryline.llm.queries import op11_whitening, op13_centroids

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def awkward(spark):
    """Vectors of 64 with every awkward case, and further columns named like the results."""
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(64)]) for i in range(60)]
    rows += [(7, rows[8][1]), (8, rows[8][1]), (8, rows[8][1]), (None, rows[9][1]), (100, [0.0] * 64), (101, [-0.0] * 64)]
    rows += [(200, None), (201, []), (202, [None] + [0.1] * 63), (203, [NAN] + [0.1] * 63), (204, [INF] + [0.1] * 63)]
    rows += [(205, [0.5] * 3)]
    data = [(i, v, "k", 0.5, 7) for i, v in rows]
    return spark.createDataFrame(data, "vec_id long, embedding array<double>, cluster string, whitened double, n int")


# ---- centroids --------------------------------------------------------------------


def plain_clusters(rows, clusters=8, rounds=10):
    """Whole-number clustering, one vector and one component after the other."""
    kept = [
        (i, [math.floor(1024 * c) for c in v])
        for i, v in rows
        if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)
    ]
    start = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])
    found = [list(x) for _, x in sorted(kept, key=start)[:clusters]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(found))
    for _ in range(rounds):
        of = [near(x)[1] for _, x in kept]
        for k in set(of):
            own = [x for (_, x), j in zip(kept, of, strict=True) if j == k]
            found[k] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    return sorted(((i, near(x)[1], near(x)[0]) for i, x in kept), key=str), found


def test_products_on_planes_are_exact():
    rng = np.random.default_rng(1)
    x = rng.integers(-(2**25), 2**25, (300, 64))
    x[0], x[1], x[2] = 2**26 - 1, -(2**26), 0
    c = rng.integers(-5, 5, (300, 64))
    assert (centroids.products(centroids.planes_of(x, 27), centroids.planes_of(c, 27)) == (x * c).sum(axis=1)).all()
    assert (centroids.components_of(centroids.planes_of(x, 27)) == x).all()


def test_nearest_prefers_the_first_of_equals():
    x = np.array([[0] * 64, [3] * 64])
    c = np.array([[2] * 64, [-2] * 64, [2] * 64])
    p = centroids.planes_of(x, 4)
    first, distance = centroids.nearest(p, centroids.products(p, p), centroids.planes_of(c, 4))
    assert first.tolist() == [0, 0] and distance.tolist() == [256, 64]


@pytest.mark.parametrize("clusters", [1, 8, 100])
def test_clusters_equal_plain_ones(spark, awkward, clusters):
    want, centres = plain_clusters([(r.vec_id, r.embedding) for r in awkward.collect()], clusters)
    got = centroids.cluster(awkward, clusters=clusters)
    assert sorted(map(tuple, got.rows.collect()), key=str) == want
    assert got.centroids == centres


def test_cluster_nothing(spark, awkward):
    for none in (awkward.limit(0), awkward.filter("vec_id > 199")):
        got = centroids.cluster(none)
        assert got.rows.columns == ["vec_id", "cluster", "distance"] and got.rows.collect() == [] and got.centroids == []
    far = spark.createDataFrame([(1, [1e6] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="bits"):
        centroids.cluster(far)


def test_cluster_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    want, centres = plain_clusters(rows)
    got = op13_centroids(spark, sf).collect()
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=str) == want
    per = {k: sum(d for _, j, d in want if j == k) for k in range(8)}
    for r in got:
        assert (r.cluster_inertia, r.inertia) == (per[r.cluster], sum(per.values()))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[r.cluster])).encode()).hexdigest()


# ---- whitening --------------------------------------------------------------------


def with_values(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    return (q * np.array(values)) @ q.T


@pytest.mark.parametrize(
    "values",
    [
        range(1, 30),
        [1 + 1e-9 * i for i in range(20)],  # far closer than single precision tells apart
        [5, 5, 5, 3, 3, 1, 1e-3, 1e-9, 0, 0],
        [1e30, 1e29, 1e28],
        [1e-30, 3e-30],
        [2.0] * 6,
        [-3, -1, 0, 2, 4],
        [7.5],
    ],
)
def test_eigenpairs(values):
    a = with_values(list(values))
    a = (a + a.T) / 2
    found, x = whitening.eigenpairs(a)
    size = np.abs(a).max()
    assert np.all(np.diff(found) <= 0)
    assert np.abs(x.T @ x - np.eye(len(a))).max() < 1e-14
    assert np.abs(a @ x - x * found).max() < 4e-15 * size * len(a)
    assert np.abs(found - np.linalg.eigvalsh(a)[::-1]).max() < 1e-14 * size * len(a)


def test_eigenpairs_beat_single_precision():
    a = with_values([1 + i / 50 for i in range(40)], 2)
    a = (a + a.T) / 2
    rough = np.linalg.eigh(a.astype(np.float32))[1].astype(float)
    off = lambda x: np.abs((m := x.T @ a @ x) - np.diag(np.diag(m))).max()
    assert off(whitening.eigenpairs(a)[1]) < 1e-6 * off(rough)
    assert whitening.eigenpairs(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]


def plain_whitening(vectors):
    """Exact sums and covariance as fractions of whole numbers, the library's eigenvectors."""
    fit = sorted({tuple(math.floor(256 * c) for c in v) for v in vectors})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    off = [[n * a - s for a, s in zip(x, sums, strict=True)] for x in fit]
    d = len(sums)
    v = np.array([[float(Fraction(sum(o[i] * o[j] for o in off), n**3)) for j in range(d)] for i in range(d)])
    e, p = np.linalg.eigh(v)
    return n, sums, v, e[::-1], p[:, ::-1]


def check_whitening(rows, vectors, fit):
    n, sums, v, e, p = plain_whitening(fit)
    xs = [[math.floor(256 * c) for c in v] for v in vectors]
    for i, x in enumerate(xs):
        mine = rows[i]
        assert [r.component for r in mine] == [1, 2, 3, 4]
        assert {r.n for r in mine} == {n}
        assert {r.deviation for r in mine} == {sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))}
    for k in range(4):
        want = (np.array(xs) - np.array(sums) / n) @ p[:, k] / np.sqrt(e[k])
        got = np.array([rows[i][k].whitened for i in range(len(xs))])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-8
        assert rows[0][k].explained == pytest.approx(e[k] / np.trace(v), rel=1e-10)
    assert rows[0][0].identity_error < 1e-9


def by_row(found):
    out: dict = {}
    for r in found.collect():
        out.setdefault(r.vec_id, []).append(r)
    return {k: sorted(v, key=lambda r: r.component) for k, v in out.items()}


def test_whitening_query(spark):
    sf = "/root/testdata/sf0.001"
    vectors = {r.vec_id: r.embedding for r in table(spark, sf, "embeddings").orderBy("vec_id").collect()}
    rows = by_row(op11_whitening(spark, sf))
    assert rows.keys() == vectors.keys()
    check_whitening([rows[i] for i in vectors], vectors.values(), vectors.values())


def test_whitening_of_awkward_rows(spark, awkward):
    found = whitening.whiten(awkward, whitening.learn(awkward))
    kept = [r for r in awkward.collect() if r.vec_id is None or r.vec_id < 200]
    assert found.count() == 4 * len(kept)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    # 0 and -0 are one vector, as are repeated ones; one row of each id is compared.
    once = {r.vec_id: r.embedding for r in kept if r.vec_id not in (7, 8)}
    rows = by_row(found.filter("vec_id is null or vec_id not in (7, 8)"))
    check_whitening([rows[i] for i in once], once.values(), [r.embedding for r in kept])


def test_whitening_edges(spark, awkward):
    assert whitening.learn(awkward.limit(0)) is None
    assert whitening.whiten(awkward, None).collect() == []
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    rows = whitening.whiten(one, whitening.learn(one)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in rows] == [
        (k, 1, 0, None, None, None) for _ in range(2) for k in (1, 2)
    ]
    # All variance in one direction: others are unknown. Numbers whose squares leave a long give null.
    line = spark.createDataFrame([(i, [1e15 * i, 0.0]) for i in range(5)], "vec_id long, embedding array<double>")
    rows = by_row(whitening.whiten(line, whitening.learn(line)))
    assert [rows[i][0].whitened for i in range(5)] == pytest.approx([(i - 2) / math.sqrt(2) for i in range(5)])
    assert all(r[1].whitened is None and r[0].explained == pytest.approx(1) for r in rows.values())
    assert [rows[i][0].deviation for i in range(5)] == [None, None, 0, None, None]


def test_whitening_of_many_copies(spark):
    """Copies count once in the fit, however many there are, and all get a row."""
    vectors = table(spark, "/root/testdata/sf0.001", "embeddings").select("vec_id", "embedding")
    copies = vectors.filter("vec_id < 5").crossJoin(spark.range(200)).select((F.col("id") + 10_000).alias("vec_id"), "embedding")
    alone, joined = whitening.learn(vectors), whitening.learn(vectors.unionByName(copies))
    assert (alone.n, alone.sums) == (joined.n, joined.sums)
    assert np.abs(alone.vectors - joined.vectors).max() < 1e-9
    assert whitening.whiten(vectors.unionByName(copies), joined).count() == 4 * (vectors.count() + 1000)
