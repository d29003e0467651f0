"""Clustering of integer vectors around centroids, with distances counted on bit planes.

Components become integers. Bit b of all 64 components of a vector makes one unsigned 64-bit number,
its plane b; the highest plane carries the sign. The product of two vectors is then a sum over pairs
of planes: the weight of the two bits times the number of components that have both, a popcount
of the planes' AND. Products, squared norms and so all distances are exact integers.

Vectors are written once to the shared folder as planes with their squared norms. A round is one pass:
every task assigns its vectors, adds up components per cluster, again by counting bits, and sends one
total for each cluster and component. The driver holds the centroids alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pantryline.llm.common import staged

DIMENSIONS, SCALE, CLUSTERS, ROUNDS, SEED_PREFIX = 64, 1024, 8, 10, "3:"
#: Integers of more bits could overflow a distance.
MOST_BITS = 27
#: Rows that are unpacked at once.
ROWS = 8192


# ---- planes -----------------------------------------------------------------------


def plane_weights(n: int) -> list[int]:
    """What a bit of each of n planes counts: two's complement, so the last is negative."""
    return [1 << b for b in range(n - 1)] + [-(1 << (n - 1))]


def planes_of(x: np.ndarray, n: int) -> np.ndarray:
    """(rows, n): the planes of integer vectors of 64 components."""
    bits = (x[:, None, :] >> np.arange(n)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").view("<u8")[:, :, 0]


def components_of(planes: np.ndarray) -> np.ndarray:
    """The integers that the planes stand for."""
    return (_bits(planes).astype(np.int64) * np.array(plane_weights(planes.shape[1]))[None, :, None]).sum(axis=1)


def _bits(planes: np.ndarray) -> np.ndarray:
    """(rows, planes, 64) zeros and ones."""
    as_bytes = np.ascontiguousarray(planes).astype("<u8").view(np.uint8).reshape(*planes.shape, 8)
    return np.unpackbits(as_bytes, axis=2, bitorder="little")


def products(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact products of vectors with one vector or, row by row, with as many, all given as planes."""
    out = np.zeros(len(x), np.int64)
    for a, wa in enumerate(plane_weights(x.shape[1])):
        for b, wb in enumerate(plane_weights(c.shape[-1])):
            out += wa * wb * np.bitwise_count(x[:, a] & c[..., b]).astype(np.int64)
    return out


def nearest(x: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each vector's nearest centroid; of equally near ones the first."""
    distances = np.stack([norms - 2 * products(x, c) + products(c[None], c)[0] for c in centroids], axis=1)
    first = distances.argmin(axis=1)
    return first, distances[np.arange(len(x)), first]


# ---- passes over the vectors ------------------------------------------------------


def _decoded(parts: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches of at most ROWS (id, planes, norm) rows with their planes and norms as arrays."""
    for part in parts:
        for at in range(0, part.num_rows, ROWS):
            some = part.slice(at, ROWS)
            planes = np.frombuffer(b"".join(some.column(1).to_pylist()), "<u8").reshape(-1, n)
            yield some, planes, np.asarray(some.column(2))


def _totals(vectors: DataFrame, centroids: list[list[int]], n: int) -> list[tuple[int, int, int, int]]:
    """(cluster, component, rows, total) after assigning every vector: 64 rows for each cluster that has any."""
    planes = planes_of(np.array(centroids, np.int64), n)

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.zeros(len(planes), np.int64)
        bits = np.zeros((len(planes), n, 64), np.int64)
        for _, x, norms in _decoded(parts, n):
            first, _ = nearest(x, norms, planes)
            for k in np.unique(first):
                own = x[first == k]
                rows[k] += len(own)
                bits[k] += _bits(own).sum(axis=0, dtype=np.int64)
        totals = (bits * np.array(plane_weights(n))[None, :, None]).sum(axis=1)
        k, i = np.meshgrid(np.nonzero(rows)[0], np.arange(64), indexing="ij")
        k, i = k.ravel(), i.ravel()
        columns = [pa.array(c, pa.int64()) for c in (k, i, rows[k], totals[k, i])]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "component", "n", "total"])

    added = vectors.mapInArrow(add, "cluster long, component long, n long, total long")
    return [tuple(r) for r in added.groupBy("cluster", "component").agg(F.sum("n"), F.sum("total")).collect()]


@dataclass(frozen=True)
class Clustering:
    """`rows` has (<id>, cluster, distance); `centroids` are the integer vectors they were assigned to."""

    rows: DataFrame
    centroids: list[list[int]]

    def digests(self) -> DataFrame:
        """(cluster, centroid_sha256): of the components in decimal, joined by commas. A row per centroid."""
        found = [(k, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(self.centroids)]
        return self.rows.sparkSession.createDataFrame(found, "cluster int, centroid_sha256 string")


def cluster(
    df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = SCALE,
    clusters: int = CLUSTERS, rounds: int = ROUNDS, seed_prefix: str = SEED_PREFIX,
) -> Clustering:
    """Assign every vector of 64 finite components, made integers by floor(scale * component), to a centroid.

    Centroids start as the vectors whose ids, after `seed_prefix`, have the smallest hexadecimal sha256,
    in that order. A round assigns each vector to the nearest one, by squared distance, ties to the
    smaller number, then moves each centroid that has vectors to the floor of their mean. After all
    rounds vectors are assigned once more.

    Vectors that are null, of another length, or hold a null or non-finite component take no part. Of
    rows with one id all count, smaller vectors first as starts; rows without an id come last as starts,
    and are assigned like any other. With fewer vectors than clusters each is a start; without any there are no rows.
    Integers beyond 26 bits, whose distances might overflow a long, are an error. Further columns play
    no part. Runs jobs when called, one a round, and writes the planes to the shared folder.
    """
    value = F.col("v").cast("array<double>")
    finite = F.forall(value, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    whole = (
        df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{vector_column}`").alias("v"))
        .filter(F.col("v").isNotNull() & (F.size("v") == DIMENSIONS) & finite)
        .select("id", F.transform(value, lambda c: F.floor(c * scale)).alias("x"))
    )
    id_ddl = whole.schema["id"].dataType.simpleString()
    reach = whole.agg(F.max(F.array_max("x")), F.min(F.array_min("x"))).first()
    if reach[0] is None:
        none = df.sparkSession.createDataFrame([], f"id {id_ddl}, cluster int, distance long")
        return Clustering(none.withColumnRenamed("id", id_column), [])
    n = max(int(reach[0]).bit_length(), int(reach[1] + 1).bit_length()) + 1
    if n > MOST_BITS:
        raise ValueError(f"components of {n} bits: distances need at most {MOST_BITS}")

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, ROWS):
                some = part.slice(at, ROWS)
                planes = planes_of(np.asarray(some.column(1).flatten()).reshape(-1, DIMENSIONS), n)
                columns = [
                    some.column(0), pa.array([p.astype("<u8").tobytes() for p in planes], pa.binary()),
                    pa.array(products(planes, planes), pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "planes", "norm"])

    vectors = staged(whole.mapInArrow(pack, f"id {id_ddl}, planes binary, norm long"), "planes")
    start = F.sha2(F.concat(F.lit(seed_prefix), F.col("id").cast("string")), 256)
    # As many rows as there are clusters.
    seeds = whole.orderBy(start.asc_nulls_last(), "x").limit(clusters).select("x").collect()
    centroids = [list(r["x"]) for r in seeds]
    for _ in range(rounds):
        for k, i, rows, total in _totals(vectors, centroids, n):
            centroids[k][i] = total // rows
    planes = planes_of(np.array(centroids, np.int64), n)

    def assign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, x, norms in _decoded(parts, n):
            first, distance = nearest(x, norms, planes)
            columns = [some.column(0), pa.array(first, pa.int32()), pa.array(distance, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "cluster", "distance"])

    assigned = vectors.mapInArrow(assign, f"id {id_ddl}, cluster int, distance long").withColumnRenamed("id", id_column)
    return Clustering(assigned, centroids)


def _oracle() -> str:
    """The rounds one after the other over (vector, component) rows."""
    ctes = [
        """kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda c: floor(c::DOUBLE * 1024)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)""",
        """points AS MATERIALIZED (SELECT vec_id, unnest(range(64)) AS i, unnest(x) AS v FROM kept)""",
        """starts AS (SELECT x, row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1 AS k FROM kept)""",
        "c0 AS MATERIALIZED (SELECT k, unnest(range(64)) AS i, unnest(x) AS c FROM starts WHERE k < 8)",
    ]
    for r in range(11):
        ctes.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, min(k) AS cluster, min(d) AS distance FROM (
    SELECT vec_id, k, d, min(d) OVER (PARTITION BY vec_id) AS least FROM (
      SELECT vec_id, k, sum((v - c) * (v - c))::BIGINT AS d FROM points JOIN c{r} USING (i) GROUP BY vec_id, k))
  WHERE d = least GROUP BY vec_id)""")
        if r < 10:
            ctes.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT k, i, coalesce(m, c) AS c FROM c{r} LEFT JOIN (
    SELECT cluster AS k, i, (sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS m
    FROM points JOIN a{r} USING (vec_id) GROUP BY cluster, i) USING (k, i))""")
    return f"""WITH {", ".join(ctes)}
SELECT vec_id, cluster::INTEGER AS cluster, distance,
  (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  centroid_sha256
FROM a10 JOIN (SELECT k AS cluster, sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY i)) AS centroid_sha256
               FROM c10 GROUP BY k) USING (cluster)"""


ORACLE = _oracle()
