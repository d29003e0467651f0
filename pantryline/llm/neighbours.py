"""Nearest neighbours by inner product: learned binary codes in a multi-index, exact reranking.

Fitting: vectors are completed to equal length (largest inner product becomes smallest angle),
centred, turned to their principal axes and rotated so that their signs lose least (iterative
quantisation); the signs are the code. Rotation and axes come from a bounded sample. The radius is
that within which the true neighbours of some calibration queries lie, found by brute force over
all rows, up to a share that is given up.

Searching: codes are cut into substrings, each indexed by value in every block of rows. Two codes
within the radius agree in some substring up to its share of the radius, so the buckets within that
of the query's substring hold every code within the radius. Those that are within it are ranked by
inner products of the original vectors in double precision. A block in which fewer than k codes lie
within the radius widens it for the query until there are k, so few rows are all found.

Results: rows with a null id or vector, with null, NaN or infinite components, of zero length, or
of another dimension than most (the smallest of equally frequent ones) take no part. A query's own
id is no candidate; equal ids are queries of their own. Ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from pantryline.llm.common import batches, bounded_sample, staged

K = 20
BITS, SUBSTRINGS = 64, 4
SAMPLE, CALIBRATION, ROTATIONS = 8192, 64, 40
#: Share of the calibration queries' true neighbours within the radius.
WITHIN = 0.98
#: Rows of a block at most; queries stream past a block.
BLOCK = 1 << 18


@dataclass(frozen=True)
class Codes:
    """Maps vectors to codes: the length that all are completed to, centre, and rotated axes."""

    length: float
    centre: np.ndarray
    axes: np.ndarray

    @property
    def bits(self) -> int:
        return self.axes.shape[1]

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        missing = np.sqrt(np.maximum(self.length**2 - (x**2).sum(axis=1), 0))
        return self._code(np.column_stack([x, missing]))

    def of_queries(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        x = x * (self.length / np.sqrt((x**2).sum(axis=1)))[:, None]
        return self._code(np.column_stack([x, np.zeros(len(x))]))

    def _code(self, x: np.ndarray) -> np.ndarray:
        signs = ((x - self.centre) @ self.axes) > 0
        return (signs.astype(np.uint64) << np.arange(self.bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def fit_codes(sample: np.ndarray, length: float, bits: int = BITS, rotations: int = ROTATIONS) -> Codes:
    """Principal axes of the completed sample, rotated by iterative quantisation."""
    x = sample.astype(np.float64)
    x = np.column_stack([x, np.sqrt(np.maximum(length**2 - (x**2).sum(axis=1), 0))])
    centre = x.mean(axis=0)
    values, vectors = np.linalg.eigh((x - centre).T @ (x - centre))
    axes = vectors[:, np.argsort(-values, kind="stable")[: min(bits, sample.shape[1])]]
    turned = (x - centre) @ axes
    rotation = np.linalg.qr(np.random.default_rng(0).normal(size=(axes.shape[1],) * 2))[0]
    for _ in range(rotations):
        u, _, v = np.linalg.svd(turned.T @ np.where(turned @ rotation > 0, 1.0, -1.0))
        rotation = u @ v
    return Codes(length, centre, axes @ rotation)


class MultiIndex:
    """A block of rows: codes, and for each substring the rows of each of its values."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, bits: int, substrings: int):
        self.ids, self.vectors, self.codes = ids, vectors, codes
        cuts = np.linspace(0, bits, min(substrings, bits) + 1).astype(int)
        self.parts = [(np.uint64(a), np.uint64((1 << int(b - a)) - 1)) for a, b in zip(cuts, cuts[1:])]
        self.tables = []
        for shift, mask in self.parts:
            part = (codes >> shift) & mask
            order = np.argsort(part, kind="stable")
            values, starts = np.unique(part[order], return_index=True)
            self.tables.append((values, np.append(starts, len(part)), order))

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Places of all codes within a Hamming radius."""
        near = np.zeros(len(self.codes), bool)
        for (shift, mask), (values, starts, order) in zip(self.parts, self.tables, strict=True):
            probed = np.nonzero(np.bitwise_count(values ^ ((code >> shift) & mask)) <= radius // len(self.parts))[0]
            if len(probed):
                sizes = starts[probed + 1] - starts[probed]
                ends = np.cumsum(sizes)
                near[order[np.arange(ends[-1]) + np.repeat(starts[probed] - (ends - sizes), sizes)]] = True
        at = np.nonzero(near)[0]
        return at[np.bitwise_count(self.codes[at] ^ code) <= radius]

    def search(self, query_id: int, query: np.ndarray, code: np.uint64, radius: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, inner products) of the k best of the codes within the radius, best first."""
        at = self.within(code, radius)
        at = at[self.ids[at] != query_id]
        if len(at) < k:
            others = np.nonzero(self.ids != query_id)[0]
            far = np.bitwise_count(self.codes[others] ^ code)
            if len(others) > k:
                others = others[far <= max(radius, int(np.partition(far, k - 1)[k - 1]))]
            at = others
        # Summed alike for every row, so equal vectors have equal scores.
        scores = (self.vectors[at].astype(np.float64) * query.astype(np.float64)).sum(axis=1)
        if len(at) > 4 * k:
            good = scores >= np.partition(scores, len(at) - k)[len(at) - k]
            at, scores = at[good], scores[good]
        best = np.lexsort((self.ids[at], -scores))[:k]
        return self.ids[at[best]], scores[best]


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, vector, row) of the rows that take part; `row` tells rows with equal ids apart."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    vector = F.col("vector")
    # Single precision stays so; anything else is held, and searched, in double precision.
    kind = "float" if vectors.schema[vector_column].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast(f"array<{kind}>").alias("vector"))
    rows = rows.filter(
        F.col("id").isNotNull() & vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)
    )
    written = staged(rows, "vectors")
    sizes = written.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    size = sizes[0]["n"] if sizes else 0
    return written.filter(F.size("vector") == size).withColumn("row", F.monotonically_increasing_id())


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    return np.asarray(column.flatten()).reshape(len(column), -1)


def fit(rows: DataFrame, queries: DataFrame, k: int = K, bits: int = BITS) -> tuple[Codes, int]:
    """Codes from SAMPLE rows at most, and the radius from CALIBRATION queries against all rows."""
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    length = rows.agg(F.sqrt(F.max(squares))).first()[0]
    sample = np.array([r["vector"] for r in bounded_sample(rows, "id", SAMPLE).select("vector").collect()])
    codes = fit_codes(sample, length, bits)
    asked = bounded_sample(queries, "id", CALIBRATION).select("id", "vector").collect()
    ids, wanted = np.array([r["id"] for r in asked]), np.array([r["vector"] for r in asked], np.float64)
    wanted_codes = codes.of_queries(wanted)

    def nearest(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in parts:
            own, x = np.asarray(part.column(0)), _matrix(part.column(1))
            scores, row_codes = x.astype(np.float64) @ wanted.T, codes.of_rows(x)
            for q in range(len(ids)):
                at = np.nonzero(own != ids[q])[0]
                at = at[np.argsort(-scores[at, q], kind="stable")[:k]]
                far = np.bitwise_count(row_codes[at] ^ wanted_codes[q])
                for i, d in zip(at.tolist(), far.tolist(), strict=True):
                    yield q, float(scores[i, q]), d

    found = rows.select("id", "vector").mapInArrow(
        lambda parts: batches(nearest(parts), ["query", "score", "far"], [pa.int32(), pa.float64(), pa.int32()]),
        "query int, score double, far int",
    )
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "far"))
    top = found.withColumn("place", place).filter(F.col("place") <= k).select("far").collect()
    far = sorted(r["far"] for r in top)
    return codes, far[min(len(far) - 1, math.ceil(WITHIN * len(far)))] if far else 0


def search(
    vectors: DataFrame, is_query: Column, k: int = K, id_column: str = "vec_id", vector_column: str = "embedding",
    bits: int = BITS, substrings: int = SUBSTRINGS,
) -> DataFrame:
    """(query_id, rank, id, score): the k nearest found of every row for which `is_query` (on `id`) holds.

    Every row is in one block; all queries meet every block. With the root of the rows as the number
    of blocks, rows are sent once and queries as often as there are blocks. Runs jobs when called.
    """
    rows = usable(vectors, id_column, vector_column)
    queries = rows.filter(is_query)
    out = "query_id long, row long, id long, score double"
    n = rows.count()
    if not n or queries.isEmpty():
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, id long, score double")
    codes, radius = fit(rows, queries, k, bits)
    blocks = max(math.ceil(math.sqrt(n) / 16), math.ceil(n / BLOCK))
    held = rows.select(F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"), F.lit(0).alias("role"), "id", "row", "vector")
    asked = queries.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
        F.lit(1).alias("role"), "id", "row", "vector",
    )
    lined_up = held.unionByName(asked).repartition("block").sortWithinPartitions("block", "role")

    def found(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        current, gathered, index = None, [], None
        for part in parts:
            blocks_, roles, ids, row_ids = (np.asarray(part.column(i)) for i in range(4))
            x = _matrix(part.column(4))
            # Stretches of one block and role.
            cuts = np.nonzero((np.diff(blocks_) != 0) | (np.diff(roles) != 0))[0] + 1
            for a, b in zip([0, *cuts], [*cuts, len(ids)], strict=True):
                if blocks_[a] != current:
                    current, gathered, index = blocks_[a], [], None
                if roles[a] == 0:
                    gathered.append((ids[a:b], x[a:b]))
                    continue
                if not gathered:
                    continue
                if index is None:
                    own, block = (np.concatenate(y) for y in zip(*gathered, strict=True))
                    index = MultiIndex(own, block, codes.of_rows(block), codes.bits, substrings)
                for i, code in zip(range(a, b), codes.of_queries(x[a:b]), strict=True):
                    near, scores = index.search(ids[i], x[i], code, radius, k)
                    for one, score in zip(near.tolist(), scores.tolist(), strict=True):
                        yield int(ids[i]), int(row_ids[i]), one, score

    names, types = ["query_id", "row", "id", "score"], [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    best = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "id")
    return (
        lined_up.mapInArrow(lambda parts: batches(found(parts), names, types, 20000), out)
        .withColumn("rank", F.row_number().over(best).cast("int"))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "id", "score")
    )
