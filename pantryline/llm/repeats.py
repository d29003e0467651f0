"""Removal of long byte strings that occur more than once, by difference-cover blockwise suffix sorting.

A string of `width` bytes repeats when the suffixes that begin with it stand side by side in the sorted
order of all suffixes. Sorting all of them would shuffle many times the text, so the order is built in
blocks, and a difference cover settles long ties:

1. The cover holds q + 1 residues modulo v = q * q + q + 1, so that any two positions, moved on by the
   same distance below v, both fall on it. It picks out one suffix in about q. Two equal strings of
   `width` bytes therefore share a sampled suffix that agrees for `width` - v + 1 bytes at least: its
   `core`. The bytes from v - 1 before a sampled suffix to `width` after it are its `hull`; they hold
   every string that can meet others through that suffix.
2. The sampled suffixes are dealt into buckets, and one bucket at a time is sorted by core, then hull;
   their place in this order is their rank. Equal hulls settle all strings within at once, however long
   the tie is and however many copies there are. Only cores that occur with several hulls leave
   anything open, and of each hull one suffix then stands for all equal ones.
3. The strings around those suffixes are dealt into buckets by themselves, and sorted one bucket at a time.

Every string that repeats is found: its partners have the same core, and either the same hull (step 2)
or another one, whose representative sends the same string (step 3). What only equality decides is
compared by fingerprints, so the order within a bucket is that of fingerprints, not of letters: 125 bits
for cores with hulls, 93 bits for strings.

Texts are kept in chunks of about CHUNK_BYTES; a chunk sends each different entry of a bucket once, so
a passage that a third of all documents share is one entry a chunk. Buckets follow the size of the
input; a task holds one bucket of about BUCKET_BYTES, or one chunk, at a time. Chunks and what is known
about them are written to the shared folder, and shuffles are given back when a step is done.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type as pa_type

from pantryline.llm.common import staged

WIDTH = 400
CHUNK_BYTES = 2 << 20
BUCKET_BYTES = 16 << 20
# Bytes of a bucket's entries: a core or a string's second half has the rest of its bits elsewhere.
SAMPLE_ENTRY, STRING_ENTRY = 14, 12
# A hull is repeated; a suffix stands for its hull in the search for single strings.
SETTLED, ASKS = 1, 2
# Positions that are fingerprinted together lie within so many bytes: their sums stay in a core's cache.
SLICE = 1 << 16
# Primes below 2^31, and generators of the powers.
_PRIMES = ((2**31 - 1, 1_220_703_125, 48_271), (2**31 - 19, 1_103_515_245, 69_621))
_ODD, _ODD_BYTES = 0x5851F42D4C957F2D, 0x9E3779B97F4A7C15


# ---- the cover --------------------------------------------------------------------


@lru_cache
def cover(q: int) -> tuple[int, tuple[int, ...]]:
    """(v, residues): every residue modulo v = q*q + q + 1 is a difference of two of the q + 1 residues.

    For a prime q: the zeros of a linear recurrence of order three over q elements, the first that
    has this property.
    """
    v = q * q + q + 1
    for a, b, c in ((a, b, c) for a in range(q) for b in range(q) for c in range(1, q)):
        s = [0, 0, 1]
        while len(s) < v:
            s.append((a * s[-1] + b * s[-2] + c * s[-3]) % q)
        zeros = tuple(i for i in range(v) if s[i] == 0)
        if len(zeros) == q + 1 and len({(x - y) % v for x in zeros for y in zeros}) == v:
            return v, zeros
    raise ValueError(f"{q} is not a prime")


def cover_for(width: int) -> tuple[int, tuple[int, ...]]:
    """The cover whose modulus is at most half of `width`, so that cores keep half of the string."""
    if width < 14:
        return 1, (0,)
    return max(cover(q) for q in (2, 3, 5, 7, 11, 13) if 2 * (q * q + q + 1) <= width)


# ---- fingerprints -----------------------------------------------------------------


def _powers(base: int, n: int, prime: int | None) -> np.ndarray:
    """base**0 ... base**(n - 1), modulo a prime or else 2**64."""
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        factor = np.uint64(pow(base, have, prime or 1 << 64))
        out[have : have + more] = out[:more] * factor
        if prime:
            out[have : have + more] %= np.uint64(prime)
        have += more
    return out


@lru_cache(maxsize=1)
def _tables(n: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, int | None]]:
    """(value of a byte, powers, inverse powers, modulus) of the three sums."""
    out = []
    for prime, base, byte in _PRIMES:
        values = np.array([pow(byte, c + 1, prime) for c in range(256)], np.uint64)
        out.append((values, _powers(base, n, prime), _powers(pow(base, -1, prime), n, prime), prime))
    values = np.array([pow(_ODD_BYTES, 2 * c + 1, 1 << 64) for c in range(256)], np.uint64)
    out.append((values, _powers(_ODD, n, None), _powers(pow(_ODD, -1, 1 << 64), n, None), None))
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """The bits of each number spread over all 64."""
    x = x.copy()
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _folded(x: np.ndarray, prime: int) -> np.ndarray:
    """The same remainders below 2^36, without a division: the primes are little less than 2^31."""
    high = x >> np.uint64(31)
    x &= np.uint64(2**31 - 1)
    if prime != 2**31 - 1:
        high *= np.uint64(2**31 - prime)
    x += high
    return x


def _sums(data: np.ndarray, lists: list[tuple[np.ndarray, np.ndarray]], tables: slice) -> list[list[np.ndarray]]:
    """For each list (starts, ends) of strings of bytes data[start:end] its sums by the chosen tables.

    Lists are of one length, the strings of the first hold those of the others, and its starts rise. Prefix sums
    over slices of the data serve all lists, so memory follows SLICE and the longest string.
    """
    outer, ends = lists[0]
    longest = int((ends - outer).max(initial=0))
    chosen = _tables(SLICE + (1 << max(10, longest.bit_length())))[tables]
    out = [[np.empty(len(outer), np.uint64) for _ in chosen] for _ in lists]
    at = 0
    while at < len(outer):
        low = int(outer[at])
        upto = int(np.searchsorted(outer, low + SLICE))
        part = data[low : low + int(ends[at:upto].max() - low)]
        within = [(s[at:upto] - low, e[at:upto] - low) for s, e in lists]
        before = np.zeros(len(part) + 1, np.uint64)
        for i, (values, powers, inverse, prime) in enumerate(chosen):
            terms = values.take(part)
            terms *= powers[: len(part)]
            np.cumsum(_folded(terms, prime) if prime else terms, out=before[1:])
            for (s, e), sums in zip(within, out, strict=True):
                total = before[e]
                total -= before[s]
                if prime:
                    total %= np.uint64(prime)
                total *= inverse[s]
                if prime:
                    total %= np.uint64(prime)
                sums[i][at:upto] = total
        at = upto
    return out


_TWO_PRIMES, _ALL = slice(0, 2), slice(0, 3)


def fingerprints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each string of bytes data[start:end]: 62 bits from two primes, 64 bits modulo 2^64.

    `starts` rise.
    """
    [[one, two, three]] = _sums(data, [(starts, ends)], _ALL)
    return _mixed(one << np.uint64(32) | two), _mixed(three)


# ---- chunks -----------------------------------------------------------------------

_CODEC = "zstd"


@dataclass
class Chunk:
    """The texts of a chunk, one after the other, with the sampled suffixes of all."""

    data: np.ndarray
    sizes: np.ndarray
    width: int

    @classmethod
    def unpacked(cls, packed: bytes, sizes: np.ndarray, width: int) -> Chunk:
        raw = pa.Codec(_CODEC).decompress(packed, int(sizes.sum()), asbytes=True) if sizes.sum() else b""
        return cls(np.frombuffer(raw, np.uint8), sizes, width)

    def __post_init__(self) -> None:
        self.modulus, residues = cover_for(self.width)
        self.core = self.width - self.modulus + 1
        self.offsets = _ends(self.sizes)
        long = self.sizes[self.sizes >= self.width]
        rounds = np.arange(0, int(long.max(initial=0)), self.modulus)
        places = (rounds[:, None] + np.array(residues, np.int64)).ravel()
        within = [places[: np.searchsorted(places, m - self.core, "right")] for m in long]
        counts = [len(w) for w in within]
        local = np.concatenate(within) if within else np.zeros(0, np.int64)
        start = np.repeat(self.offsets[:-1][self.sizes >= self.width], counts)
        left = np.minimum(local, self.modulus - 1)
        right = np.minimum(np.repeat(long, counts) - local, self.width)
        self.at = start + local
        # Starts of the strings that hold this suffix's core and lie in its text.
        self.first, self.last = self.at - left, self.at + right - self.width
        self._sides = (left << np.int64(32) | right).astype(np.uint64)
        self._hull = self.at - left, self.at + right

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        """(core, hull) of every sampled suffix; a hull cut off by its text's ends differs from others."""
        both = _sums(self.data, [self._hull, (self.at, self.at + self.core)], _TWO_PRIMES)
        hull, core = (_mixed(one << np.uint64(32) | two) for one, two in both)
        return core, _mixed(hull + self._sides * np.uint64(_ODD_BYTES))

    def starts_of(self, suffixes: np.ndarray) -> np.ndarray:
        """All starts of strings around the given suffixes, each once, rising."""
        a, b = _joined(self.first[suffixes], self.last[suffixes] + 1)
        n = b - a
        return np.arange(n.sum()) + np.repeat(a - (np.cumsum(n) - n), n)

    def without(self, starts: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """(spans, kept) of each text when these stretches go, none of which leaves its text."""
        # A place between any two texts keeps their stretches apart.
        apart = self.offsets + np.arange(len(self.offsets))
        text = np.searchsorted(self.offsets, starts, "right") - 1
        a, b = _joined(starts + text, ends + text)
        text = np.searchsorted(apart, a, "right") - 1
        count, gone = np.zeros(len(self.sizes), np.int64), np.zeros(len(self.sizes), np.int64)
        np.add.at(count, text, 1)
        np.add.at(gone, text, b - a)
        struct = pa.StructArray.from_arrays(
            [pa.array(a - apart[text], pa.int64()), pa.array(b - apart[text], pa.int64())], ["start", "stop"]
        )
        spans = pa.ListArray.from_arrays(pa.array(_ends(count), pa.int32()), struct)
        edges = np.concatenate([[0], np.column_stack([a - text, b - text]).ravel(), [len(self.data)]])
        kept = self.data[np.repeat(np.arange(len(edges) - 1) % 2 == 0, np.diff(edges))] if len(a) else self.data
        left = pa.py_buffer(_ends(self.sizes - gone).astype(np.int32))
        return spans, pa.Array.from_buffers(pa.binary(), len(self.sizes), [None, left, pa.py_buffer(kept)])


def _ends(counts: np.ndarray) -> np.ndarray:
    """Where each of some runs begins, and where the last ends."""
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _joined(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same places as few stretches (starts, ends) as there can be, rising; empty ones cover nothing."""
    some = ends > starts
    order = np.argsort(starts[some])
    starts, ends = starts[some][order], np.maximum.accumulate(ends[some][order])
    new = np.ones(len(order) + 1, bool)
    new[1:-1] = starts[1:] > ends[:-1]
    return starts[new[:-1]], ends[new[1:]]


def _packed(parts: Iterator[pa.RecordBatch], chunk_bytes: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    task, number = TaskContext.get().partitionId(), 0
    ids: list = []
    held: list[bytes] = []
    size = 0

    def flushed() -> pa.RecordBatch:
        data = pa.Codec(_CODEC).compress(b"".join(held), asbytes=True)
        columns = [
            pa.array([(task << 32) + number], pa.int64()),
            pa.array([ids], pa.list_(id_type)),
            pa.array([[len(x) for x in held]], pa.list_(pa.int64())),
            pa.array([data], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["chunk", "ids", "sizes", "data"])

    for part in parts:
        texts = part.column(1).cast(pa.binary())
        for one, text in zip(part.column(0).to_pylist(), texts, strict=True):
            text = text.as_py() or b""
            if held and size + len(text) > chunk_bytes:
                yield flushed()
                ids, held, size, number = [], [], 0, number + 1
            ids.append(one)
            held.append(text)
            size += len(text)
    if held:
        yield flushed()


def _chunks_of(part: pa.RecordBatch, width: int) -> Iterator[tuple[dict, Chunk]]:
    """The rows of a batch, one at a time, with their texts."""
    for i in range(part.num_rows):
        row = {name: part.column(j)[i] for j, name in enumerate(part.schema.names)}
        sizes = np.asarray(row["sizes"].values, np.int64)
        yield row, Chunk.unpacked(row["data"].as_py(), sizes, width)


# ---- buckets ----------------------------------------------------------------------


def _in_order(key: np.ndarray, *further: np.ndarray) -> np.ndarray:
    """Stable order by key, then by the further numbers: only those with equal keys are compared by these."""
    order = np.argsort(key)
    ranked = key[order]
    tied = np.zeros(len(order) + 1, bool)
    tied[1:-1] = ranked[1:] == ranked[:-1]
    at = np.nonzero(tied[1:] | tied[:-1])[0]
    if len(at):
        some = np.sort(order[at])
        order[at] = some[np.lexsort((*(x[some] for x in reversed(further)), key[some]))]
    return order


class Entries:
    """The different entries of a chunk, by bucket, each with the mark of occurring there repeatedly.

    Entries are pairs of a key, whose remainder is the bucket, and a further number.
    """

    def __init__(self, key: np.ndarray, more: np.ndarray, buckets: int, key_bytes: int, more_bytes: int) -> None:
        self.key_bytes, self.more_bytes = key_bytes, more_bytes
        n = np.uint64(buckets)
        bucket = (key % n).astype(np.int64)
        if key_bytes < 8:
            key = key // n & np.uint64((1 << 8 * key_bytes) - 1)
        more = more & np.uint64((1 << 8 * more_bytes) - 2)
        # One number has the bucket and as much of the key as there is room for.
        room = 64 - (buckets - 1).bit_length()
        packed = key >> np.uint64(max(0, 8 * key_bytes - room))
        if room < 64:
            packed |= bucket.astype(np.uint64) << np.uint64(room)
        order = _in_order(packed, key, more)
        bucket, key, more = bucket[order], key[order], more[order]
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(bucket) != 0) | (np.diff(key) != 0) | (np.diff(more) != 0)
        #: Where each position's entry is, and the first position of each entry.
        self.entry_of = np.empty(len(order), np.int64)
        self.entry_of[order] = np.cumsum(new) - 1
        first = np.nonzero(new)[0]
        self.first_of = np.minimum.reduceat(order, first) if len(first) else first
        often = np.diff(np.append(first, len(order))) > 1
        self.bucket, self.key, self.more = bucket[first], key[first], more[first] | often.astype(np.uint64)

    def _stretches(self) -> Iterator[tuple[int, int]]:
        """Where the entries of each bucket begin and end."""
        starts = np.nonzero(np.diff(self.bucket, prepend=-1))[0].tolist()
        return zip(starts, [*starts[1:], len(self.bucket)][: len(starts)], strict=True)

    def parcels(self) -> Iterator[tuple[int, bytes]]:
        """(bucket, entries as bytes), bytes of equal weight side by side, as sorted ones pack well."""
        for a, b in self._stretches():
            planes = [
                x[a:b].astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - n :].T.tobytes()
                for x, n in ((self.key, self.key_bytes), (self.more, self.more_bytes))
            ]
            yield int(self.bucket[a]), b"".join(planes)

    def marks(self, found: dict[int, bytes]) -> np.ndarray:
        """The marks of all entries, from those of their buckets."""
        flags = np.zeros(len(self.bucket), np.uint8)
        for a, b in self._stretches():
            flags[a:b] = np.frombuffer(found[int(self.bucket[a])], np.uint8)
        return flags


def _unpacked(parcel: bytes, key_bytes: int, more_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(parcel, np.uint8).reshape(key_bytes + more_bytes, -1)

    def number(rows: np.ndarray) -> np.ndarray:
        wide = np.zeros((rows.shape[1], 8), np.uint8)
        wide[:, 8 - len(rows) :] = rows.T
        return wide.view(">u8").ravel().astype(np.uint64)

    return number(planes[:key_bytes]), number(planes[key_bytes:])


def _sorted_marks(parcels: list[bytes], key_bytes: int, more_bytes: int) -> list[bytes]:
    """Sort the entries of one bucket and mark them: SETTLED when an entry occurs again, ASKS when its key
    has several entries and this one is the first of its kind."""
    pairs = [_unpacked(p, key_bytes, more_bytes) for p in parcels]
    key = np.concatenate([k for k, _ in pairs])
    more = np.concatenate([m for _, m in pairs])
    often = (more & np.uint64(1)).astype(bool)
    more = more >> np.uint64(1)
    order = _in_order(key, more)  # stable, so earlier chunks stay first
    key, more, often = key[order], more[order], often[order]
    new_key = np.diff(key, prepend=key[:1] + np.uint64(1)) != 0
    new = new_key | (np.diff(more, prepend=more[:1]) != 0)
    group, family = np.cumsum(new) - 1, np.cumsum(new_key) - 1
    settled = (np.bincount(group) > 1) | (np.bincount(group, weights=often) > 0)
    several = np.bincount(family[new]) > 1
    marks = np.where(settled[group], SETTLED, 0) | np.where(new & several[family], ASKS, 0)
    out = np.empty(len(order), np.uint8)
    out[order] = marks
    cuts = np.cumsum([len(k) for k, _ in pairs])[:-1]
    return [x.tobytes() for x in np.split(out, cuts)]


def _sorted_buckets(parcels: DataFrame, key_bytes: int, more_bytes: int) -> DataFrame:
    """(chunk, marks): for each chunk the marks of its entries by bucket, each bucket sorted by itself."""

    def sort(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, chunks, held = None, [], []

        def done() -> pa.RecordBatch:
            marks = _sorted_marks(held, key_bytes, more_bytes)
            columns = [
                pa.array(chunks, pa.int64()), pa.array([current] * len(chunks), pa.int64()), pa.array(marks, pa.binary())
            ]
            return pa.RecordBatch.from_arrays(columns, ["chunk", "bucket", "marks"])

        for part in parts:
            for bucket, chunk, parcel in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                if bucket != current and held:
                    yield done()
                    chunks, held = [], []
                current = bucket
                chunks.append(chunk)
                held.append(parcel)
        if held:
            yield done()

    tasks = int(parcels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        parcels.repartition(tasks, "bucket")
        .sortWithinPartitions("bucket", "chunk")
        .mapInArrow(sort, "chunk long, bucket long, marks binary")
        .groupBy("chunk")
        .agg(F.collect_list(F.struct("bucket", "marks")).alias("marks"))
    )


def _parcels(chunk: int, entries: Entries) -> pa.RecordBatch | None:
    rows = list(entries.parcels())
    if not rows:
        return None
    columns = [
        pa.array([b for b, _ in rows], pa.int64()), pa.array([chunk] * len(rows), pa.int64()),
        pa.array([p for _, p in rows], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "chunk", "entries"])


_PARCELS = "bucket long, chunk long, entries binary"


def _found(row: dict, name: str) -> dict[int, bytes]:
    return {x["bucket"]: x["marks"] for x in row[name].as_py() or []}


# ---- the operator -----------------------------------------------------------------


@contextmanager
def _shuffles_given_back(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a job inside are deleted when it ends; what it wrote is in the shared folder."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _sample_entries(chunk: Chunk, buckets: int) -> Entries:
    return Entries(*chunk.samples(), buckets, 6, 8)


def _string_entries(chunk: Chunk, starts: np.ndarray, buckets: int) -> Entries:
    first, second = fingerprints(chunk.data, starts, starts + chunk.width)
    return Entries(first, second >> np.uint64(32), buckets, 8, 4)


def without_repeats(
    docs: DataFrame, width: int = WIDTH, id_column: str = "doc_id", text_column: str = "text",
    chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """(<id>, n_bytes, spans, kept): texts without the bytes of strings of `width` bytes that start twice or more.

    Texts are UTF-8 bytes; a string never crosses texts. A byte goes when any string of `width` bytes
    that covers it also starts anywhere else, in the same text (overlapping or not) or in another;
    strings are judged on the input. `spans` has the maximal removed runs as (start, stop) in rising
    order, `kept` the other bytes joined, which need not be whole characters. One row for each row of
    `docs`: a null text counts as empty, repeated rows as texts of their own (their strings repeat), and a
    null id is kept. Texts shorter than `width` stay whole. An empty table gives no rows; further columns play no part.
    Runs jobs when called, and writes the texts, compressed, and marks of the chunks to the shared folder.
    """
    if width < 1:
        raise ValueError("width must be at least 1")
    spark = docs.sparkSession
    id_field = docs.select(F.col(f"`{id_column}`").alias("id")).schema["id"]
    id_type, id_ddl = pa_type(id_field.dataType), id_field.dataType.simpleString()

    with _shuffles_given_back(spark):
        source = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))
        chunks = staged(
            source.mapInArrow(
                lambda parts: _packed(parts, chunk_bytes, id_type),
                f"chunk long, ids array<{id_ddl}>, sizes array<long>, data binary",
            ),
            "chunks",
        )
        n_bytes = chunks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
        modulus, residues = cover_for(width)
        at_least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        sample_buckets = max(at_least, math.ceil(n_bytes * len(residues) / modulus * SAMPLE_ENTRY / bucket_bytes))

        def sampled(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                for row, chunk in _chunks_of(part, width):
                    parcels = _parcels(row["chunk"].as_py(), _sample_entries(chunk, sample_buckets))
                    if parcels:
                        yield parcels

        ranked = staged(
            _sorted_buckets(chunks.select("chunk", "sizes", "data").mapInArrow(sampled, _PARCELS), 6, 8), "ranks"
        )
        known = chunks.join(ranked.withColumnRenamed("marks", "ranks"), "chunk", "left")

        def settle(row: dict, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
            """The suffixes whose hull is repeated, and the starts that are sent by themselves."""
            entries = _sample_entries(chunk, sample_buckets)
            marks = entries.marks(_found(row, "ranks"))
            settled = (marks & SETTLED).astype(bool)[entries.entry_of]
            return settled, chunk.starts_of(entries.first_of[(marks & ASKS).astype(bool)])

        # At most as many strings are sent as there are bytes; how many is known only once they are.
        string_buckets = max(at_least, math.ceil(n_bytes * STRING_ENTRY / 8 / bucket_bytes))

        def asked(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                for row, chunk in _chunks_of(part, width):
                    _, starts = settle(row, chunk)
                    parcels = _parcels(row["chunk"].as_py(), _string_entries(chunk, starts, string_buckets))
                    if parcels:
                        yield parcels

        answered = staged(
            _sorted_buckets(known.select("chunk", "sizes", "data", "ranks").mapInArrow(asked, _PARCELS), 8, 4), "strings"
        )

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row, chunk in _chunks_of(part, width):
                settled, starts = settle(row, chunk)
                entries = _string_entries(chunk, starts, string_buckets)
                again = (entries.marks(_found(row, "answers")) & SETTLED).astype(bool)[entries.entry_of]
                single = starts[again]
                spans, kept = chunk.without(
                    np.concatenate([chunk.first[settled], single]),
                    # A hull without a whole string covers nothing.
                    np.concatenate([_stops(chunk, settled), single + width]),
                )
                columns = [row["ids"].values, row["sizes"].values, spans, kept]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "spans", "kept"])

    whole = known.join(answered.withColumnRenamed("marks", "answers"), "chunk", "left")
    return whole.mapInArrow(
        cut, f"id {id_ddl}, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary"
    ).withColumnRenamed("id", id_column)


def _stops(chunk: Chunk, suffixes: np.ndarray) -> np.ndarray:
    last = chunk.last[suffixes]
    return np.where(last >= chunk.first[suffixes], last + chunk.width, 0)


ORACLE = """
WITH texts AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
strings AS (
  SELECT r, i, sha256(substr(h, 2 * i + 1, 800)) AS s FROM (SELECT r, h, unnest(range(n - 399)) AS i FROM texts WHERE n >= 400)),
starts AS (
  SELECT unnest(places, recursive := true) FROM (
    SELECT list({'r': r, 'i': i}) AS places FROM strings GROUP BY s HAVING count(*) > 1)),
stretches AS (
  SELECT r, i, sum(CASE WHEN i <= before + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS stretch
  FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM starts)),
spans AS (SELECT r, min(i) AS a, max(i) + 400 AS b FROM stretches GROUP BY r, stretch),
cuts AS (
  SELECT r, a, b FROM spans UNION ALL SELECT r, n, n FROM texts),
pieces AS (
  SELECT r, a, b, substr(h, 2 * done + 1, 2 * (a - done)) AS piece FROM (
    SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a, b), 0) AS done FROM cuts) JOIN texts USING (r))
SELECT doc_id, n AS n_bytes, sum(b - a)::BIGINT AS n_removed, count(*) - 1 AS n_spans,
  sha256(unhex(coalesce(string_agg(piece, '' ORDER BY a, b), ''))) AS kept_sha256
FROM pieces JOIN texts USING (r) GROUP BY r, doc_id, n
"""
