"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

A document's set holds the hashes of its distinct word shingles. Its sketch has a slot per bin:
in round i every element is thrown into a bin with a value, and a bin keeps the smallest
(round, value); rounds go on until all bins are filled, and from round `t` on each fills one
bin for certain. So small sets fill every slot too, and the share of equal slots of two sketches
is concentrated around their Jaccard similarity. Bands of slots put documents into buckets.

Links are found in two steps, so that no bucket is ever expanded into all its pairs:

1. Documents with equal words are one class. In each bucket the member that meets most others
   leads. Each class is held against the leader that it meets in most buckets, and linked if the
   full sets are similar. Links give components.
2. A bucket whose members are all in one component is settled. In any other, the members outside
   its largest component are held, in bounded blocks, against the members of other components:
   sketches first (a slot as a byte), full sets where these leave a chance. At first only the
   likeliest partner of each, then, with the components that this makes, every pair of different
   components that meets in a bucket, whatever the size of the bucket.

What banding and the sketch test lose at the threshold has a chance below 1e-6 a pair.

Results, per row: a text without words, or null, has an empty set and is linked with nothing. A
null doc_id can't be named: it has no component and is kept. Rows that share a doc_id are one
node. Equal texts take the smallest doc_id. Other columns play no part.
"""

from __future__ import annotations

import functools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from pantryline.llm.common import batches, staged

WORDS = 4
THRESHOLD = 0.8
BANDS, ROWS = 40, 5
#: Sketches that agree in less of their slots are not verified: six standard deviations below the threshold.
SKETCH_FLOOR = 0.63
#: About the largest sides of a block, and groups over which a leader's followers are spread.
BLOCK_LEADERS, BLOCK_MEMBERS, SALTS = 512, 4096, 256
#: Entries held at most per worker of the word cache; a full one is emptied.
WORD_CACHE = 150_000

P1 = np.uint64(0x9E3779B97F4A7C15)
P2 = np.uint64(0xBF58476D1CE4E5B9)
P3 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * P2
    x = (x ^ (x >> np.uint64(27))) * P3
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


@functools.cache
def _word_hashes() -> _WordHashes:
    return _WordHashes()


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return text.encode().lower().split() if text else []


def shingle_set(words: list[bytes], size: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; of the whole sequence, if it is shorter than one."""
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.frombuffer(array("Q", map(_word_hashes().__getitem__, words)), np.uint64)
    n = max(1, len(hashes) - size + 1)
    out = np.full(n, np.uint64(min(size, len(hashes))), np.uint64)
    for i in range(min(size, len(hashes))):
        out = out * P1 + hashes[i : i + n]
    return np.unique(mix(out))


@functools.cache
def _rounds(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Per round: the seed of its hash, and the round as the high bits of a value."""
    i = np.arange(2 * bins, dtype=np.uint64)
    return ((i + np.uint64(1)) * P1)[:, None], (i << np.uint64(46))[:, None]


def sketch(elements: np.ndarray, bins: int) -> np.ndarray:
    """One value per bin (256 bins at most) for a non-empty set of 64-bit hashes."""
    seeds, ranks = _rounds(bins)
    out = np.zeros(bins, np.uint64)
    filled = np.zeros(bins, bool)
    # So many rounds at a time that most sketches are done after the first.
    done, at_once = 0, min(bins, int(bins * (np.log(bins) + 3) / len(elements)) + 1)
    while True:
        stop = min(done + at_once, 2 * bins)
        z = mix(elements ^ seeds[done:stop])
        where = ((z >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
        if stop > bins:  # the sure rounds: all elements into one bin
            sure = max(done, bins)
            where[sure - done :] = np.arange(sure - bins, stop - bins, dtype=np.uint64)[:, None]
        value = ranks[done:stop] | (z * P3) >> np.uint64(18)
        found = np.sort((where << np.uint64(56) | value).ravel())
        place = found >> np.uint64(56)
        first = np.concatenate([[True], place[1:] != place[:-1]])
        place, found = place[first].astype(np.int64), found[first] & np.uint64((1 << 56) - 1)
        if not done and len(place) == bins:
            return found
        new = ~filled[place]
        out[place[new]] = found[new]
        filled[place] = True
        if filled.all():
            return out
        done = stop


def band_keys(slots: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key per band, different for equal slots in different bands."""
    key = np.arange(1, bands + 1, dtype=np.uint64) * P2
    for column in slots[: bands * rows].reshape(bands, rows).T:
        key = mix(key * P1 + column)
    return key


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """Per row: doc_id, n (set size), k1 and k2 (a hash of its words), bands, slots (a byte each)."""

    def signed(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in parts:
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                own = words_of(text.as_py())
                elements = shingle_set(own, words)
                if not len(elements):
                    yield doc_id, 0, 0, 0, None, None
                    continue
                whole = xxhash.xxh3_128_digest(b" ".join(own))
                k1, k2 = np.frombuffer(whole, np.int64).tolist()
                if doc_id is None:
                    yield None, len(elements), k1, k2, None, None
                    continue
                slots = sketch(elements, bands * rows)
                keys = band_keys(slots, bands, rows).view(np.int64)
                yield doc_id, len(elements), k1, k2, keys, (slots & np.uint64(255)).astype(np.uint8).tobytes()
        _word_hashes().clear()  # the worker goes on with other tasks

    names = ["doc_id", "n", "k1", "k2", "bands", "slots"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
    return docs.select("doc_id", "text").mapInArrow(
        lambda parts: batches(signed(parts), names, types),
        "doc_id long, n long, k1 long, k2 long, bands array<long>, slots binary",
    )


CELL = ["key", "block", "salt"]


def verified(tests: DataFrame, docs: DataFrame, words: int, threshold: float) -> DataFrame:
    """(a, b): links between components, by comparing full sets as whole numbers.

    `tests` has cells (key, block, salt) with rows (id, component, targets): leaders without targets,
    BLOCK_LEADERS of them at most, and followers with the leaders that each is tested against. Sets are
    computed for these documents only, and sent once to each cell, where leaders are held and
    followers stream past. Components that a link in the cell has joined are not tested again.
    """
    percent = round(100 * threshold)

    def sets(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in parts:
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                elements = shingle_set(words_of(text.as_py()), words)
                if len(elements):
                    yield doc_id, elements.tobytes()
        _word_hashes().clear()

    wanted = staged(tests.select(F.col("id").alias("doc_id")).distinct(), "wanted")
    full = staged(
        docs.select("doc_id", "text")
        .join(wanted, "doc_id", "left_semi")
        .mapInArrow(lambda parts: batches(sets(parts), ["id", "elements"], [pa.int64(), pa.binary()], 512), "id long, elements binary"),
        "sets",
    )
    lined_up = (
        tests.join(full, "id")
        .withColumn("follows", F.col("targets").isNotNull())
        .repartition(*CELL)
        .sortWithinPartitions(*CELL, "follows", "id")
        .select(*CELL, "id", "component", "targets", "elements")
    )

    def similar(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        current, held, joined = None, {}, {}

        def root(x: int) -> int:
            while (up := joined.get(x, x)) != x:
                x = up
            return x

        for part in parts:
            for key, block, salt, one, component, targets, elements in zip(*part.columns, strict=True):
                cell, one, component = (key.as_py(), block.as_py(), salt.as_py()), one.as_py(), component.as_py()
                if cell != current:
                    current, held, joined = cell, {}, {}
                some = np.frombuffer(elements.as_py(), np.uint64)
                if not targets.is_valid:
                    held.setdefault(one, (component, []))[1].append(some)
                    continue
                for target in targets.as_py():
                    other, others = held[target]
                    if root(component) != root(other) and any(alike(some, x, percent) for x in others):
                        joined[root(component)] = root(other)
                        yield target, one

    return staged(
        lined_up.mapInArrow(lambda parts: batches(similar(parts), ["a", "b"], [pa.int64(), pa.int64()]), "a long, b long"),
        "links",
    )


def alike(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union for two sorted sets."""
    small, large = (one, other) if len(one) <= len(other) else (other, one)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(small) + len(large) - both)


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in a link.

    Every id takes the least label of itself and its neighbours, then the label of its label, until
    nothing changes. Each step is written, so lineage stays short and lost executors cost one step.
    """
    edges = staged(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges"
    )
    labels = staged(
        edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least")).select("id", F.least("id", "least").alias("component")),
        "labels",
    )
    while True:
        near = (
            edges.join(labels.select(F.col("id").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("component").alias("least"))
        )
        lowered = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "least").alias("via"))
        further = labels.select(F.col("id").alias("via"), F.col("component").alias("further"))
        stepped = staged(
            lowered.join(further, "via").select("id", "old", F.least("via", "further").alias("component")), "labels"
        )
        labels = stepped.select("id", "component")
        if stepped.filter(F.col("old") != F.col("component")).isEmpty():
            return labels


def _first_tests(members: DataFrame) -> DataFrame:
    """Tests of each class against the leader that it meets in most buckets."""
    degrees = members.groupBy("id").agg(F.sum("size").alias("degree"))
    rank = F.struct("degree", (-F.col("id")).alias("low"))
    leaders = members.join(degrees, "id").groupBy("key").agg(F.max(rank).alias("top"))
    leaders = leaders.select("key", (-F.col("top.low")).alias("leader"), F.col("top.degree").alias("degree"))
    met = members.join(leaders, "key").filter(F.col("id") != F.col("leader"))
    best = F.max(F.struct(F.col("times"), F.col("degree"), (-F.col("leader")).alias("low"))).alias("best")
    led = (
        met.groupBy("id", "leader")
        .agg(F.count(F.lit(1)).alias("times"), F.max("degree").alias("degree"))
        .groupBy("id")
        .agg(best)
        .select((-F.col("best.low")).alias("leader"), "id")
    )
    cell = [F.col("leader").alias("key"), F.lit(0).cast("long").alias("block"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")]
    followers = led.select(*cell, "id", F.col("id").alias("component"), F.array("leader").alias("targets"))
    leaders = led.select(*cell, F.col("leader").alias("id")).distinct()
    return followers.unionByName(
        leaders.withColumns({"component": F.col("id"), "targets": F.lit(None).cast("array<long>")})
    )


def _open_tests(members: DataFrame, found: DataFrame, sketches: DataFrame, threshold: float, best: bool) -> DataFrame:
    """Tests of pairs of different components that share a bucket, as far as sketches leave a chance.

    A pair is tested in the first bucket that it shares. With `best` only the likeliest partner of
    each member in each cell is: most that belong together are found so, with few tests.
    """
    labelled = members.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = (
        labelled.groupBy("key")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .filter("low < high")
        .select("key")
    )
    rest = staged(labelled.join(staged(mixed, "mixed"), "key"), "open")
    main = (
        rest.groupBy("key", "component")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("key")
        .agg(F.max(F.struct("n", "component")).alias("m"), F.sum("n").alias("all"))
        .select(
            "key", F.col("m.component").alias("main"),
            F.ceil((F.col("all") - F.col("m.n")) / BLOCK_LEADERS).alias("blocks"),
            F.ceil(F.col("all") / BLOCK_MEMBERS).alias("salts"),
        )
    )
    sketched = rest.join(staged(main, "main"), "key").join(sketches, "id")
    outside = F.col("component") != F.col("main")
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64(F.lit(n), "id"), F.col(n))
    columns = [*CELL, "follows", "id", "component", "outside", "n", "bands", "slots"]
    leaders = (
        sketched.filter(outside)
        .withColumns({"block": part("blocks"), "follows": F.lit(False), "outside": F.lit(True)})
        .withColumn("salt", numbers("salts"))
    )
    followers = sketched.withColumns({"salt": part("salts"), "follows": F.lit(True), "outside": outside}).withColumn(
        "block", numbers("blocks")
    )
    lined_up = (
        leaders.select(*columns)
        .unionByName(followers.select(*columns))
        .repartition(*CELL)
        .sortWithinPartitions(*CELL, "follows", "id")
    )

    def likely(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        current, own, held, top, used = None, [], None, {}, set()

        def closing() -> Iterator[tuple]:
            """What a cell leaves: followers of the likeliest, and the leaders that have followers."""
            chosen: dict[tuple, list[int]] = {}
            for a, (_, b) in top.items():
                chosen.setdefault(b, []).append(a)
            for (one, component), targets in chosen.items():
                yield *current, one, component, targets
            for one, component in {x[:2] for x in own if x[0] in used or x[0] in top}:
                yield *current, one, component, None

        for part in parts:
            rows = [part.column(i).to_pylist() for i in range(part.num_columns)]
            for key, block, salt, follows, one, component, out, n, bands, slots in zip(*rows, strict=True):
                if (key, block, salt) != current:
                    yield from closing()
                    current, own, held, top, used = (key, block, salt), [], None, {}, set()
                bands, slots = np.array(bands), np.frombuffer(slots, np.uint8)
                if not follows:
                    own.append((one, component, n, bands, slots))
                    continue
                if not own:
                    continue
                if held is None:
                    held = [np.array(x) for x in zip(*own, strict=True)]
                ids, components, sizes, keys, table = held
                at = np.minimum(sizes, n) >= threshold * np.maximum(sizes, n) - 1e-9
                at &= components != component
                if out:  # both are outside the largest component: they meet the other way round as well
                    at &= ids < one
                at = np.nonzero(at)[0]
                at = at[keys[at, (keys[at] == bands).argmax(axis=1)] == key]  # the first bucket they share
                same = (table[at] == slots).mean(axis=1)
                near = np.nonzero(same >= SKETCH_FLOOR)[0]
                targets = list(dict.fromkeys(ids[at[near]].tolist()))
                if targets and not best:
                    used.update(targets)
                    yield key, block, salt, one, component, targets
                for a, share in zip(ids[at[near]].tolist(), same[near].tolist(), strict=True) if best else ():
                    if a not in top or top[a][0] < share:
                        top[a] = share, (one, component)
        yield from closing()

    names = [*CELL, "id", "component", "targets"]
    types = [pa.int64()] * 5 + [pa.list_(pa.int64())]
    return lined_up.mapInArrow(
        lambda parts: batches(likely(parts), names, types),
        "key long, block long, salt long, id long, component long, targets array<long>",
    )


def near_duplicates(
    docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept.

    Runs jobs when called and writes what they hand on to the shared folder.
    """
    spark: SparkSession = docs.sparkSession
    signed = staged(signatures(docs, words, bands, rows), "signatures")
    linkable = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    classes = staged(
        signed.filter(linkable).groupBy("k1", "k2").agg(F.min("doc_id").alias("id")), "classes"
    )
    heads = (
        signed.join(classes, ["k1", "k2"])
        .filter(F.col("doc_id") == F.col("id"))
        .dropDuplicates(["k1", "k2"])  # rows alike in doc_id and words
    )
    spread = staged(heads.select("id", "n", F.explode("bands").alias("key")), "bands")
    shared = staged(spread.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "buckets")
    members = staged(spread.join(shared, "key"), "members")

    links = verified(staged(_first_tests(members), "tests"), docs, words, threshold)
    found = components(links)
    sketches = signed.filter(linkable).select(F.col("doc_id").alias("id"), "bands", "slots")
    for best in (True, False):
        tests = staged(_open_tests(members, found, sketches, threshold, best), "tests")
        if not tests.isEmpty():
            links = links.unionByName(verified(tests, docs, words, threshold))
            found = components(links)

    named = signed.filter(linkable).select("doc_id", "n", "k1", "k2").join(classes, ["k1", "k2"])
    placed = named.join(found, "id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")
    )
    alone = signed.filter(~linkable | F.col("doc_id").isNull()).select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")
    )
    return placed.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, all columns, that are kept: one of each component, and every row without a doc_id.

    Of rows that share a kept doc_id the one whose columns hash lowest stays.
    """
    found = near_duplicates(docs, words, threshold)
    lost = staged(found.filter(~F.col("kept")).select("doc_id").distinct(), "lost")
    again = staged(
        docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"),
        "repeated",
    )
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = docs.join(lost, "doc_id", "left_anti").select(*columns)
    whole = F.struct(*columns)
    order = F.struct(F.xxhash64("text"), F.xxhash64(*columns))
    single = (
        kept.join(again, "doc_id", "left_semi")
        .groupBy(F.col("doc_id").alias("__id"))
        .agg(F.min_by(whole, order).alias("__row"))
        .select("__row.*")
    )
    return kept.join(again, "doc_id", "left_anti").select(*columns).unionByName(single)


#: The same components from all pairs that share a shingle, for DuckDB.
ORACLE = r"""
WITH RECURSIVE listed AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM listed
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id
    JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a
)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id, d.doc_id = min(other) AS kept
FROM reached d LEFT JOIN sizes USING (doc_id) GROUP BY d.doc_id
"""
