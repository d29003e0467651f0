"""Toxicity of whole texts: a logistic classifier, regularised by counterfactual texts.

Keys are a text's words and the beginnings of its words; a key has a feature per level of the share
of the words that it covers, so a few words in a long text don't count like a text full of them.
The keys that go with the label are chosen by their chi-square over the sample. Training rows that
name a group of people get a counterfactual: the same text with the groups' names swapped.
Besides the loss on labels, the fit pays for every change of the score between the two, so that a
mere mention carries no weight.

Results, per row: score in 0..1 and predicted (1 from 0.5 on). A null or empty text has the score of
a text without any feature; so has any text where no row could be learned from, then 0. Rows keep
their doc_id, null and repeated ones too. Labels, languages, sources and ids play no part in a
score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pantryline.llm.common import batches, bounded_sample, filtered, relieve, small_batches, staged

#: The sample: at most so many labelled rows of each class; and the most features chosen.
TOXIC_ROWS, OTHER_ROWS, FEATURES = 2000, 5000, 2000
#: A feature must occur in so many toxic rows, with a chi-square of at least this.
LEAST_ROWS, LEAST_CHI = 3, 12.0
LEVELS = (0.0, 0.004, 0.008, 0.016)
BEGINNINGS = range(3, 9)
#: Weights of the counterfactual penalty and of the plain one, and steps of the fit.
COUNTERFACTUAL, RIDGE, STEPS = 1.0, 1e-3, 400
#: Entries held at most per worker of the word cache, which is that of one model; a full one is emptied.
WORD_CACHE = 150_000
#: Counted features that a task holds; sums are added up later, so a full table is sent and begun anew.
COUNTED = 50_000
WORD = re.compile(r"[^\W\d_]+")

#: Names of groups of people, kind by kind; each is swapped for the next of its kind.
IDENTITIES = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"), ("femmes", "hommes"),
    ("frauen", "männer"), ("mujeres", "hombres"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "bisexual", "transgender", "straight"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("immigrants", "refugees", "foreigners", "locals"),
    ("disabled", "deaf", "blind", "autistic"), ("old", "young", "elderly"),
    ("mexican", "american", "chinese", "african", "european", "arab", "indian"),
)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def keys_of(word: str) -> list[int]:
    """Hashes of a word and of its beginnings."""
    names = ["=" + word, *["^" + word[:n] for n in BEGINNINGS if len(word) > n]]
    return [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in names]


def swapped(words: list[str], identities=IDENTITIES) -> list[str] | None:
    """The words with every group's name replaced by the next of its kind; None if they name none."""
    turn = {a: b for kind in identities for a, b in zip(kind, kind[1:] + kind[:1], strict=True)}
    return [turn.get(w, w) for w in words] if not turn.keys().isdisjoint(words) else None


def levels_of(words: list[str]) -> set[tuple[int, int]]:
    """(key, level) of every feature that the words have."""
    counts: Counter[int] = Counter()
    for word, n in Counter(words).items():
        for key in keys_of(word):
            counts[key] += n
    total = len(words)
    return {(k, j) for k, n in counts.items() for j, level in enumerate(LEVELS) if n >= level * total}


#: Of the model last used in this process: places of the chosen keys by word.
_CACHE: dict[str, object] = {"model": None, "words": {}}


@dataclass
class Model:
    """Intercept, and for each chosen key a weight per level."""

    bias: float
    keys: dict[int, int]
    weights: np.ndarray

    def places(self, word: str) -> bytes:
        """Places of the chosen keys that a word has."""
        if _CACHE["model"] is not self:
            _CACHE.update(model=self, words={})
        words = _CACHE["words"]
        known = words.get(word)
        if known is None:
            if len(words) >= WORD_CACHE:
                words.clear()
            known = np.array([self.keys[k] for k in keys_of(word) if k in self.keys], np.int32).tobytes()
            words[word] = known
        return known

    def score(self, text: str | None) -> float:
        words = words_of(text)
        at = np.frombuffer(b"".join([self.places(w) for w in words]), np.int32)
        total = self.bias
        if len(at):
            at, counts = np.unique(at, return_counts=True)
            has = counts[:, None] >= np.array(LEVELS) * len(words)
            total += float((self.weights[at] * has).sum())
        return float(1 / (1 + np.exp(-np.clip(total, -40, 40))))


def solve(
    x: np.ndarray, y: np.ndarray, change: np.ndarray, counterfactual: float = COUNTERFACTUAL, ridge: float = RIDGE,
    steps: int = STEPS,
) -> tuple[np.ndarray, float]:
    """Weights and intercept: log loss, plus the mean square of `change` (counterfactual less original) @ weights."""
    n, pull = len(y), counterfactual / max(1, len(change))
    weight = np.where(y == 1, np.sqrt(max(1, (y == 0).sum()) / max(1, (y == 1).sum())), 1.0) / n
    def norm(m: np.ndarray) -> float:
        """Largest singular value, by a few steps of power iteration and some slack."""
        if not m.size:
            return 0.0
        v = np.ones(m.shape[1], np.float32)
        for _ in range(30):
            v = m.T @ (m @ (v / (np.linalg.norm(v) or 1.0)))
        return 1.1 * float(np.sqrt(np.linalg.norm(v)))
    rate = 1 / (0.25 * weight.max() * (norm(x) ** 2 + n) + pull * norm(change) ** 2 + ridge)
    w, b = np.zeros(x.shape[1]), float(np.log(max(y.mean(), 1e-3) / max(1 - y.mean(), 1e-3))) if n else 0.0
    last_w, last_b = w, b
    for step in range(steps if n else 0):  # accelerated gradient descent
        near_w, near_b = w + step / (step + 3) * (w - last_w), b + step / (step + 3) * (b - last_b)
        error = (1 / (1 + np.exp(-np.clip(x @ near_w.astype(np.float32) + near_b, -40, 40))) - y) * weight
        slope = x.T @ error.astype(np.float32) + ridge * near_w
        if len(change):
            slope = slope + pull * (change.T @ (change @ near_w.astype(np.float32)))
        last_w, last_b = w, b
        w, b = near_w - rate * slope, near_b - rate * error.sum()
    return w, b


def learn(
    docs: DataFrame, labelled: DataFrame, toxic_rows: int = TOXIC_ROWS, other_rows: int = OTHER_ROWS,
    features: int = FEATURES, counterfactual: float = COUNTERFACTUAL, identities=IDENTITIES,
) -> Model:
    """Fit on a bounded sample of `labelled` (doc_id, toxic 0 or 1), whose texts are in `docs`.

    `identities` are kinds of names in lower case, each a tuple as in IDENTITIES. The sample's ids are
    chosen first, so only its rows leave the scan. The driver receives the chosen
    features and the sample's rows as bits. Runs jobs when called.
    """
    rows = labelled.select("doc_id", "toxic").filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).distinct()
    ids = staged(
        bounded_sample(rows.filter("toxic = 1"), "doc_id", toxic_rows).unionByName(
            bounded_sample(rows.filter("toxic = 0"), "doc_id", other_rows)
        ),
        "sample-ids",
    )
    # At most toxic_rows + other_rows rows.
    sample = staged(small_batches(docs).select("doc_id", "text").join(F.broadcast(ids), "doc_id"), "sample")

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        seen: dict[tuple[int, int], list[int]] = {}
        for part in parts:
            for text, toxic in zip(part.column(0), part.column(1).to_pylist(), strict=True):
                for feature in levels_of(words_of(text.as_py())):
                    seen.setdefault(feature, [0, 0])[toxic] += 1
                if len(seen) >= COUNTED:
                    yield from ((*feature, *n) for feature, n in seen.items())
                    seen.clear()
        yield from ((*feature, *n) for feature, n in seen.items())
        seen.clear()
        relieve()

    totals = sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()
    n = {r["toxic"]: r["n"] for r in totals}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return Model(-40.0, {}, np.zeros((0, len(LEVELS))))
    table = sample.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(
        lambda parts: batches(counted(parts), ["key", "level", "other", "toxic"], [pa.int64(), pa.int32(), pa.int64(), pa.int64()], 20000),
        "key long, level int, other long, toxic long",
    )
    a, b = F.col("toxic"), F.col("other")
    chi = (n0 + n1) * F.pow(a * (n0 - b) - b * (n1 - a), 2) / ((a + b) * (n1 - a + n0 - b) * F.lit(float(n0)) * n1)
    chosen = (
        table.groupBy("key", "level")
        .agg(F.sum("other").cast("double").alias("other"), F.sum("toxic").cast("double").alias("toxic"))
        .filter((a >= LEAST_ROWS) & (a * n0 > b * n1))
        .withColumn("chi", chi)
        .filter(F.col("chi") >= LEAST_CHI)
        .orderBy(F.desc("chi"), "key", "level")
        .limit(features)
        .collect()
    )
    place = {(r["key"], r["level"]): i for i, r in enumerate(chosen)}

    def bits(found: list[str]) -> bytes:
        out = np.zeros(len(place), bool)
        out[[place[f] for f in levels_of(found) if f in place]] = True
        return np.packbits(out).tobytes()

    def rows_of(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in parts:
            for text, toxic in zip(part.column(0), part.column(1).to_pylist(), strict=True):
                own = words_of(text.as_py())
                other = swapped(own, identities)
                yield toxic, bits(own), None if other is None else bits(other)

    collected = (
        sample.select("text", F.col("toxic").cast("int").alias("toxic"))
        .mapInArrow(
            lambda parts: batches(rows_of(parts), ["toxic", "own", "other"], [pa.int32(), pa.binary(), pa.binary()]),
            "toxic int, own binary, other binary",
        )
        .collect()
    )
    unpack = lambda data: np.unpackbits(np.frombuffer(data, np.uint8), count=len(place))
    matrix = lambda some: np.array(some, np.float32).reshape(-1, len(place))
    own = matrix([unpack(r["own"]) for r in collected])
    change = matrix([unpack(r["other"]).astype(np.int8) - unpack(r["own"]) for r in collected if r["other"] is not None])
    w, bias = solve(own, np.array([r["toxic"] for r in collected], np.float64), change, counterfactual)
    keys = {k: i for i, k in enumerate(dict.fromkeys(k for k, _ in place))}
    weights = np.zeros((len(keys), len(LEVELS)))
    for (key, level), i in place.items():
        weights[keys[key], level] = w[i]
    return Model(bias, keys, weights)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, score, predicted. A narrow pass; the model has at most FEATURES keys."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in parts:
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                score = shared.value.score(text.as_py())
                yield doc_id, score, int(score >= 0.5)
        _CACHE.update(model=None, words={})
        relieve()

    names, types = ["doc_id", "score", "predicted"], [pa.int64(), pa.float64(), pa.int32()]
    return small_batches(docs).select("doc_id", "text").mapInArrow(
        lambda parts: batches(rows(parts), names, types), "doc_id long, score double, predicted int"
    )


def accepted(docs: DataFrame, model: Model, below: float = 0.5) -> DataFrame:
    """The rows of `docs`, all columns, whose score is below a bound."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from filtered(parts, lambda some: [shared.value.score(t.as_py()) < below for t in some.column(place)])
        _CACHE.update(model=None, words={})
        relieve()

    return small_batches(docs).mapInArrow(rows, docs.schema)
