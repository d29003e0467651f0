"""Language of a text by string kernels: blended-spectrum presence kernel, Nystrom, kernel ridge.

A text is the set of its character n-grams of all lengths up to ORDERS, hashed into BUCKETS. The
kernel of two texts is the number of n-grams that both have, over the root of the product of
their numbers. Landmarks are a bounded sample of labelled rows, evenly over languages; a text's
features are its kernel values with them, whitened (Nystrom). One ridge regression per language
against the rest gives its scores. As they are linear in the presence vector, landmarks, whitening
and weights are multiplied into one matrix once, and batches of texts are scored by one product
with it.

Results, per row: `lang_pred` `und` and score 0 for a null text, a text without a letter, or where
there was nothing to learn from. Otherwise the language with the best score, the first in
alphabetical order among equals; `score` is its regression value, mapped from -1..1 to 0..1. Rows
keep their doc_id, null and repeated ones too. Whole texts are read, in pieces of bounded size.
Languages, sources and ids play no part in a prediction.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pantryline.llm.common import LETTER, batches, relieve, small_batches

ORDERS = 3
BUCKETS = 1 << 15
#: The sample: so many rows and landmarks per language at most, and in all; but one of each language at least.
ROWS_PER_LANGUAGE, LANDMARKS_PER_LANGUAGE = 500, 100
SAMPLE_ROWS, LANDMARKS = 4000, 512
RIDGE = 1e-3
UNKNOWN = "und"
PIECE, BATCH = 1 << 18, 64


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def presence(text: str) -> np.ndarray:
    """The text's n-grams as a bit per bucket. What is no letter is a space, one at a time."""
    bits = np.zeros(BUCKETS, bool)
    codes = np.zeros(1, np.uint32)
    for at in range(0, len(text), PIECE):
        new = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[new]
        new = np.where(letter, new, 32)
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[0] |= codes[-1] != 32
        codes = np.concatenate([codes[-(ORDERS - 1) :], new[keep]])  # n-grams across the cut as well
        key = np.zeros(len(codes), np.uint32)
        for n in range(1, ORDERS + 1):
            key = key[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :] + np.uint32(n)
            mixed = (key ^ (key >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            bits[(mixed ^ (mixed >> np.uint32(16))) & np.uint32(BUCKETS - 1)] = True
    return bits


@dataclass(frozen=True)
class Model:
    """Languages, and the folded matrix: buckets by languages."""

    languages: list[str]
    weights: np.ndarray

    def scores(self, ones: list[np.ndarray]) -> np.ndarray:
        """Regression values of a batch of texts, each given by the places of its ones (at least one).

        The product of the sparse presence matrix and the weights: rows are summed up text by text.
        """
        sizes = np.array([len(x) for x in ones])
        starts = np.cumsum(sizes) - sizes
        return np.add.reduceat(self.weights[np.concatenate(ones)], starts) / np.sqrt(sizes)[:, None]


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Normalised presence kernel between the rows of two bit matrices, in blocks of rows."""
    a_norm, b_norm = (np.sqrt(np.maximum(x.sum(axis=1), 1)) for x in (a, b))
    right = b.astype(np.float32).T
    both = [a[i : i + 256].astype(np.float32) @ right for i in range(0, len(a), 256)]
    return np.concatenate(both).astype(np.float64) / a_norm[:, None] / b_norm[None, :]


def fit(labels: list[str], bits: np.ndarray, landmarks: int = LANDMARKS_PER_LANGUAGE, ridge: float = RIDGE) -> Model:
    """Fit on labelled presence vectors; the first `landmarks` of each language are the landmarks."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32))
    of = np.array([languages.index(x) for x in labels])
    landmarks = max(1, min(landmarks, LANDMARKS // len(languages)))
    chosen = np.concatenate([np.nonzero(of == k)[0][:landmarks] for k in range(len(languages))])
    marks = bits[chosen]
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    good = values > 1e-6 * values[-1]
    whiten = vectors[:, good] / np.sqrt(values[good])
    features = kernel(bits, marks) @ whiten
    target = np.where(of[:, None] == np.arange(len(languages)), 1.0, -1.0)
    # Every language weighs the same, however many rows it has.
    weight = (1 / np.bincount(of, minlength=len(languages)))[of][:, None]
    gram = features.T @ (features * weight) + ridge * np.eye(features.shape[1])
    dual = whiten @ np.linalg.solve(gram, features.T @ (target * weight))
    norm = np.sqrt(np.maximum(marks.sum(axis=1), 1))[:, None]
    return Model(languages, (marks.astype(np.float32).T @ (dual / norm).astype(np.float32)))


def learn(
    rows: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, landmarks: int = LANDMARKS_PER_LANGUAGE
) -> Model:
    """Fit on a bounded sample of the rows (doc_id, text, lang) that have a language and a letter.

    Every language that occurs is learned, however rare. The driver receives SAMPLE_ROWS bit vectors of
    BUCKETS / 8 bytes at most, or one a language if there are more languages.
    """
    lettered = F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    draw = F.pmod(F.xxhash64(F.lit("draw"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    known = rows.filter(lettered).select("doc_id", "text", "lang", draw.alias("draw"))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("draw").alias("least")).collect()
    if not counts:
        return fit([], np.zeros((0, BUCKETS), bool))
    rows_per_language = max(1, min(rows_per_language, SAMPLE_ROWS // len(counts)))
    # The row that is drawn first is in, whatever the share.
    bound = {c["lang"]: max(c["least"], 1.5 * rows_per_language / c["n"]) for c in counts}
    share = F.create_map(*[F.lit(x) for pair in sorted(bound.items()) for x in pair])

    def packed(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in parts:
            for doc_id, text, lang in zip(*part.columns, strict=True):
                if LETTER.search(text.as_py()):
                    yield doc_id.as_py(), lang.as_py(), np.packbits(presence(text.as_py())).tobytes()

    drawn = known.filter(F.col("draw") <= share[F.col("lang")]).select("doc_id", "text", "lang").mapInArrow(
        lambda parts: batches(packed(parts), ["doc_id", "lang", "bits"], [pa.int64(), pa.string(), pa.binary()], 128),
        "doc_id long, lang string, bits binary",
    )
    key = F.xxhash64(F.lit("sample"), "doc_id")
    first = F.row_number().over(Window.partitionBy("lang").orderBy(key, "doc_id", "bits"))
    sample = drawn.withColumn("place", first).filter(F.col("place") <= rows_per_language).collect()
    sample.sort(key=lambda r: (r["place"], r["lang"]))
    bits = np.array([np.unpackbits(np.frombuffer(r["bits"], np.uint8)) for r in sample], bool).reshape(-1, BUCKETS)
    return fit([r["lang"] for r in sample], bits, landmarks)


def identify(batch_texts: list[str | None], model: Model) -> list[tuple[str, float]]:
    """(language, score) of each text."""
    out = [(UNKNOWN, 0.0)] * len(batch_texts)
    at = [i for i, t in enumerate(batch_texts) if model.languages and t and LETTER.search(t)]
    for k in range(0, len(at), BATCH):
        some = at[k : k + BATCH]
        scores = model.scores([np.flatnonzero(presence(batch_texts[i])) for i in some])
        best = scores.argmax(axis=1)
        for i, b, s in zip(some, best, scores[np.arange(len(some)), best], strict=True):
            out[i] = model.languages[b], float(min(1.0, max(0.0, (s + 1) / 2)))
    return out


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, lang_pred, score. A narrow pass; the model's size is bounded by its languages."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in parts:
            for at in range(0, part.num_rows, BATCH):
                some = part.slice(at, BATCH)
                for doc_id, found in zip(some.column(0).to_pylist(), identify(some.column(1).to_pylist(), shared.value), strict=True):
                    yield doc_id, *found

    names, types = ["doc_id", "lang_pred", "score"], [pa.int64(), pa.string(), pa.float64()]
    return docs.select("doc_id", "text").mapInArrow(
        lambda parts: batches(rows(parts), names, types), "doc_id long, lang_pred string, score double"
    )


def accepted(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of `docs`, all columns, whose language is known with a score of at least `least`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, BATCH):
                some = part.slice(at, BATCH)
                found = identify(some.column(place).to_pylist(), shared.value)
                yield some.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_()))
        relieve()

    return small_batches(docs).mapInArrow(rows, docs.schema)
