"""Benchmark items contained in documents: size-partitioned MinHash search, exact verification.

Words are runs of letters and digits in lower case; a text's set holds its distinct five-word
shingles as 64-bit hashes, or the whole sequence of a shorter text. A document is sketched by
one-permutation MinHash: its hashes fall into bins by their leading bits, and each bin keeps the
smallest. The number of bins follows the document's size class (the next power of two), so that a
short item inside a very long document meets as dense a sketch as in a short one; how many bins
each element has follows the smallest item. Both are set so that an item that is contained has
fewer hits than asked for with a chance below 1e-6. Sketch elements meet the items' shingles by
equality; pairs with enough hits are verified on the full sets of their documents. An item shorter
than a shingle can't be sketched so: the documents' word sequences of just the lengths of such items
meet these by equality.

All of it is DataFrame functions. Results, per pair: doc_id, item_id, n_shingles of the item,
n_shared, containment. Null and empty texts are in no pair. An item shorter than a shingle is one
element, its whole sequence, and found wherever these words follow each other. Rows equal in doc_id and text, or in item_id and
text, count once; rows with a null doc_id are reported with null. Equal texts with different
item_ids are reported each, and so are different texts with one item_id. Other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pantryline.llm.common import staged

WORDS = 5
THRESHOLD = 0.8
#: Standard deviations, and the chance, that the search allows a contained item to be missed with.
DEVIATIONS, CHANCE_DIGITS = 4.75, 6


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def computed(rows: DataFrame, **columns: Column) -> DataFrame:
    """Add array columns that are computed once a row, however often they are used later.

    The optimizer would put the expression in place of each use, also within lambdas; it doesn't
    reach through a generator, here of one row.
    """
    for name, column in columns.items():
        rows = rows.select("*", F.explode(F.array(column)).alias(name))
    return rows


def shingled(rows: DataFrame, keys: list[str], words: int = WORDS) -> DataFrame:
    """keys, `n_words`, and `shingles`: the distinct hashes, ascending."""
    listed = computed(rows.filter(F.col("text").isNotNull()), words=word_list(F.col("text"))).select(*keys, "words")
    size = F.size("words")
    hashes = F.transform(
        F.sequence(F.lit(0), size - words),
        lambda i: F.xxhash64(*[F.get("words", i + F.lit(k)) for k in range(words)]),
    )
    short = F.array(F.xxhash64(F.array_join("words", " ")))
    distinct = F.sort_array(F.array_distinct(F.when(size >= words, hashes).otherwise(short)))
    return computed(listed.filter(size > 0), shingles=distinct).select(*keys, size.alias("n_words"), "shingles")


def _sequences(rows: DataFrame, keys: list[str], lengths: list[int]) -> DataFrame:
    """(keys, hash): the distinct sequences of so many words, few lengths below that of a shingle."""
    listed = computed(rows.filter(F.col("text").isNotNull()), words=word_list(F.col("text"))).select(*keys, "words")

    def of_length(n: int) -> Column:
        starts = F.when(F.size("words") >= n, F.sequence(F.lit(1), F.size("words") - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda at: F.xxhash64(F.array_join(F.slice("words", at, n), " ")))

    hashes = F.array_distinct(F.concat(*[of_length(n) for n in lengths]))
    return listed.select(*keys, F.explode(hashes).alias("hash"))


def _needed(n: Column, threshold: float) -> Column:
    """The fewest shared shingles of a contained item of `n`, in whole numbers."""
    return F.ceil(n * F.lit(round(100 * threshold)) / 100).cast("long")


def contained(
    docs: DataFrame, benchmark: DataFrame, words: int = WORDS, threshold: float = THRESHOLD
) -> DataFrame:
    """(doc_id, text_key, item_id, n_shingles, n_shared, containment) of all pairs that reach the threshold.

    `text_key` is a hash of the text, telling rows with the same doc_id apart. Runs jobs when called.
    """
    given = benchmark.select("item_id", "text", F.xxhash64("text").alias("item_key")).distinct()
    every = shingled(given, ["item_id", "item_key"], words).select(
        "item_id", "item_key", "n_words", F.size("shingles").alias("n_shingles"), F.explode("shingles").alias("hash")
    )
    every = staged(every.withColumn("needed", _needed(F.col("n_shingles"), threshold)), "items")
    items = every.filter(F.col("n_words") >= words).drop("n_words")
    short = every.filter(F.col("n_words") < words)
    lengths = [r["n_words"] for r in short.select("n_words").distinct().collect()]  # below `words`

    # Bits beyond the size class: with a load of 2^-bits elements a bin, a share of about 1 - load / 2
    # of the elements is the smallest of its bin, and all but that of the fewest shared ones may be lost.
    fewest = F.least(F.coalesce(F.min("needed"), F.lit(100)), F.lit(100)).cast("double")
    bits = F.greatest(F.lit(0), F.ceil(F.log2(0.5 * F.pow(F.lit(10.0), CHANCE_DIGITS / fewest)))).cast("int")
    extra = items.agg(bits.alias("bits")).scalar()
    load = F.pow(F.lit(2.0), -F.col("extra"))
    share = (1 - F.exp(-load)) / load

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    sets = shingled(keyed, ["doc_id", "text_key"], words).drop("n_words").withColumn("extra", extra)
    sets = sets.withColumn("shift", 64 - F.ceil(F.log2(F.size("shingles").cast("double"))).cast("int") - F.col("extra"))
    # Ascending hashes lie bin by bin, the smallest of each first.
    bin_of = lambda h: F.call_function("shiftrightunsigned", h, F.col("shift"))
    smallest = F.filter(
        "shingles", lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get("shingles", i - 1)))
    )
    sketched = sets.select("doc_id", "text_key", "extra", smallest.alias("sketch")).select(
        "doc_id", "text_key", "extra", F.explode("sketch").alias("hash")
    )
    expected = F.col("needed") * share
    enough = F.greatest(F.lit(1), F.floor(expected - DEVIATIONS * F.sqrt(expected * (1 - share))))
    candidates = staged(
        sketched.join(items, "hash")
        .groupBy("doc_id", "text_key", "item_id", "item_key", "needed", "extra")
        .agg(F.count(F.lit(1)).alias("hits"))
        .filter(F.col("hits") >= enough)
        .select("doc_id", "text_key"),
        "candidates",
    )

    # Exactly: full sets of the candidates' documents, once each. doc_id may be null on both sides.
    wanted = candidates.select("text_key", F.col("doc_id").alias("__id")).distinct()
    same = (keyed["text_key"] == wanted["text_key"]) & keyed["doc_id"].eqNullSafe(wanted["__id"])
    chosen = keyed.join(wanted, same, "left_semi").dropDuplicates(["doc_id", "text_key"])
    full = shingled(chosen, ["doc_id", "text_key"], words).select("doc_id", "text_key", F.explode("shingles").alias("hash"))
    of_pair = ["doc_id", "text_key", "item_id", "item_key", "n_shingles"]
    met = full.join(items.drop("needed"), "hash").groupBy(*of_pair).agg(F.count(F.lit(1)).alias("n_shared"))
    reached = met.filter(F.col("n_shared") >= _needed(F.col("n_shingles"), threshold)).drop("item_key")
    if lengths:
        met = _sequences(keyed, ["doc_id", "text_key"], lengths).join(short.select("item_id", "item_key", "hash"), "hash")
        one = F.lit(1).cast("long")
        found = met.select("doc_id", "text_key", "item_id", "item_key").distinct().drop("item_key")
        reached = reached.unionByName(
            found.select("doc_id", "text_key", "item_id", F.lit(1).alias("n_shingles"), one.alias("n_shared"))
        )
    return reached.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def clean_of(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, all columns, that contain no benchmark item."""
    found = staged(contained(docs, benchmark, words, threshold).select("doc_id", "text_key").distinct(), "contaminated")
    found = found.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    same = (F.xxhash64(docs["text"]) == found["__key"]) & docs["doc_id"].eqNullSafe(found["__id"])
    return docs.join(found, same, "left_anti")


#: The same pairs by comparing full sets, for DuckDB.
ORACLE = r"""
WITH listed AS (
    SELECT 'd' AS kind, doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
    FROM documents
    UNION ALL
    SELECT 'b', item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') FROM benchmark
), lengths AS (
    -- An item of fewer words than a shingle is one sequence; texts have the sequences of all such lengths.
    SELECT DISTINCT 'd' AS kind, least(len(w), 5) AS k FROM listed WHERE kind = 'b' AND len(w) > 0
), shingles AS (
    SELECT DISTINCT kind, id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s
    FROM (SELECT kind, id, w, least(len(w), 5) AS k FROM listed WHERE kind = 'b'
          UNION ALL SELECT kind, id, w, k FROM listed JOIN lengths USING (kind))
    WHERE len(w) >= k AND k > 0
), items AS (
    SELECT id AS item_id, k, s, count(*) OVER (PARTITION BY id) AS n FROM shingles WHERE kind = 'b'
)
SELECT d.id AS doc_id, item_id, n AS n_shingles, count(*) AS n_shared, count(*) / n AS containment
FROM shingles d JOIN items USING (k, s)
WHERE d.kind = 'd'
GROUP BY d.id, item_id, n
HAVING 100 * count(*) >= 80 * n
"""
