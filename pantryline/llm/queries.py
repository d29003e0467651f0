"""The registered queries: each operator over its whole table, and SQL where it can tell the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pantryline.llm import (
    bpe, centroids, decontaminate, langid, licenses, neardup, neighbours, repeats, sharding, tokenfile, toxicity, warc,
    whitening,
)
from pantryline.llm.common import crc_of_id, staged, table, work_dir


def ranges_of(spark: SparkSession) -> int:
    """As many ranges as the session makes shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _held_out(df: DataFrame, parts: int, part: int) -> DataFrame:
    return df.withColumn("held_out", F.coalesce(F.pmod(crc_of_id("doc_id"), F.lit(parts)) == part, F.lit(False)))


def learnable(df: DataFrame, parts: int, part: int) -> DataFrame:
    """The rows that a model may learn from: all that aren't held out by their ids."""
    return _held_out(df, parts, part).filter(~F.col("held_out")).drop("held_out")


def language_model(spark: SparkSession, sf_dir: str) -> langid.Model:
    """Learned from the documents whose crc32 leaves another remainder than 2."""
    return langid.learn(learnable(table(spark, sf_dir, "documents"), 4, 2))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Learned from the labels whose crc32 leaves another remainder than 0."""
    return toxicity.learn(table(spark, sf_dir, "documents"), learnable(table(spark, sf_dir, "labels"), 5, 0))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.predict(table(spark, sf_dir, "documents"), language_model(spark, sf_dir))
    return _held_out(found, 4, 2).select("doc_id", "held_out", "lang_pred", "score")


def op2_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), 40)
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the number of licenses in it, and that with the most matched words."""
    hits = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    best = F.array_max(
        F.transform("hits", lambda h: F.struct(h["matched"], (-h["first_word"]).alias("early"), h["template"], h["coverage"]))
    )
    return hits.select(
        "doc_id", F.size("hits").alias("n_hits"), best["template"].alias("license"), best["coverage"].alias("coverage")
    )


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.search(table(spark, sf_dir, "embeddings"), F.pmod(F.col("id"), F.lit(20)) == 0, 20)
    return found.withColumnRenamed("id", "vec_id")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=4, threshold=0.8)


def op6_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_key")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "tokens")
    tokenfile.write_tokens(table(spark, sf_dir, "documents"), path, ranges_of(spark))
    return tokenfile.read_tokens(spark, path, with_ids=False)


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), with_ids=False)


def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    return warc.read_warc(spark, path, with_payload=False)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.predict(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return _held_out(found, 5, 0).select("doc_id", "held_out", "score", "predicted")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.learn(vectors))


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.without_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return cut.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its cluster, and what its distances add up to."""
    found = centroids.cluster(table(spark, sf_dir, "embeddings"))
    rows = staged(found.rows, "assigned")
    inertia = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = inertia.agg(F.sum("cluster_inertia").alias("inertia")).scalar()
    # A row per centroid.
    known = inertia.withColumn("inertia", total).join(found.digests(), "cluster")
    return rows.join(F.broadcast(known), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_byte_shards": op2_byte_shards,
    "op3_license_scan": op3_license_scan,
    "op4_neighbours": op4_neighbours,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_benchmark_leaks": op6_benchmark_leaks,
    "op7_token_files": op7_token_files,
    "op8_bpe_round_trip": op8_bpe_round_trip,
    "op9_warc_round_trip": op9_warc_round_trip,
    "op10_toxicity": op10_toxicity,
    "op11_whitening": op11_whitening,
    "op12_repeats": op12_repeats,
    "op13_centroids": op13_centroids,
}

ORACLES: dict[str, str] = {
    "op2_byte_shards": sharding.ORACLE,
    "op5_near_duplicates": neardup.ORACLE,
    "op6_benchmark_leaks": decontaminate.ORACLE,
    "op9_warc_round_trip": warc.ORACLE,
    "op12_repeats": repeats.ORACLE,
    "op13_centroids": centroids.ORACLE,
}
