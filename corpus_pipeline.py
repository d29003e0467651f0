"""From raw documents to token ids: five stages, each on all that the one before kept.

    language          documents whose language is unknown go
    toxicity          toxic documents go
    near duplicates   one document of each group stays
    decontamination   documents that contain a benchmark item go
    bpe               ids of every text, and proof of the round trip

All stages but the last return the columns of the table they are given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pantryline.llm import bpe, decontaminate, langid, neardup, toxicity
from pantryline.llm.common import table, work_dir
from pantryline.llm.queries import learnable

#: A text of no language that was learned scores about 0.4 to 0.5, as a very short one does, so the
#: score only turns away what contradicts all of them.
LEAST_LANGUAGE_SCORE = 0.3
TOXIC_FROM = 0.5
SHINGLE_WORDS, SIMILARITY = 5, 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.learn(learnable(docs, 4, 2))
    return langid.accepted(docs, model, LEAST_LANGUAGE_SCORE)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.learn(docs, learnable(table(spark, sf_dir, "labels"), 5, 0))
    return toxicity.accepted(docs, model, TOXIC_FROM)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each(docs, SHINGLE_WORDS, SIMILARITY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_of(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs)


STAGES = [
    ("language", language),
    ("toxicity", toxic),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("bpe", encoding),
]

#: Learned stages can't be told in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_dir(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
