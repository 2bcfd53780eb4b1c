"""A corpus pipeline over documents: filter by quality and language, drop near-duplicates, mix, encode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from regulith.llm import sentencepiece_codec, stages
from regulith.llm.common import drop, scratch, written
from regulith.llm.queries import public_model


def _bounded(spark: SparkSession) -> None:
    """Arrow batches of some 4 MB in this session: workers and executors hold a few copies of a batch of whole texts, and texts differ in length."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that the quality ranking rejects go."""
    _bounded(spark)
    return stages.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents without a language, or clearly in another than theirs, go."""
    _bounded(spark)
    return stages.keep_languages(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: one document of each group of near-duplicates stays; SimHash finds the close ones, a prefix join the rest."""
    _bounded(spark)
    return stages.keep_one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: each source's documents as often as its target asks, none, once or twice."""
    _bounded(spark)
    return stages.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: number of ids, and digests of the ids and of the text they decode to."""
    _bounded(spark)
    return sentencepiece_codec.digests(sentencepiece_codec.encode_documents(docs, public_model()))


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("mix", mix), ("encode", encode)]

#: The stages learn from the rows they are given, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = scratch(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{name}")
        if before:
            drop(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
