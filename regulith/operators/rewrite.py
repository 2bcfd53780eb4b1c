"""Plain-language rewriting without a language model: jargon, readability, complexity reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

# Fixed values
CONFIDENCE = 0.95
WARNING = "LLM rewrite unavailable - pattern-based cleanup only"


def rewrite(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", re2: bool = False) -> DataFrame:
    """id, original_text, rewritten_text, changes, readability_before, readability_after, confidence, warnings. Words are those of Python's ``re``, with ``re2`` those of RE2."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    first = docs.select(F.col(id_col), body.alias("original_text")).withColumn("rewritten_text", text.without_jargon(F.col("original_text"), re2))
    return first.withColumns(
        {
            "changes": text.jargon_changes(F.col("original_text"), re2),
            "readability_before": text.readability(F.col("original_text"), re2),
            "readability_after": text.readability(F.col("rewritten_text"), re2),
            "confidence": F.lit(CONFIDENCE),
            "warnings": F.array(F.lit(WARNING)),
        }
    )


def complexity_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", examples: int = 10, re2: bool = False) -> DataFrame:
    """id, readability_score, word_count, sentence_count (at least 1), avg_sentence_length, passive_voice_count, jargon_count, jargon_examples (sorted), long_sentences, complexity_rating. ``re2`` as in ``rewrite``, but for long_sentences."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col), body.alias("__t")).withColumns({"word_count": text.word_count(F.col("__t"), re2), "sentence_count": F.greatest(F.lit(1), text.sentence_count(F.col("__t"))), "__j": text.jargon_found(F.col("__t"), re2), "__s": text.syllable_count(F.col("__t"), re2)})
    base = base.withColumn("readability_score", text.reading_ease(F.col("word_count"), F.col("sentence_count"), F.col("__s")))
    return base.select(
        id_col, "readability_score", "word_count", "sentence_count", (F.col("word_count") / F.col("sentence_count")).alias("avg_sentence_length"),
        text.passive_count(F.col("__t"), re2).alias("passive_voice_count"), F.size("__j").cast("long").alias("jargon_count"),
        F.slice(F.array_sort(F.array_distinct("__j")), 1, examples).alias("jargon_examples"), text.long_sentences(F.col("__t")).alias("long_sentences"),
        text.rating(F.col("readability_score")).alias("complexity_rating"),
    )


def readability_counts(docs: DataFrame, text_col: str = "text", re2: bool = False) -> DataFrame:
    """complexity_rating, documents."""
    rated: Column = text.rating(text.readability(F.coalesce(F.col(text_col), F.lit("")), re2))
    return docs.select(rated.alias("complexity_rating")).groupBy("complexity_rating").agg(F.count("*").alias("documents"))
