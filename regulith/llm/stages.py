"""Operators as stages that filter, repeat or encode the rows of a documents table.

A stage takes and returns all columns of its input, whatever their names, and
decides about each row by itself: repeated rows and null ids are rows like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bradley_terry, language_id, mixing, shingle_join
from .common import fold, keyed, scratch, whole, written
from .text_stats import measured, with_ratios


def _whole(docs: DataFrame) -> DataFrame:
    return docs.select(whole(docs))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = 0.5, parts: int = 3, held: int = 1, **how) -> DataFrame:
    """Rows whose quality score is ``cut`` or more."""
    ranking = bradley_terry.learn(docs, labels, fold(F.col("doc_id"), parts) != held, **how)
    stats = with_ratios(_whole(docs).select("row", measured(F.col("row.text")).alias("s")).select("row", "s.*"))
    return stats.where(ranking.score() >= cut).select("row.*")


def keep_languages(docs: DataFrame, margin: float = 0.15, parts: int = 4, held: int = 2, **how) -> DataFrame:
    """Rows with a language, that of their text.

    A row goes if its text has no letter (that is all with no language to learn), or if its ``lang`` is a learnt language whose profile is
    further from the text than the nearest by more than ``margin``: by that much texts wholly in another
    language are, while one with a passage in another language is not. A null ``lang`` becomes the predicted one.
    """
    profiles = language_id.learn(docs, fold(F.col("doc_id"), parts) != held, **how)
    if not profiles.names:
        return docs.where(F.rlike("text", F.lit(r"\p{L}")))
    told = _whole(docs).select("row", language_id.predicted(F.col("row.text"), profiles).alias("p"))
    behind = F.coalesce(F.try_element_at("p.distances", F.col("row.lang")) - F.try_element_at("p.distances", F.col("p.lang_pred")), F.lit(0.0))
    kept = told.where((F.col("p.lang_pred") != language_id.UND) & (behind <= margin))
    return kept.select(F.col("row").withField("lang", F.coalesce("row.lang", "p.lang_pred")).alias("row")).select("row.*")


def keep_one_of_each(docs: DataFrame, **how) -> DataFrame:
    """Of rows that links connect (similar in 0.8 or more of their shingles of five words), the one with the smallest id; of equal ids, any one."""
    rows = keyed(docs, scratch(docs.sparkSession, "one-of-each"))
    order = F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("id"), F.col("row_id"))
    found = shingle_join.near_duplicates(rows.select(order.alias("key"), F.col("row.text").alias("text")), "key", "text", **how)
    chosen = written(found.where(F.col("key") == F.col("component_id")).select("key.row_id"), scratch(docs.sparkSession, "chosen"))
    return rows.join(chosen, "row_id", "left_semi").select("row.*")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """Rows as often as the mix takes them."""
    rows = keyed(docs, scratch(docs.sparkSession, "mixed"))
    flat = rows.select("row_id", "row.doc_id", "row.text", "row.source")
    copies = mixing.mix(flat, keep=("row_id",), **how).where(F.col("copies") > 0).select("row_id", "copies")
    taken = rows.join(copies, "row_id").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return taken.select("row.*")
