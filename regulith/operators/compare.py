"""Provisions compared across jurisdictions: scores, rankings, differences, recommendations.

Provisions are rows (jurisdiction, text, input_ord); input_ord breaks ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

# Aspects, and the recommendations below.
ASPECTS = {"Fees": "fees", "Timeframes": "timeframes", "Digital/Online Options": "digital"}
CLOSING = "Conduct detailed analysis of specific provisions to identify model language."


def provisions(given: DataFrame, name_col: str = "jurisdiction", text_col: str = "text", order_col: str = "input_ord") -> DataFrame:
    """One provision a name: rows with an empty name or text go; the last row of a name has its text, the first its place."""
    some = given.where((F.col(name_col) != "") & (F.col(text_col) != ""))
    return some.groupBy(F.col(name_col).alias("jurisdiction")).agg(F.max_by(text_col, order_col).alias("text"), F.min(order_col).alias("input_ord"))


def profiles(given: DataFrame, name_col: str = "jurisdiction", text_col: str = "text", order_col: str = "input_ord", most: int = 3) -> DataFrame:
    """jurisdiction, input_ord, score, words, fees, timeframes, digital of all texts of a name; rows with an empty name or text go.

    Counts are summed over the texts before they are weighed; the first ``most`` fees and timeframes in order
    of texts and place are shown. Sums are partial sums, and of a name's texts with fees the first ``most`` go on.
    """
    some = given.where((F.col(name_col) != "") & (F.col(text_col) != ""))
    body = F.col(text_col)
    counts = [c.alias(f"c{i}") for i, c in enumerate(text.score_counts(body))]
    each = some.select(F.col(name_col).alias("jurisdiction"), F.col(order_col).alias("input_ord"), text.word_count(body).alias("words"), text.is_digital(body).alias("digital"), *counts)
    sums = [F.sum(f"c{i}") for i in range(len(counts))]
    summed = each.groupBy("jurisdiction").agg(F.min("input_ord").alias("input_ord"), text.score_of(sums).alias("score"), F.sum("words").alias("words"), text.availability(F.max("digital")).alias("digital"))

    def firsts(items: Column, name: str) -> DataFrame:
        own = some.select(F.col(name_col).alias("j"), F.col(order_col).alias("o"), items.alias("items")).where(F.size("items") > 0)
        ranked = own.withColumn("r", F.row_number().over(Window.partitionBy("j").orderBy("o"))).where(F.col("r") <= most)
        listed = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("r", "items"))), lambda x: x["items"]))  # ``most`` rows of a name
        return ranked.groupBy("j").agg(F.slice(listed, 1, most).alias(name))

    out = summed
    for name, items in (("fees", text.fee_list(body, most)), ("timeframes", text.timeframe_list(body, most))):
        out = out.join(firsts(items, name), out.jurisdiction == F.col("j"), "left").drop("j")
    listed = lambda c: text.or_not_specified(F.coalesce(c, F.array().cast("array<string>"))).alias(c)
    return out.select("jurisdiction", "input_ord", "score", "words", listed("fees"), listed("timeframes"), "digital")


def _profiled(rows: DataFrame) -> DataFrame:
    return profiles(rows) if "text" in rows.columns else rows


def rankings(rows: DataFrame) -> DataFrame:
    """jurisdiction, rank, score, notes, from provisions or profiles: the least burdensome first. There is a row for each jurisdiction, so one window ranks them."""
    scored = _profiled(rows).select("jurisdiction", "input_ord", "score", F.format_string("Based on %d words of regulation", F.col("words")).alias("notes"))
    return scored.withColumn("rank", F.row_number().over(Window.orderBy("score", "input_ord"))).select("rank", "jurisdiction", "score", "notes")


def differences(rows: DataFrame) -> DataFrame:
    """aspect, jurisdiction, detail, from provisions or profiles, for the aspects in which jurisdictions differ."""
    pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("aspect"), F.col(c).alias("detail")) for a, c in ASPECTS.items())))
    each = _profiled(rows).select("jurisdiction", "input_ord", pairs.alias("p")).select("p.aspect", "jurisdiction", "input_ord", "p.detail")
    differ = each.groupBy("aspect").agg(F.min("detail").alias("a"), F.max("detail").alias("b")).where("a <> b").select("aspect")
    return each.join(differ, "aspect", "left_semi")


def recommendations(ranked: DataFrame) -> DataFrame:
    """ord, recommendation, from rankings: learn from the best, simplify the worst if its score is above 7, look closer."""
    ends = ranked.agg(F.count("*").alias("n"), F.min_by("jurisdiction", "rank").alias("best"), F.max_by("jurisdiction", "rank").alias("worst"), F.max_by("score", "rank").alias("top"))
    several = F.col("n") >= 2
    lines = F.array_compact(
        F.array(
            F.when(several, F.format_string("Consider adopting approaches from %s, which has the lowest burden score.", F.col("best"))),
            F.when(several & (F.col("top") > 7), F.format_string("Significant simplification opportunities exist - %s has a high burden score of %s.", F.col("worst"), one_decimal(F.col("top")))),
            F.lit(CLOSING),
        )
    )
    return ends.select(F.posexplode(lines).alias("ord", "recommendation"))


def one_decimal(x: Column) -> Column:
    """One decimal, rounded half to even on the number's exact value, as Python does."""
    return F.bround(x.cast("decimal(38, 30)"), 1).cast("decimal(10, 1)").cast("string")


def burden_light(score: Column) -> Column:
    return F.when(score <= 3, "🟢").when(score <= 6, "🟡").otherwise("🔴")


def medal(rank: Column) -> Column:
    return F.when(rank == 1, "🥇").when(rank == 2, "🥈").when(rank == 3, "🥉").otherwise("🔹")
