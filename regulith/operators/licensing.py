"""Licence requirements looked up, compared and ranked. Rows as in ``sources.licenses``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_totals(rows: DataFrame) -> DataFrame:
    """Adds total_initial_cost and total_time_days."""
    return rows.withColumns({"total_initial_cost": F.col("application_fee") + F.col("exam_fee") + F.col("license_fee"), "total_time_days": F.col("experience_days") + F.col("processing_days")})


def for_license(rows: DataFrame, license_type: str) -> DataFrame:
    """Rows of a licence by its key, in any case; none for another name."""
    return rows.where(F.col("license_key") == license_type.lower())


def state_data(rows: DataFrame, state: str, license_type: str) -> DataFrame:
    return for_license(rows, license_type).where(F.col("state") == state).limit(1)


def compare_states(rows: DataFrame, states: list[str], license_type: str) -> DataFrame:
    """Requested states that there are, by burden score (none last) and then as requested; a state asked for twice comes twice."""
    asked = rows.sparkSession.createDataFrame([(s, i) for i, s in enumerate(states)], "state string, request_ord int")
    found = with_totals(for_license(rows, license_type)).join(F.broadcast(asked), "state")  # the caller's list
    ranked = found.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("burden_score"), "request_ord")))
    return ranked.select("rank", "state", "training_hours", F.col("total_initial_cost").alias("total_cost"), "processing_days", "burden_score", "recent_reforms", "in_person_required", "notarization_required")


def shown(compared: DataFrame) -> DataFrame:
    """A comparison as people read it: costs in dollars, yes and no as marks."""
    mark = lambda c: F.when(F.col(c), "✅").otherwise("❌")
    return compared.select("state", "training_hours", F.concat(F.lit("$"), F.format_number("total_cost", 0)).alias("total_cost"), "processing_days", mark("in_person_required").alias("in_person_required"), mark("notarization_required").alias("notarization_required"), "burden_score")


def transposed(compared: DataFrame) -> DataFrame:
    """One row an attribute, one column a state."""
    names = [c for c in compared.columns if c != "state"]
    long = compared.select("state", F.posexplode(F.array(*(F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value")) for c in names))).alias("ord", "x"))
    return long.groupBy("ord", F.col("x.attribute").alias("attribute")).pivot("state").agg(F.first("x.value")).orderBy("ord").drop("ord")


def effective_score() -> Column:
    """The burden score, 10 for none and for 0."""
    return F.coalesce(F.nullif("burden_score", F.lit(0)), F.lit(10))


def best_practice(rows: DataFrame) -> DataFrame:
    """license_key, state with the lowest burden; the first of equals."""
    return rows.groupBy("license_key").agg(F.min_by("state", F.struct(effective_score(), "input_ord")).alias("state"))


def model_provisions(rows: DataFrame) -> DataFrame:
    """license_key, rank, state, reform, burden_score of states with a reform, the lowest score first."""
    some = rows.where("recent_reforms <> ''")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("license_key").orderBy(F.asc_nulls_last("burden_score"), "input_ord")))
    return ranked.select("license_key", "rank", "state", F.col("recent_reforms").alias("reform"), "burden_score")


def with_sample_statute(rows: DataFrame, statutes: DataFrame) -> DataFrame:
    """Rows whose "state licence type" names a sample provision, with its text as sample_text."""
    named = statutes.select(F.col("name").alias("__name"), F.col("text").alias("sample_text"))
    return rows.join(named, F.concat_ws(" ", "state", "license_type") == F.col("__name")).drop("__name")
