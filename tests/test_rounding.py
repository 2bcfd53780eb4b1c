"""Rounding at ties, where the decimal text of a double and the double itself part."""

import duckdb
import pytest

import __spark_entry__ as entry
from regulith.functions import text
from regulith.plans import oracle


def test_complexity_report_at_ties_of_the_average(spark, tmp_path):
    """A document of 640 sentences: of 1327 words, 2.0734375 on average, whose double lies below the tie."""
    schema = "doc_id long, source string, text string"
    rows = lambda body: spark.createDataFrame([(34, "a", body)], schema)
    rows("Ok.").coalesce(1).write.parquet(str(tmp_path / "first" / "documents.parquet"))
    base = entry.QUERIES["complexity_report"](spark, str(tmp_path / "first")).first()
    ends = 640 - base.sentence_count
    body = "Ok. " + "so. " * ends + "so " * (1327 - base.word_count - ends)
    rows(body).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = entry.QUERIES["complexity_report"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = con.sql(oracle.sql()["complexity_report"])
    assert [tuple(r[c] for c in found.columns) for r in got.collect()] == found.fetchall()
    assert (got.first().word_count, got.first().sentence_count, got.first().avg_sentence_length) == (1327, 640, 2.073437)


@pytest.mark.parametrize("a, b", [(1327, 640), (10721, 640), (1, 128), (-1327, 640), (0, 1), (2, 3)])
def test_rounded_is_duckdbs_round(spark, a, b):
    from pyspark.sql import functions as F

    got = spark.range(1).select(text.rounded(F.lit(a) / F.lit(b))).first()[0]
    assert [(got,)] == duckdb.sql(f"SELECT round({a}::DOUBLE / {b}, 6)").fetchall()
