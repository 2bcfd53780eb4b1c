"""Words and their bounds next to letters and spaces beyond ASCII, where Java, Python's ``re`` and the SQL's RE2 part."""

import random

import duckdb
import pytest

import __spark_entry__ as entry
from regulith.plans import more_oracle, oracle

SQL = oracle.sql() | more_oracle.sql()
PIECES = [
    "geübe", "übeen", "be", "is", "Is", "iſ", "İs", "was", "been", "to", "tö", "abced", "uſed", "fledö", "enüstilled", "ed", "ED", "Ked", "_ed", "x_ed", "éed", "hereinä", "übhereof", "äherein", "herein",
    "Whereaſ", "whereaſé", "prior", "ßprior", "tooé", "in", "ın", "order", "shall", "ſhall", "beü", "e", "e.", "é.", "İ", "ıe", "ye!", "...", "5", "Σ",
]
JOINS = [" ", " ", " ", "  ", "\n", "\t", "\f", "\r", "\v", "\x1c", "\x85", "\xa0", " ", "", "."]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    texts = ["Er geübe abced.", "hereinä", "a\xa0b\vc. d"] + ["".join(rng.choice(PIECES) + rng.choice(JOINS) for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    path = tmp_path_factory.mktemp("words")
    spark.createDataFrame([(i, "a", t) for i, t in enumerate(texts)], "doc_id long, source string, text string").coalesce(1).write.parquet(str(path / "documents.parquet"))
    return path


@pytest.mark.parametrize("name", ["complexity_report", "readability", "complexity_rating_counts", "jargon_changes", "jargon_rewrite", "rewrite_documents"])
def test_words_as_in_sql(spark, folder, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = con.sql(SQL[name])
    got = entry.QUERIES[name](spark, str(folder)).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)
