"""Totals of files and of their scan in one pass: each file is written and read once."""

import pytest

import __spark_entry__ as entry
from regulith.operators import scan
from regulith.plans import extra
from regulith.plans import queries as base
from regulith.sources import files, pdf

from .texts import ALL


def test_files_are_read_once(spark, tmp_path):
    rows = [(i, "a", t) for i, t in enumerate(["", None, *ALL])]
    spark.createDataFrame(rows, "doc_id long, source string, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = entry.QUERIES["directory_scan"](spark, str(tmp_path))
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("ArrowEvalPython") == 2
    read = files.decoded(extra.as_files(base.corpus(spark, str(tmp_path)))).localCheckpoint()
    docs = files.readable(read)
    want = scan.totals(docs, scan.scan(docs)).first().asDict() | {"files_with_errors": read.where("error is not null").count()}
    assert got.first().asDict() == want and want["total_burdens"] > want["sections_analyzed"] and want["files_with_errors"] > 0


@pytest.mark.parametrize("rows", [[], [(1, None, "bad")], [(1, None, None), (2, "", None), (3, "Plain words.", None), (4, "shall be notarized", "bad")]])
def test_totals_of_few_documents(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, error string")
    good = files.readable(docs)
    want = scan.totals(good, scan.scan(good)).first().asDict() | {"files_with_errors": sum(r[2] is not None for r in rows)}
    assert scan.scanned_totals(docs, "error").first().asDict() == want


def test_sections_without_a_match_keep_one_row_that_leads(spark):
    split = spark.createDataFrame([(1, 0, "None here."), (2, 0, "A public hearing shall be held. A public hearing shall be held, by mail, in writing."), (2, 1, "")], "doc_id long, sec_pos int, text string")
    found = scan.rule_matches(split, scan.CATALOG, whole=True)
    assert found.where("leads").count() == 3 and found.where("match_ord is null").count() == 2
    assert found.where("match_ord is not null").count() == scan.rule_matches(split, scan.CATALOG).count() > 2


def test_odd_characters_in_files():
    body = "a\tb & <c> \r\x01￾ é😀\n\n" + "".join(map(chr, range(0x20, 0x250))) + "\nﷺ"
    assert files.docx_text(files.docx_bytes(body)) == body.replace("\x01", "�").replace("￾", "�")
    assert pdf.pdf_text(pdf.pdf_bytes(body)) == body
