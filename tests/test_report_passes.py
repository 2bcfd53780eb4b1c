"""How often the reports' queries go over the texts."""

import __spark_entry__ as entry
import pytest
from regulith.operators import scan
from regulith.sources import reports


def joined(frame):
    """Logical joins of findings with documents by id: those that need their texts dealt out."""
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.split("\n") if "Join" in line and "doc_id" in line]


@pytest.mark.parametrize("name", ["finding_counts", "report_heads", "report_findings"])
def test_findings_are_not_joined_with_their_documents(spark, name):
    assert joined(entry.QUERIES[name](spark, "/root/testdata/sf0.001")) == []


def test_lines_with_and_without_the_jurisdiction_in_the_findings(spark):
    docs = spark.createDataFrame([(1, "a", "Filing fee, in writing."), (2, "a", "Adequate notary public."), (3, None, "By certified mail."), (4, "b", "Nothing.")], "doc_id long, jurisdiction string, text string")
    rows = lambda found: sorted(map(str, reports.scan_lines(docs, found).collect()))
    assert rows(scan.scan(docs)) == rows(scan.scan(docs, keep=("jurisdiction",)))
