import json
import zipfile

import pytest

from regulith import cli
from regulith.operators import rewrite, scan
from regulith.sources import files, reports
from regulith.streaming.scans import scan_stream

LAW = "Section 1. Filing\nThe form shall be signed by the owner in writing and a filing fee of $50 is required. Violation is a felony.\nSection 2. Place\nThe owner shall appear in person before a notary public.\n"


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "law.txt").write_text(LAW)
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "deep.txt").write_text("Section 9 in writing")
    with zipfile.ZipFile(tmp_path / "law.docx", "w") as z:
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Section 1 in</w:t></w:r><w:r><w:tab/><w:t>writing</w:t></w:r></w:p><w:p/></w:body></w:document>')
    (tmp_path / "law.pdf").write_bytes(b"%PDF-1.4")
    return tmp_path


def test_files(spark, folder):
    docs = files.read_documents(spark, str(folder), jurisdiction="Ohio")
    assert [(r.title, r.jurisdiction, r.text) for r in files.readable(docs).collect()] == [("law", "Ohio", LAW)]
    assert [r.source.rsplit("/", 1)[1] for r in files.errors(docs).collect()] == ["bad.txt"]
    assert files.read_documents(spark, f"{folder}/law.docx").first().text == "Section 1 in\twriting\n"
    assert files.read_documents(spark, f"{folder}/law.pdf").first().error
    (folder / "law.csv").write_text("a,b")
    for path, pattern in ((f"{folder}/law.csv", "*.txt"), (f"{folder}", "*.csv")):
        with pytest.raises(ValueError):
            files.read_documents(spark, path, pattern)
    given = files.from_texts(spark, ["a", "  \n"])
    assert files.non_blank(files.readable(given)).count() == 1


def test_all_errors_are_told(spark, tmp_path, capsys):
    for i in range(130):
        (tmp_path / f"bad{i}.txt").write_bytes(b"\xff")
    (tmp_path / "good.txt").write_bytes(b"a\r\nb\rc")
    cli.main([f"{tmp_path}"])
    assert capsys.readouterr().out.count("Error scanning") == 130
    assert files.readable(files.read_documents(spark, str(tmp_path))).first().text == "a\nb\nc"


def test_reports_and_command_line(spark, folder, capsys):
    cli.main([f"{folder}", "-j", "Ohio", "-f", "json", "-o", f"{folder}/out.json"])
    said = json.loads((folder / "out.json").read_text())
    assert "Error scanning" in capsys.readouterr().out
    assert said["jurisdiction"] == "Ohio" and said["documents_scanned"] == 1 and said["sections_analyzed"] == 2
    assert said["total_burdens"] == len(said["burdens"]) == sum(said["summary_stats"]["by_type"].values())
    assert said["high_priority_count"] == sum(b["severity"] in ("HIGH", "CRITICAL") for b in said["burdens"])
    cli.main([f"{folder}", "-f", "jsonl", "-o", f"{folder}/lines"])
    lines = [json.loads(x) for f in (folder / "lines").glob("*.json") for x in f.read_text().splitlines()]
    assert len(lines) == said["total_burdens"] and {x["type"] for x in lines} == {b["type"] for b in said["burdens"]}
    capsys.readouterr()
    cli.main([f"{folder}/law.txt", "--no-llm"])
    report = capsys.readouterr().out
    assert report.startswith("# Statutory Burden Scan: Unknown") and "## Recommendations" in report and "1. " in report
    docs = spark.createDataFrame([(1, "Herein the clerk may act.")], "doc_id long, text string")
    shown = reports.rewrite_markdown(rewrite.rewrite(docs).first())
    assert "95%" in shown and '"Herein" → "in this document"' in shown


def test_stream_gives_what_a_batch_gives(spark, tmp_path):
    docs = spark.createDataFrame([(i, LAW * (i + 1)) for i in range(6)], "doc_id long, text string")
    docs.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    scan_stream(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    key = lambda df: sorted((r.doc_id, r.sec_pos, r.source_ord, r.rule_ord, r.match_ord, r.text_excerpt) for r in df.collect())
    assert key(spark.read.parquet(f"{tmp_path}/out")) == key(scan.scan(docs))
