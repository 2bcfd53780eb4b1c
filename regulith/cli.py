"""Command line: scan a file or a folder of statutes for procedural burdens."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from .operators import scan
from .sources import files, reports


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Scan statutes for procedural burdens")
    parser.add_argument("input", help="a file (txt, pdf, docx) or a folder")
    parser.add_argument("-j", "--jurisdiction", default="Unknown")
    parser.add_argument("-o", "--output", help="file to write to instead of standard output")
    parser.add_argument("-f", "--format", choices=("json", "markdown", "jsonl"), default="markdown", help="jsonl writes all findings as a folder of lines, whatever their number")
    parser.add_argument("--pattern", default="*.txt", help="which files of a folder")
    parser.add_argument("--no-llm", action="store_true", help="statutory rules only")
    args = parser.parse_args(argv)
    if args.format == "jsonl" and not args.output:
        parser.error("jsonl needs an output folder")
    spark = SparkSession.builder.appName("regulith").getOrCreate()
    read = files.read_documents(spark, os.path.abspath(args.input), args.pattern, args.jurisdiction)
    for row in files.errors(read).toLocalIterator():
        print(f"Error scanning {row.source}: {row.error}")
    docs = files.readable(read)
    found = scan.scan(docs, scan.ScanConfig(combined=not args.no_llm))
    if args.format == "jsonl":
        reports.findings_json(found).write.mode("overwrite").json(os.path.abspath(args.output))
        return
    found = found.persist()  # the reports ask for counts, findings and advice
    render = reports.scan_result if args.format == "json" else reports.scan_markdown
    reports.write_text(render(docs, found, args.jurisdiction), args.output)
    found.unpersist()


if __name__ == "__main__":
    main()
