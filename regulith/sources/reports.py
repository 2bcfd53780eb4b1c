"""Results as JSON and Markdown. What is rendered here has been cut down by Spark first."""

from __future__ import annotations

import json
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import compare, scan, sections

# The formats of the reports.
SCAN_HEAD = """# Statutory Burden Scan: {jurisdiction}

## Summary
- Documents scanned: {documents_scanned}
- Sections analyzed: {sections_analyzed}
- Total burdens identified: {total_burdens}
- High priority findings: {high_priority_count}

## Burden Distribution
"""
SCAN_SHARE = "- {value}: {n}\n"
SCAN_URGENT = "\n## High Priority Findings\n\n"
SCAN_FINDING = "### {i}. {burden_type} ({severity})\n**Location:** {location}\n**Text:** {excerpt}...\n**Reform Suggestion:** {reform}\n\n"
SCAN_NO_REFORM = "Review and simplify"
ADVICE = "## Recommendations\n\n"
NUMBERED = "{i}. {text}"
REWRITE = """## Original vs. Rewritten

### Original
{r.original_text}

### Plain Language Version
{r.rewritten_text}

**Readability improvement:** {r.readability_before:.1f} → {r.readability_after:.1f}
**Legal meaning confidence:** {r.confidence:.0%}"""
REWRITE_CHANGES, REWRITE_CHANGE = "\n\n### Key Changes", '\n- "{c.before}" → "{c.after}"'
REWRITE_WARNINGS, REWRITE_WARNING = "\n\n### Warnings", "\n- ⚠️ {w}"
COMPARE_HEAD = "# Cross-State Comparison: {topic}\n*Comparison Dimension: {dimension}*\n\n## Jurisdiction Rankings (Least to Most Burdensome)\n\n"
COMPARE_RANK = "{rank}. **{jurisdiction}** - Score: {score}\n   - {notes}\n"
COMPARE_DIFFERENCES, COMPARE_ASPECT, COMPARE_DETAIL = "\n## Key Differences\n\n", "### {aspect}\n", "- **{jurisdiction}**: {detail}\n"
COMPARE_MODELS, COMPARE_MODEL = "## Model Provisions (Best Practices)\n\n", "### From {source}\n```\n{text}\n```\n*Why it works:* {rationale}\n\n"


def findings_json(findings: DataFrame, excerpt: int = 200) -> DataFrame:
    """Findings as they are exported: type, category, severity, location, excerpt, reform."""
    return findings.select(F.col("burden_type").alias("type"), "category", "severity", "location", F.substring("text_excerpt", 1, excerpt).alias("excerpt"), F.col("reform_suggestion").alias("reform"))


def _numbered(texts: Iterable[str]) -> str:
    return "\n".join(NUMBERED.format(i=i, text=t) for i, t in enumerate(texts, 1))


def _advice(findings: DataFrame, id_col: str) -> list[str]:
    return [r.recommendation for r in scan.scan_recommendations(findings, id_col=id_col).orderBy("rank").collect()]


def scan_result(docs: DataFrame, findings: DataFrame, jurisdiction: str = "Unknown", id_col: str = "doc_id") -> dict:
    """A scan's result as one object. For large inputs write ``findings_json`` with Spark instead: this collects all findings."""
    totals = scan.totals(docs, findings).first().asDict()
    totals.pop("critical_count")
    stats: dict[str, dict[str, int]] = {"by_type": {}, "by_category": {}, "by_severity": {}}
    for r in scan.counts(findings, id_col=id_col).orderBy("first").collect():
        stats[r.dimension][r.value] = r.n
    burdens = [r.asDict() for r in findings_json(findings.orderBy(id_col, *scan.ORDER)).collect()]
    return {"jurisdiction": jurisdiction, **totals, "summary_stats": stats, "burdens": burdens, "recommendations": _advice(findings, id_col)}


def _object(columns: dict[str, Column]) -> Column:
    return F.to_json(F.struct(*(c.alias(n) for n, c in columns.items())), {"ignoreNullFields": "false"})


def scan_lines(docs: DataFrame, findings: DataFrame, by: str = "jurisdiction", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(by, ord, place, line): what ``scan_result`` gives for each jurisdiction as lines of text, however many findings there are.

    The lines of a jurisdiction in order of (ord, place) are one JSON object: a head with totals and counts (ord 0), a line for each finding
    (ord 1), and a tail with recommendations (ord 2). ``by`` is a column of ``docs``; null is a jurisdiction too. Findings that carry it
    (``scan``'s ``keep``) are taken as they are; others are joined with it by id, which has to name one document. Head and tail come from one pass
    over the findings, which leaves a row for each jurisdiction, type and severity; the lines take another.
    """
    if by in findings.columns:
        own = findings.withColumn("j", F.coalesce(by, F.lit(""))).drop(by)
    else:
        own = findings.join(docs.select(id_col, F.coalesce(by, F.lit("")).alias("j")), id_col)
    split = docs.select(F.coalesce(by, F.lit("")).alias("j"), sections.section_count(F.coalesce(F.col(text_col), F.lit(""))).alias("n"))
    scanned = split.groupBy("j").agg(F.count("*").alias("documents_scanned"), F.sum("n").alias("sections_analyzed"))
    # a jurisdiction has a row for each type, category and severity, and one in all
    few = own.groupBy("j", "burden_type", "category", "severity", "sev_rank").agg(F.count("*").alias("n"), F.min(F.struct(id_col, *scan.ORDER)).alias("first"))
    counted = scan.regrouped(few, "j", whole=True)
    listed = lambda d: F.array_sort(F.collect_list(F.when(F.col("dimension") == d, F.struct("first", "value", "n"))))
    told = lambda d: F.map_from_entries(F.transform(listed(d), lambda x: F.struct(x["value"], x["n"]))).alias(d)
    count = lambda c: F.coalesce(F.max(F.when(c, F.col("n"))), F.lit(0))
    severe = F.coalesce(F.sum(F.when((F.col("dimension") == "by_severity") & F.col("value").isin("HIGH", "CRITICAL"), F.col("n"))), F.lit(0))
    stats = counted.groupBy("j").agg(count(F.col("dimension") == "all").alias("total"), severe.alias("severe"), F.min(F.when(F.col("dimension") == "all", F.col("first"))).alias("first"), *map(told, ("by_type", "by_category", "by_severity")))
    by_type = few.groupBy("j", "burden_type").agg(F.max("sev_rank").alias("max_rank"), F.sum("n").alias("n"), F.min("first").alias("first"))
    advice = scan.advised(scan.ranked_types(by_type, "j"), "j").groupBy("j").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "recommendation"))), lambda x: x["recommendation"]).alias("said"))
    whole = scanned.join(stats, "j", "left").join(advice, "j", "left")
    nothing = F.create_map().cast("map<string, long>")
    head = _object({
        "jurisdiction": F.col("j"), "documents_scanned": F.col("documents_scanned"), "sections_analyzed": F.col("sections_analyzed"), "total_burdens": F.coalesce("total", F.lit(0)),
        "high_priority_count": F.coalesce("severe", F.lit(0)), "summary_stats": F.struct(*(F.coalesce(c, nothing).alias(c) for c in ("by_type", "by_category", "by_severity"))),
    })
    tail = F.concat(F.lit('], "recommendations": '), F.to_json(F.coalesce("said", F.array().cast("array<string>"))), F.lit("}"))
    place = F.struct(id_col, *scan.ORDER)
    none = F.lit(None).cast(own.select(place.alias("p")).schema["p"].dataType.simpleString())
    ends = F.inline(F.array(F.struct(F.lit(0).alias("ord"), F.concat(F.expr("substring(head, 1, length(head) - 1)"), F.lit(', "burdens": [')).alias("line")), F.struct(F.lit(2).alias("ord"), F.col("tail").alias("line"))))
    frame = whole.select("j", head.alias("head"), tail.alias("tail")).select("j", ends).select("j", "ord", none.alias("place"), "line")
    firsts = stats.select(F.col("j").alias("k"), "first")
    placed = own.join(F.broadcast(firsts), F.col("j") == F.col("k"))  # a row for each jurisdiction: findings stay where they are
    shape = findings_json(placed.limit(0)).columns
    row = _object(dict(zip(shape, (F.col("burden_type"), F.col("category"), F.col("severity"), F.col("location"), F.substring("text_excerpt", 1, 200), F.col("reform_suggestion")))))
    comma = F.when(place == F.col("first"), "").otherwise(",")
    lines = placed.select("j", F.lit(1).alias("ord"), place.alias("place"), F.concat(comma, row).alias("line"))
    return frame.unionByName(lines).withColumnRenamed("j", by)


def write_scan_results(lines: DataFrame, path: str, by: str = "jurisdiction") -> None:
    """A folder for each jurisdiction (``by=name``), whose text files, in order of their names and one behind the other, are its JSON object.

    Lines are dealt by ranges of their order, so a large jurisdiction is written by many tasks, and no report passes through one.
    """
    ordered = lines.repartitionByRange(by, "ord", "place").sortWithinPartitions(by, "ord", "place")
    ordered.select(by, "line").write.mode("overwrite").partitionBy(by).text(path)


def scan_markdown(docs: DataFrame, findings: DataFrame, jurisdiction: str = "Unknown", id_col: str = "doc_id", most: int = 10) -> str:
    """A report with the first ``most`` findings of high priority."""
    totals = scan.totals(docs, findings).first().asDict()
    shares = scan.counts(findings, id_col=id_col).where("dimension = 'by_category'").orderBy("first").collect()
    urgent = scan.high_priority(findings).orderBy(id_col, *scan.ORDER).limit(most).collect()
    told = [SCAN_FINDING.format(i=i, excerpt=r.text_excerpt[:300], reform=r.reform_suggestion or SCAN_NO_REFORM, **{c: r[c] for c in ("burden_type", "severity", "location")}) for i, r in enumerate(urgent, 1)]
    return SCAN_HEAD.format(jurisdiction=jurisdiction, **totals) + "".join(SCAN_SHARE.format(value=r.value, n=r.n) for r in shares) + SCAN_URGENT + "".join(told) + ADVICE + _numbered(_advice(findings, id_col)[:most])


def rewrite_markdown(row, most: int = 10) -> str:
    """One row of ``rewrite.rewrite``."""
    changes = "".join(REWRITE_CHANGE.format(c=c) for c in row.changes[:most])
    warnings = "".join(REWRITE_WARNING.format(w=w) for w in row.warnings)
    return REWRITE.format(r=row) + (changes and REWRITE_CHANGES + changes) + (warnings and REWRITE_WARNINGS + warnings)


def comparison_markdown(topic: str, provisions: DataFrame, dimension: str = "overall_burden", models: Iterable[dict] = ()) -> str:
    """``models``: best provisions as source, text and rationale."""
    ranked = compare.rankings(provisions)
    ranks = "".join(COMPARE_RANK.format(**r.asDict()) for r in ranked.orderBy("rank").collect())
    found = compare.differences(provisions).orderBy("input_ord").collect()
    by_aspect = {a: "".join(COMPARE_DETAIL.format(**r.asDict()) for r in found if r.aspect == a) for a in compare.ASPECTS}
    differing = "".join(COMPARE_ASPECT.format(aspect=a) + lines + "\n" for a, lines in by_aspect.items() if lines)
    shown = "".join(COMPARE_MODEL.format(**{"source": "Unknown", "text": "", "rationale": ""} | m) for m in models)
    said = [r.recommendation for r in compare.recommendations(ranked).orderBy("ord").collect()]
    return COMPARE_HEAD.format(topic=topic, dimension=dimension) + ranks + COMPARE_DIFFERENCES + differing + (shown and COMPARE_MODELS + shown) + ADVICE + _numbered(said)


def write_text(content: str | dict, path: str | None) -> None:
    """To a file, or to standard output."""
    content = content if isinstance(content, str) else json.dumps(content, indent=2)
    if path:
        Path(path).write_text(content)
    else:
        print(content)
