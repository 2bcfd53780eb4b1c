"""Spark against plain Python on texts that try every rule."""

import re
import time

import pytest
from pyspark.sql import functions as F

from regulith.functions import rules, rx, text
from regulith.operators import rewrite, scan, sections

from . import spec
from .texts import ALL


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(ALL)], "doc_id long, text string, location string").repartition(8).cache()
    df.count()
    return df


def test_every_rule_fires():
    whole = "\n".join(ALL)
    for r in scan.CATALOG:
        assert re.search(r.pattern, whole, re.I), r
    for p in (*rules.SCORE_WEIGHTS, *rules.SECTION_MARKERS, *rules.PASSIVE, *(rf"\b{t}\b" for t in rules.JARGON), rules.DEFINITION, rules.CROSS_REFERENCE, rules.FEE, rules.TIMEFRAME):
        assert re.search(p, whole, re.I), p
    assert len(rules.BURDEN_TYPES) == 29 and len(scan.STATUTORY) == 41 and len(scan.TAXONOMY) == 42 and len(rules.JARGON) == 37


def test_needed_text_is_in_every_match():
    for r in scan.CATALOG:
        for body in ALL:
            for m in re.finditer(r.pattern, body, re.I):
                plain = m.group().translate(str.maketrans("ſKİı", "skii")).lower()
                assert rx.needed(r.pattern) in plain
    assert rx.needed("a|b") == "" and rx.needed("colou?r(s)") == "colo" and rx.needed(r"\d+ days? x{2,3}yz") == " day"


def test_sections(docs):
    got = {}
    for r in sections.split_sections(docs).orderBy("doc_id", "sec_pos").collect():
        got.setdefault(r.doc_id, []).append((r.section_id, r.title, r.text, r.location))
    for i, body in enumerate(ALL):
        assert got[i] == spec.split_sections(body), body


@pytest.mark.parametrize("combined", [True, False])
def test_findings(docs, combined):
    got = {}
    config = scan.ScanConfig(combined=combined, least_words=4, max_sections=2)
    for r in scan.scan(docs, config).orderBy("doc_id", *scan.ORDER).collect():
        got.setdefault(r.doc_id, []).append((r.sec_pos, r.source_ord, r.burden_type, r.sev_rank, r.location, r.text_excerpt))
        assert r.severity == rules.SEVERITIES[r.sev_rank - 1] and r.category == rules.CATEGORY.get(r.burden_type, "administrative")
        start = "Pattern match: " if r.source_ord else "Statutory "
        assert r.explanation.startswith(start)
    for i, body in enumerate(ALL):
        assert got.get(i, []) == spec.findings(body, combined, 4, 2), body


def test_one_pass_merges_as_the_general_operator_does(docs):
    split = sections.with_eligibility(docs, least_words=4)
    general = scan.merged(scan.taxonomy_findings(split.where("eligible")), "doc_id", "sec_pos")
    narrow = scan.scan(docs, scan.ScanConfig(least_words=4)).where("source_ord = 1")
    key = lambda df: sorted((r.doc_id, r.sec_pos, r.rule_ord, r.match_ord, r.burden_type, r.text_excerpt) for r in df.collect())
    assert key(general) == key(narrow)


def test_text_functions(docs):
    body = F.col("text")
    got = docs.select(
        "doc_id", "text", text.word_count(body).alias("w"), text.sentence_count(body).alias("s"), text.readability(body).alias("e"), text.burden_score(body).alias("b"), text.complexity(body, 2).alias("c"),
        text.without_jargon(body).alias("p"), text.document_type(body).alias("d"), text.fees(body).alias("f"), text.timeframes(body).alias("t"), text.digital(body).alias("o"), text.passive_count(body).alias("v"),
    ).collect()
    for r in got:
        x = r.text
        assert (r.w, r.s) == (len(x.split()), len(re.findall("[.!?]+", x)))
        assert r.e == pytest.approx(spec.ease(x)) and r.b == pytest.approx(spec.score(x)) and r.c == pytest.approx(spec.complexity(x, 2))
        assert r.p == spec.plain(x)
        fees = re.findall(rules.FEE, x)
        assert r.f == (", ".join(f"${f}" for f in fees[:3]) or "Not specified")
        times = re.findall(rules.TIMEFRAME, x, re.I)
        assert r.t == (", ".join(f"{n} {u}s" for n, u in times[:3]) or "Not specified")
        assert (r.o == "Available") == bool(re.search(rules.DIGITAL, x, re.I))
        assert r.v == sum(len(re.findall(p, x, re.I)) for p in rules.PASSIVE)
        low = x.lower()
        assert r.d == next((k for k, ps in rules.DOCUMENT_TYPES.items() if any(p in low for p in ps)), "unknown")


def test_rewriting(docs):
    for r in rewrite.rewrite(docs).collect():
        changes = {(m, other or "(removed)") for t, other in rules.JARGON.items() for m in re.findall(rf"\b{t}\b", r.original_text, re.I)}
        assert {(c.before, c.after) for c in r.changes} == changes and len(r.changes) == len(changes)
        assert r.rewritten_text == spec.plain(r.original_text) and r.confidence == 0.95 and r.warnings == [rewrite.WARNING]
        assert r.readability_after == pytest.approx(spec.ease(r.rewritten_text))
    for r in rewrite.complexity_report(docs).collect():
        x = ALL[r.doc_id]
        found = [m for t in rules.JARGON for m in re.findall(rf"\b{t}\b", x, re.I)]
        assert r.jargon_count == len(found) and r.jargon_examples == sorted(set(found))[:10]
        long = [s.strip()[:100] + "..." for s in re.split("[.!?]+", x) if len(s.split()) > 30]
        assert r.long_sentences == long[:5] and r.sentence_count == (len(re.findall("[.!?]+", x)) or 1)
        assert r.complexity_rating == next((n for n, v in rules.RATINGS.items() if spec.ease(x) >= v), "Very Complex")


def test_references_definitions_and_totals(docs):
    refs, defs = {}, {}
    for r in sections.attached_references(docs).collect():
        refs.setdefault(r.doc_id, []).append((r.sec_pos, r.raw_text))
    for r in sections.definitions(docs).collect():
        defs.setdefault(r.doc_id, {})[r.term] = r.definition
    totals = {r.doc_id: (r.total_sections, r.total_words) for r in sections.document_totals(docs).collect()}
    for i, x in enumerate(ALL):
        split = spec.split_sections(x)
        raw = [m.group() for m in re.finditer(rules.CROSS_REFERENCE, x, re.I)]
        assert sorted(refs.get(i, [])) == sorted((k, ref) for k, s in enumerate(split) for ref in raw if ref in s[2])
        assert defs.get(i, {}) == {m.group(1).lower(): m.group(2).strip() for m in re.finditer(rules.DEFINITION, x, re.I)}
        assert totals[i] == (len(split), sum(len(s[2].split()) for s in split))


def test_matches_have_python_offsets(spark):
    df = spark.createDataFrame([(t,) for t in ALL], "t string")
    for p in (r"[.!?]+", r"\be\w*", "fee"):
        for r in df.select("t", rx.matches(F.col("t"), F.lit(rx.fold(p))).alias("m")).collect():
            assert [(m.start, m.text) for m in r.m] == [(m.start(), m.group()) for m in re.finditer(p, r.t, re.I)]


def test_counts_priorities_and_texts(docs):
    found = scan.scan(docs).cache()
    rows = found.orderBy("doc_id", *scan.ORDER).collect()
    got = {(r.dimension, r.value): r.n for r in scan.counts(found).collect()}
    for name, column in (("by_type", "burden_type"), ("by_category", "category"), ("by_severity", "severity")):
        assert sum(n for (d, _), n in got.items() if d == name) == len(rows)
        assert all(got[name, r[column]] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.burden_type, []).append(r.sev_rank)
    want = sorted(by, key=lambda t: (max(by[t]), len(by[t])), reverse=True)[:5]
    top = scan.type_priority(found).orderBy("rank").collect()
    assert [r.burden_type for r in top] == want and [r.n for r in top] == [len(by[t]) for t in want]
    said = scan.engine_recommendations(found).collect()
    assert max(r["rank"] for r in said) <= 10
    summary = {r.doc_id: r.summary for r in scan.burden_summary(docs, found).collect()}
    assert len(summary) == len(ALL)
    for i in range(len(ALL)):
        mine = [r.severity for r in rows if r.doc_id == i]
        lines = [f"Identified {len(mine)} procedural burdens:", *(f"- {s}: {mine.count(s)}" for s in reversed(rules.SEVERITIES) if s in mine)]
        assert summary[i] == ("\n".join(lines) if mine else "No significant procedural burdens identified.")
    high = scan.high_priority(found).count()
    totals = scan.totals(docs, found).first()
    assert totals.high_priority_count == high and totals.total_burdens == len(rows) and totals.documents_scanned == len(ALL)
    assert scan.filtered(found, "HIGH").count() == high
    assert {r.burden_type for r in scan.filtered(found, burden_types=("paper_only",)).select("burden_type").distinct().collect()} == {"paper_only"}


def test_merging_prefers_the_last_suggestion(spark):
    columns = "doc_id long, sec_pos int, source_ord int, rule_ord int, match_ord int, burden_type string, location string, reform_suggestion string, explanation string"
    rows = [(1, 0, 0, 0, 0, "a", "x", None, "first"), (1, 0, 0, 1, 0, "a", "x", "do", "second"), (1, 1, 0, 0, 0, "a", "x", "more", "third"), (1, 2, 0, 0, 0, "a", "x", "", "fourth"), (1, 0, 0, 0, 1, "b", "x", "", "only"), (2, 0, 0, 0, 0, "a", "x", None, "other")]
    got = scan.merged(spark.createDataFrame(rows, columns)).orderBy("doc_id", "burden_type").collect()
    assert [(r.doc_id, r.burden_type, r.explanation, r.sec_pos) for r in got] == [(1, "a", "third", 0), (1, "b", "only", 0), (2, "a", "other", 0)]


def test_null_and_empty_tables(spark):
    none = spark.createDataFrame([(1, None), (None, "Section 1 in writing"), (None, "Section 1 in writing")], "doc_id long, text string")
    assert scan.scan(none).count() == 2 and sections.split_sections(none).count() == 3
    assert rewrite.rewrite(none).where("doc_id = 1").first().rewritten_text == ""
    empty = none.limit(0)
    assert scan.scan(empty).count() == 0 and scan.scan_recommendations(scan.scan(empty)).count() == 0


def test_white_space_is_that_of_python(spark):
    for body in ("a\x1cb c", "\x1f a\x85b \x1d", "\u3000x\u2028y\xa0", ""):
        got = spark.createDataFrame([(body,)], "t string").select(text.word_count(F.col("t")).alias("n"), rx.strip(F.col("t")).alias("s")).first()
        assert (got.n, got.s) == (len(body.split()), body.strip())


def test_running_sums_and_cuts(spark):
    for n in (0, 1, 255, 256, 257, 1000):
        got = spark.range(1).select(rx.running(F.expr(f"transform(sequence(1, {max(n, 1)}), x -> cast(x as long))" if n else "cast(array() as array<bigint>)")).alias("r")).first().r
        assert got == [k * (k + 1) // 2 for k in range(n)]
    body = "".join(chr(97 + i % 26) if i % 7 else "😀" for i in range(5000))
    spans = [(0, 5), (1000, 1030), (1023, 1024), (1024, 1025), (1020, 3100), (4990, 5000), (7, 7)]
    df = spark.createDataFrame([(body, a, b) for a, b in spans], "t string, a int, b int")
    assert [r.c for r in df.select(rx.cut(rx.blocks(F.col("t")), F.col("a"), F.col("b")).alias("c")).collect()] == [body[a:b] for a, b in spans]


def test_work_grows_with_the_matches_of_a_section(spark):
    def seconds(n):
        docs = spark.createDataFrame([(1, "The form is filed in writing before a notary public. " * n)], "doc_id long, text string").coalesce(1)
        began = time.perf_counter()
        scan.scan(docs).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    seconds(50)
    small, large = (min(seconds(n) for _ in range(2)) for n in (4000, 8000))
    assert large < 3 * small + 0.5
