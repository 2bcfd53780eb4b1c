import json
import random

from pyspark.sql import functions as F

from regulith.functions import text
from regulith.operators import external, scan, sections

BURDEN = {"burdens": [{"text_excerpt": "ink", "burden_type": "Wet-Signature rule", "severity": "high", "affected_parties": "all", "estimated_impact": "slow", "reform_recommendation": "allow e-sign"}, {"burden_type": "", "severity": "odd"}]}
ANSWER = "REWRITTEN TEXT:\n You must sign. \nCHANGES MADE:\n- shorter\n• clearer\nnot this\nLEGAL CONFIDENCE: 85 %\nWARNINGS:\n- a term\n"


def burdens(prompts):
    assert all(len(p) < 5000 for p in prompts)
    return ["Sure:\n```json\n" + json.dumps(BURDEN) + "\n```\nDone" for _ in prompts]


def failing(prompts):
    raise RuntimeError("no model")


def parsed(spark, column, *answers):
    return [r.p for r in spark.createDataFrame([(a,) for a in answers], "a string").select(column(F.col("a")).alias("p")).collect()]


def test_fences(spark):
    answers = ["{}", "x ```json\n1\n``` y", "```\n2\n``` ```json\n3\n```", "```\n4\n```", "```json 5"]
    assert parsed(spark, external.fenced, *answers) == ["{}", "\n1\n", "\n3\n", "\n4\n", " 5"]
    assert parsed(spark, lambda c: external.fenced(c, False), answers[3]) == ["```\n4\n```"]


def test_rewrite_answers(spark):
    full, none, odd = parsed(spark, external.parsed_rewrite, ANSWER, "nothing of the kind", "WARNINGS:\n- w\nREWRITTEN TEXT: a WARNINGS: b CHANGES MADE: - c")
    assert (full.rewritten, full.changes, full.confidence, full.warnings) == ("You must sign.", ["shorter", "clearer"], 0.85, ["a term"])
    assert (none.rewritten, none.changes, none.confidence, none.warnings) == ("", [], 0.8, [])
    assert odd.rewritten == "a WARNINGS: b" and odd.changes == ["c"]


def test_type_names(spark):
    names = {"": "wet_signature", "Wet-Signature": "wet_signature", "my waiting period!": "waiting_period", "late fees": "excessive_fee", "personal visit": "in_person_appearance", "notarised": "notarization", "zzz": "excessive_documentation", "mail": "mail_only", "reporting": "duplicate_reporting", "the reports": "mandatory_report", "Public Hearing": "public_hearing"}
    assert parsed(spark, text.mapped_type, *names) == list(names.values())
    assert parsed(spark, text.severity_rank, "low", "CRITICAL", "odd") == [1, 4, 2]


def test_sections_are_analysed_where_long_enough(spark):
    docs = spark.createDataFrame([(1, "Section 1 " + "word " * 60), (2, "Section 2 short")], "doc_id long, text string")
    split = sections.split_sections(docs)
    got = external.analysed_sections(split, burdens, "doc_id").orderBy("match_ord").collect()
    assert [(r.doc_id, r.burden_type, r.severity, r.reform_suggestion, r.location) for r in got] == [(1, "wet_signature", "HIGH", "allow e-sign", "§ 1"), (1, "wet_signature", "MEDIUM", None, "§ 1")]
    assert external.analysed_sections(split, None, "doc_id").count() == 0
    assert external.analysed_sections(split, failing, "doc_id").count() == 0
    assert external.analysed_sections(split, lambda p: ["not json"] * len(p), "doc_id").count() == 0
    both = scan.merged(scan.taxonomy_findings(split).unionByName(external.analysed_sections(split, burdens, "doc_id")))
    assert [r.reform_suggestion for r in both.collect()] == ["allow e-sign"]


def test_one_bad_prompt_costs_its_own_answer_only(spark):
    def picky(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("no")
        return [p.upper() for p in prompts]

    rows = spark.createDataFrame([(x,) for x in ("a", "bad", "b", None, "c", "bad too")], "p string").coalesce(1)
    got = [r.answer for r in external.complete(rows, F.col("p"), picky).collect()]
    assert [a and a.text for a in got] == ["A", None, "B", None, "C", None] and got[1].error == "no" and got[3] is None
    short = external.complete(rows.where("p in ('a', 'b')"), F.col("p"), lambda p: p[:1]).collect()
    assert [r.answer.text for r in short] == ["a", "b"]


def test_a_scan_unites_findings_of_patterns_and_of_a_model(spark):
    body = "Section 1. Filing\nThe form is signed in ink. " + "word " * 60
    docs = spark.createDataFrame([(1, body), (2, "Section 2 in writing")], "doc_id long, text string")
    plain, both = scan.scan(docs), scan.scan(docs, completer=burdens)
    assert plain.columns == both.columns and scan.scan(docs, completer=failing).count() == plain.count()
    found = {(r.source_ord, r.burden_type): r for r in both.where("source_ord > 0").collect()}
    ours = found[(1, "wet_signature")] if (1, "wet_signature") in found else found[(2, "wet_signature")]
    assert ours.reform_suggestion == "allow e-sign" and ours.estimated_time_cost is None
    told = scan.analysis(docs, completer=burdens)
    counted, counters = scan.observed(told)
    rows = {r.doc_id: r for r in counted.collect()}
    assert "allow e-sign" in rows[1].recommendations and rows[1].citations == ["§ 1."]
    assert counters.get == {"documents_analyzed": 2, "burdens_identified": sum(len(r.findings or []) for r in rows.values())}


def test_comparison_through_a_model(spark):
    rows = spark.createDataFrame([("A", "a fee of $5 online", 0), ("B", "shall notarize within 3 days", 1)], "jurisdiction string, text string, input_ord int")
    answer = {"rankings": [{"jurisdiction": "B", "score": 2.5, "notes": "n"}], "key_differences": [{"aspect": "Fees", "details": {"A": "x"}}], "recommendations": ["do"], "model_provisions": [{"source": "B", "text": "t", "rationale": "r"}]}
    good = external.compared(rows, "fees", lambda p: ["```json\n" + json.dumps(answer) + "\n```"] * len(p)).first()
    assert good.rankings[0].jurisdiction == "B" and good.key_differences[0].details == {"A": "x"} and good.recommendations == ["do"] and good.model_provisions[0].rationale == "r"
    for completer in (None, failing, lambda p: ["not json"] * len(p)):
        plain = external.compared(rows, "fees", completer).first()
        assert [r.jurisdiction for r in plain.rankings] == ["A", "B"] and plain.model_provisions == [] and len(plain.recommendations) == 2
        assert [d.aspect for d in plain.key_differences] == ["Fees", "Timeframes", "Digital/Online Options"] and plain.key_differences[0].details == {"A": "$5", "B": "Not specified"}


def test_rewriting(spark):
    docs = spark.createDataFrame([(1, "Herein you shall be kept.")], "doc_id long, text string")
    assert external.rewritten(docs).first().confidence == 0.95
    good = external.rewritten(docs, lambda p: [ANSWER] * len(p)).first()
    assert good.rewritten_text == "You must sign." and good.confidence == 0.85 and good.warnings == ["a term"] and good.changes[0].after == "shorter"
    bad = external.rewritten(docs, failing).first()
    assert bad.rewritten_text == "in this document you is kept." and bad.confidence == 0.5 and "no model" in bad.warnings[0] and bad.changes == []
    assert external.engine_rewrite(docs).first().error == external.NO_KEY_REWRITE
    assert external.engine_rewrite(docs, lambda p: ["plain"] * len(p)).first().rewritten == "plain"


def test_gaps_bills_and_bands(spark):
    pairs = spark.createDataFrame([("S", "R", "law", "rule")], "statute_title string, regulation_title string, statute string, regulation string")
    none = external.gaps(pairs).first()
    assert (none.title, none.findings, none.confidence, none.error) == ("S vs R", [], 0.0, external.NO_KEY_GAPS)
    answer = '```json\n{"gaps": [{"type": "exceeds_authority", "analysis": "x"}], "alignment_score": 70, "summary": "s"}\n```'
    good = external.gaps(pairs, lambda p: [answer] * len(p)).first()
    assert good.findings[0]["type"] == "exceeds_authority" and good.confidence == 0.7 and good.summary == "s"
    assert external.gaps(pairs, lambda p: ["?"] * len(p)).first().findings == []
    bill = spark.createDataFrame([("Ohio", "a", "b")], "jurisdiction string, current_text string, best_practice_text string")
    assert external.model_bill(bill).first().bill == external.NO_KEY_BILL and external.model_bill(bill, lambda p: [f"{len(p)}"] * len(p)).first().bill == "1"
    assert parsed(spark, lambda c: external.alignment_band(c.cast("int")), "80", "60", "59") == ["high", "medium", "low"]
    assert parsed(spark, external.gap_icon, "Exceeds_authority", "missing") == ["🔴", "🟡"]
    split = sections.split_sections(spark.createDataFrame([(1, "Section 1 a Section 2 b")], "doc_id long, text string"))
    assert external.joined_sections(split, "doc_id").first().text == "Section 1 a\n\nSection 2 b"


def test_budgets_decide_before_texts_are_gathered(spark):
    rng = random.Random(3)
    rows = [(k, i, "x" * rng.choice([0, 1, 40, 300]) + str(i)) for k in ("a", "b", None) for i in rng.sample(range(500), 200)]
    rows += [("hot", i, f"line {i} " * 3) for i in range(5000)] + [("long", 1, "y" * 100_000), ("long", 2, "z"), ("twice", 1, "same"), ("twice", 1, "same"), ("twice", 0, None)]
    df = spark.createDataFrame(rows, "topic string, ord int, text string").repartition(7)
    for budget, cells in ((1000, 64), (37, 2), (1, 1)):
        got = {r.topic: r.text for r in external.budgeted(df, ["topic"], ["ord"], budget=budget, cells=cells).collect()}
        want = {k: "\n\n".join(t or "" for _, t in sorted((i, t) for j, i, t in rows if j == k))[:budget] for k in {r[0] for r in rows}}
        assert got == want
    assert external.budgeted(df.where("ord < 0"), [], ["ord"]).first().text == ""
    plan = external.budgeted(df, ["topic"], ["ord"])._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_pairs_of_statutes_and_regulations(spark):
    law = spark.createDataFrame([("fees", 2, 0, "b"), ("fees", 1, 1, "a2"), ("fees", 1, 0, "a1"), ("alone", 9, 0, "z")], "topic string, doc_id long, sec_pos int, text string")
    rule = spark.createDataFrame([("fees", 7, 0, "w" * 9000), ("fees", 8, 0, "never shown")], law.schema)
    got = external.paired(law, rule, ["topic"]).collect()
    assert [(r.topic, r.statute, r.regulation, r.statute_title, r.regulation_title) for r in got] == [("fees", "a1\n\na2\n\nb", "w" * 8000, "1", "7")]
    asked = []
    told = external.gaps(external.paired(law, rule, ["topic"]), lambda prompts: asked.extend(prompts) or ["no"] * len(prompts)).first()
    assert told.title == "1 vs 7" and told.findings == []
