"""SQL for DuckDB of the queries in ``more``."""

from __future__ import annotations

from ..functions import rules
from ..operators import external, rewrite, workflow
from ..sources.licenses import SAMPLE_STATUTES
from . import more
from .oracle import APPLIED, CATEGORY, COLUMNS, CORPUS, FINDINGS, JARGON_MATCHES, LIC, MAPPED, NAMED, NUMBERED, RANKED, SECTIONS, SEVERITY_LIST, STAGE, STAGED, TAX, case, applied, flesch, q, values, with_, without_jargon

STAGED_AS = (STAGED, ("s", f"SELECT user_id::VARCHAR AS id, 'Project ' || user_id AS name, {STAGE} AS stage FROM staged"))


def model_rows(frm: str) -> tuple[tuple[str, str], ...]:
    n = f"({len(external.BURDEN_HEAD)} + least({external.LIMITS['scan']}, length(text)))"
    names = "[" + ", ".join(map(q, more.TYPES)) + "]"
    levels = "[" + ", ".join(map(q, more.LEVELS)) + "]"
    return (
        ("asked", f"SELECT doc_id, sec_pos, location, {n} AS n FROM {frm} WHERE len(regexp_extract_all(text, '\\S+')) > {external.LEAST_WORDS}"),
        ("answered", f"SELECT *, {names}[1 + n % 5] AS name, {levels}[1 + n % 3] AS level, translate(lower({names}[1 + n % 5]), ' -', '__') AS l FROM asked"),
        ("model", f"SELECT doc_id, sec_pos, location, {MAPPED} AS burden_type, {case('level', {'high': 3, 'critical': 4}, 2)} AS sev_rank, 'of ' || n AS text_excerpt, 'use forms' AS reform_suggestion FROM answered"),
    )


def sql() -> dict[str, str]:
    chosen = ", ".join(map(q, more.CHOSEN))
    named = lambda words: f"SELECT DISTINCT o_orderpriority AS name FROM orders UNION SELECT unnest([{', '.join(map(q, words))}])"
    steps = "CASE name " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in workflow.NEXT_STEP.items()) + " END"
    summary = (
        "CASE WHEN n IS NULL THEN 'No significant procedural burdens identified.' ELSE 'Identified ' || n || ' procedural burdens:' || "
        + " || ".join(f"CASE WHEN s{i} > 0 THEN chr(10) || '- {rules.SEVERITIES[i - 1]}: ' || s{i} ELSE '' END" for i in (4, 3, 2, 1))
        + " END"
    )
    pairs = ("training_hours", "total_cost", "processing_days", "in_person_required", "notarization_required", "burden_score")
    mark = lambda c: f"CASE WHEN {c} THEN '✅' ELSE '❌' END"
    shown = {"training_hours": "training_hours::VARCHAR", "total_cost": "'$' || (application_fee + exam_fee + license_fee)::INTEGER", "processing_days": "processing_days::VARCHAR", "in_person_required": mark("in_person_required"), "notarization_required": mark("notarization_required"), "burden_score": "burden_score::VARCHAR", "applications": "applications::VARCHAR"}
    rewritten = f"SELECT doc_id, {without_jargon('text')} AS text FROM corpus"
    length = f"({len(external.rewrite_head())} + least({external.LIMITS['rewrite']}, length(text)))"
    gap = f"({sum(map(len, external.GAP_HEADS))} + length(statute) + length(regulation))"
    bill = f"({sum(map(len, external.BILL_HEADS))} + length(jurisdiction) + length(current_text) + length(best_text))"
    side = lambda odd, name: (name, f"SELECT source, substr(string_agg(text, chr(10) || chr(10) ORDER BY doc_id, sec_pos), 1, 8000) AS {name}, min(doc_id)::VARCHAR AS {name}_title FROM sections JOIN (SELECT doc_id, source FROM corpus) USING (doc_id) WHERE doc_id % 2 = {odd} GROUP BY source")
    pairs_of = (*SECTIONS, side(0, "statute"), side(1, "regulation"), ("pairs", "SELECT * FROM statute JOIN regulation USING (source)"))
    own = ("own", "SELECT source AS jurisdiction, arg_max(text, doc_id) AS text, min(doc_id) AS input_ord FROM named GROUP BY 1")
    parts = lambda name, frm: tuple((f"{name}_{a}" if a in ("spoken", "syllables", "parts", "eased") else a, _renamed(b, name)) for a, b in flesch(frm))
    return {
        "scan_min_severity": with_(*FINDINGS) + f"SELECT {COLUMNS} FROM findings WHERE sev_rank >= 3 AND burden_type IN ({chosen})",
        "findings_export": with_(*FINDINGS) + "SELECT burden_type AS type, category, severity, location, substr(text_excerpt, 1, 200) AS excerpt, NULL::VARCHAR AS reform FROM findings",
        "engine_analysis": with_(
            *SECTIONS, ("eligible", "SELECT * FROM sections"), *TAX, ("united", "SELECT doc_id, location, burden_type, max(sev_rank) AS sev_rank FROM taxonomy GROUP BY 1, 2, 3"),
            ("per", "SELECT doc_id, count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE sev_rank = {i}) AS s{i}" for i in (1, 2, 3, 4)) + " FROM united GROUP BY 1"),
            ("cited", "SELECT doc_id, string_agg(location, '|' ORDER BY sec_pos) AS c FROM sections WHERE doc_id IN (SELECT doc_id FROM starts) GROUP BY 1"),
        )
        + f"SELECT c.doc_id, 'burden_scan' AS mode, 'Untitled' AS document_title, {summary} AS summary, coalesce(n, 0)::BIGINT AS findings, coalesce(cited.c, '') AS citations, least(10, coalesce(s3 + s4, 0))::BIGINT AS recommendations FROM corpus c LEFT JOIN per USING (doc_id) LEFT JOIN cited USING (doc_id)",
        "rewrite_documents": with_(*CORPUS, ("plain", rewritten), *parts("a", "corpus"), *parts("b", "plain"), ("jargon", JARGON_MATCHES), ("per", "SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, term_ord, before FROM jargon) GROUP BY 1"))
        + f"SELECT c.doc_id, round(a.ease, 6) AS readability_before, round(b.ease, 6) AS readability_after, coalesce(per.n, 0)::BIGINT AS changes, {rewrite.CONFIDENCE}::DOUBLE AS confidence, {q(rewrite.WARNING)} AS warning FROM corpus c JOIN a_eased a USING (doc_id) JOIN b_eased b USING (doc_id) LEFT JOIN per USING (doc_id)",
        "citation_strings": with_(*CORPUS, ("r", "SELECT doc_id, " + ", ".join(f"regexp_extract_all(text, {q(rules.CITATION)}, {g}) AS g{g}" for g in range(4)) + " FROM corpus"), ("e", "SELECT *, unnest(range(1, len(g0) + 1)) AS k FROM r"))
        + "SELECT doc_id, g0[k] AS raw_text, coalesce(nullif(concat_ws(' ', CASE WHEN g1[k] <> '' THEN 'Title ' || g1[k] END, CASE WHEN g2[k] <> '' THEN '§ ' || g2[k] END, CASE WHEN g3[k] <> '' THEN '(' || g3[k] || ')' END), ''), g0[k]) AS citation FROM e",
        "non_blank_documents": "SELECT doc_id FROM documents WHERE regexp_matches(text, '\\S')",
        "severity_ranks": f"SELECT name, coalesce(list_position([{', '.join(map(q, rules.SEVERITIES))}], upper(name)), 2)::INTEGER AS severity_rank FROM ({named(more.SEVERITY_NAMES)})",
        "ranking_marks": with_(*NAMED, RANKED, NUMBERED) + "SELECT rank, jurisdiction, CASE rank WHEN 1 THEN '🥇' WHEN 2 THEN '🥈' WHEN 3 THEN '🥉' ELSE '🔹' END AS medal, CASE WHEN score <= 3 THEN '🟢' WHEN score <= 6 THEN '🟡' ELSE '🔴' END AS light FROM numbered",
        "license_lookup": applied("SELECT license_key, state, burden_score::INTEGER AS burden_score FROM lic WHERE license_key = 'cosmetology' OR (license_key = 'contractor' AND state = 'Texas')"),
        "states_side_by_side": with_(LIC, APPLIED, ("c", "SELECT lic.*, coalesce(applications, 0) AS applications FROM lic LEFT JOIN applied USING (state, license_key) WHERE license_key = 'cosmetology'")) + " UNION ALL ".join(f"SELECT {q(a)} AS attribute, max(CASE WHEN state = 'Florida' THEN {shown[a]} END) AS \"Florida\", max(CASE WHEN state = 'Texas' THEN {shown[a]} END) AS \"Texas\" FROM c" for a in (*pairs, "applications")),
        "sample_provisions": with_(LIC, APPLIED, ("samples(name, body)", values(SAMPLE_STATUTES.items()))) + "SELECT state, license_type, length(body)::INTEGER AS characters, coalesce(applications, 0)::BIGINT AS applications FROM lic JOIN samples ON name = state || ' ' || license_type LEFT JOIN applied USING (state, license_key)",
        "project_changes": "WITH changes AS (SELECT user_id, ts, 0 AS v, arg_max(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1, 2 UNION ALL SELECT user_id, ts, 1, arg_max(event_id, (ts, event_id)) FROM events WHERE event_type = 'purchase' GROUP BY 1, 2), "
        "newest AS (SELECT user_id, arg_max(event_id, (ts, v)) AS event_id FROM changes GROUP BY 1) SELECT user_id, event_id, event_type, value FROM newest JOIN events USING (user_id, event_id)",
        "project_advance": f"WITH e AS (SELECT [{', '.join(map(q, rules.STAGES))}][1 + event_id % {len(rules.STAGES)}] AS stage, CASE WHEN event_type IN ('view', 'click') THEN 'scan' WHEN event_type = 'purchase' THEN 'comparison' ELSE 'note' END AS event FROM events) "
        "SELECT stage, event, CASE WHEN event = 'scan' AND stage = 'created' THEN 'scanned' WHEN event = 'comparison' AND stage IN ('created', 'scanned') THEN 'analyzed' ELSE stage END AS next, count(*)::BIGINT AS n FROM e GROUP BY 1, 2, 3",
        "project_delete": with_(*STAGED_AS) + "SELECT id, stage FROM s WHERE id NOT IN ('1', '2', '30')",
        "project_moves": with_(*STAGED_AS) + "SELECT id, 'drafted' AS stage, 50.0::DOUBLE AS progress, '📝' AS icon FROM s",
        "project_notes": with_(*STAGED_AS) + "SELECT id, 1 AS n, 'note on ' || name AS note FROM s",
        "project_scans": with_(*STAGED_AS) + "SELECT id, CASE WHEN stage = 'created' THEN 'scanned' ELSE stage END AS stage, '{\"burdens_found\":3}' AS scan_results, least(500, 100 * length(name))::INTEGER AS characters FROM s",
        "project_json": with_(*STAGED_AS) + "SELECT name, 'Ohio' AS state, 'fees' AS topic, stage, 'a' AS tags FROM s",
        "stage_icons": f"SELECT name, {case('name', workflow.ICONS, '📋')} AS icon, {steps} AS next_step FROM ({named(rules.STAGES)})",
        "model_findings": with_(*SECTIONS, *model_rows("sections")) + f"SELECT doc_id, sec_pos, burden_type, {CATEGORY} AS category, {SEVERITY_LIST}[sev_rank] AS severity, location, text_excerpt, reform_suggestion FROM model",
        "united_findings": with_(*FINDINGS, *model_rows("eligible"))
        + f"SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.sec_pos, b.sec_pos)::INTEGER AS sec_pos, (CASE WHEN a.doc_id IS NULL THEN 2 ELSE 1 END)::INTEGER AS source_ord, coalesce(a.burden_type, b.burden_type) AS burden_type, {SEVERITY_LIST}[coalesce(b.sev_rank, a.sev_rank)] AS severity, coalesce(b.text_excerpt, a.text_excerpt) AS text_excerpt, b.reform_suggestion FROM merged a FULL JOIN model b ON a.doc_id = b.doc_id AND a.sec_pos = b.sec_pos AND a.burden_type = b.burden_type",
        "model_rewrite": with_(*CORPUS, ("plain", rewritten), ("n", f"SELECT doc_id, {length} AS n FROM plain")) + "SELECT doc_id, 'plain ' || n AS rewritten_text, (n % 101)::DOUBLE / 100 AS confidence, 2::BIGINT AS changes, 'check ' || n % 7 AS warning FROM n",
        "gap_pairs": with_(*pairs_of) + "SELECT source, statute, regulation, statute_title, regulation_title FROM pairs",
        "model_gaps": with_(*pairs_of, ("n", f"SELECT *, {gap} AS n FROM pairs"))
        + "SELECT concat_ws(' vs ', statute_title, regulation_title) AS title, 's' AS summary, round((n % 101)::DOUBLE / 100, 6) AS confidence, CASE WHEN n % 101 >= 80 THEN 'high' WHEN n % 101 >= 60 THEN 'medium' ELSE 'low' END AS band, CASE WHEN n % 2 = 0 THEN '🔴' ELSE '🟡' END AS icon FROM n",
        "model_bills": with_(*NAMED, RANKED, NUMBERED, ("texts", "SELECT source AS jurisdiction, substr(string_agg(text, chr(10) || chr(10) ORDER BY doc_id), 1, 8000) AS current_text FROM corpus WHERE source <> '' GROUP BY 1"), ("best", "SELECT t.jurisdiction AS best, current_text AS best_text FROM numbered n JOIN texts t USING (jurisdiction) WHERE rank = 1"))
        + f"SELECT jurisdiction, best, 'bill ' || {bill} AS bill FROM texts, best",
        "provisions": with_(*NAMED, own) + "SELECT jurisdiction, text, input_ord FROM own",
        "model_comparison": with_(*NAMED, own, ("shown", "SELECT substr(string_agg('=== ' || jurisdiction || ' ===' || chr(10) || text, chr(10) || chr(10) ORDER BY input_ord), 1, 10000) AS f FROM own"),
            ("names", f"SELECT regexp_extract_all(f, '(?m)^=== (.*) ===$', 1) AS names, length(f) + {len(external.COMPARISON_HEADS[0]) + len('filing') + len(external.COMPARISON_HEADS[1])} AS n FROM shown"))
        + "SELECT 'filing' AS topic, array_to_string(list_reverse(list_transform(names, lambda x: x || ':' || length(x) || ':' || n)), '|') AS rankings, len(names) || ' shown' AS recommendations, 0::INTEGER AS models FROM names",
    }


def _renamed(body: str, name: str) -> str:
    for table in ("spoken", "syllables", "parts", "eased"):
        body = body.replace(f" {table}", f" {name}_{table}")
    return body
