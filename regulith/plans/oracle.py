"""The registered queries as SQL for DuckDB, written from the rules' meaning and sharing only catalogs with Spark."""

from __future__ import annotations

from ..functions import rules
from ..operators.scan import STATUTORY, TAXONOMY
from ..sources.licenses import LICENSES
from .corpus import CLAUSES

SPACE = r"^\s+|\s+$"


def q(x) -> str:
    if x is None:
        return "NULL"
    return str(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x).upper() if isinstance(x, bool) else "'" + x.replace("'", "''") + "'"


def rx(pattern: str) -> str:
    return q("(?i)" + pattern)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '{SPACE}', '', 'g')"


def n(x: str, pattern: str, fold: bool = True) -> str:
    return f"len(regexp_extract_all({x}, {rx(pattern) if fold else q(pattern)}))"


def values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(map(q, r)) + ")" for r in rows)


def with_(*parts: tuple[str, str]) -> str:
    return "WITH " + ",\n".join(f"{name} AS MATERIALIZED ({body})" for name, body in parts) + "\n"


CORPUS = (
    ("clauses(i, c)", values(enumerate(CLAUSES))),
    ("corpus", f"SELECT d.doc_id, d.source, a.c || chr(10) || coalesce(d.text, '') || chr(10) || b.c AS text FROM documents d JOIN clauses a ON a.i = d.doc_id % {len(CLAUSES)} JOIN clauses b ON b.i = (7 * d.doc_id + 3) % {len(CLAUSES)}"),
)
FOUND = " UNION ALL ".join(f"SELECT doc_id, text, regexp_extract_all(text, {rx(p)}, 0) AS m, regexp_extract_all(text, {rx(p)}, 1) AS g, string_split_regex(text, {rx(p)}) AS s FROM corpus WHERE regexp_matches(text, {rx(p)})" for p in rules.SECTION_MARKERS)


def start(k: str = "k") -> str:
    return f"(list_sum(list_transform(s[1:{k}], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:{k} - 1], lambda x: length(x))), 0))::BIGINT"


SECTIONS = (
    *CORPUS,
    ("found", FOUND),
    ("marks", "SELECT doc_id, text, m, g, s, unnest(range(1, len(m) + 1)) AS k FROM found"),
    ("starts", f"SELECT doc_id, text, {start()} AS st, g[k] AS id FROM marks"),
    ("cut", f"SELECT doc_id, row_number() OVER w - 1 AS sec_pos, id, {strip('substr(text, st + 1, coalesce(lead(st) OVER w, length(text)) - st)')} AS whole FROM starts WINDOW w AS (PARTITION BY doc_id ORDER BY st)"),
    ("lined", "SELECT *, instr(whole, chr(10)) AS line FROM cut"),
    (
        "sections",
        f"""SELECT doc_id, sec_pos::INTEGER AS sec_pos, id AS section_id, CASE WHEN line > 0 AND line - 1 < 200 THEN {strip('substr(whole, 1, line - 1)')} END AS title,
        CASE WHEN line > 0 AND line - 1 < 200 THEN {strip('substr(whole, line + 1)')} ELSE whole END AS text, '§ ' || id AS location FROM lined
        UNION ALL SELECT doc_id, 0, '1', NULL, {strip('text')}, '1' FROM corpus WHERE doc_id NOT IN (SELECT doc_id FROM starts)""",
    ),
)


def case(key: str, mapping: dict, default) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items()) + f" ELSE {q(default)} END"


RANK = {k: rules.SEVERITIES.index(v) + 1 for k, v in rules.TYPICAL_SEVERITY.items()}


def _matches(source: int, catalog, frm: str) -> str:
    return " UNION ALL ".join(
        f"SELECT doc_id, sec_pos, location, text, {source} AS source_ord, {i} AS rule_ord, {q(r.group)} AS grp, {q(r.burden_type)} AS burden_type, regexp_extract_all(text, {rx(r.pattern)}) AS m, string_split_regex(text, {rx(r.pattern)}) AS s FROM {frm} WHERE regexp_matches(text, {rx(r.pattern)})"
        for i, r in enumerate(catalog)
    )


def excerpt(context: int, stripped: bool) -> str:
    body = f"substr(text, greatest(0, st - {context}) + 1, least(length(text), st + size + {context}) - greatest(0, st - {context}))"
    return f"CASE WHEN st - {context} > 0 THEN '...' ELSE '' END || {strip(body) if stripped else body} || CASE WHEN st + size + {context} < length(text) THEN '...' ELSE '' END"


def _hits(name: str, source: int, catalog, frm: str, context: int, stripped: bool):
    return (
        (f"{name}_found", _matches(source, catalog, frm)),
        (f"{name}_each", f"SELECT *, unnest(range(1, len(m) + 1)) AS k FROM {name}_found"),
        (f"{name}_at", f"SELECT *, {start()} AS st, length(m[k]) AS size FROM {name}_each"),
        (f"{name}_hits", f"SELECT doc_id, sec_pos, location, source_ord, rule_ord, (k - 1)::INTEGER AS match_ord, st::INTEGER AS start, grp, burden_type, {excerpt(context, stripped)} AS text_excerpt FROM {name}_at"),
    )


ESCALATED = f"least(4, {case('burden_type', RANK, 2)} + greatest(0, " + ", ".join(f"CASE WHEN contains(lower(text_excerpt), {q(w)}) THEN {v} ELSE 0 END" for w, v in rules.ESCALATION.items()) + "))"
SEVERITY_LIST = "[" + ", ".join(map(q, rules.SEVERITIES)) + "]"
CATEGORY = case("burden_type", rules.CATEGORY, rules.DEFAULT_CATEGORY)
STAT = (*SECTIONS, *_hits("stat", 0, STATUTORY, "sections", 150, True), ("statutory", f"SELECT *, {ESCALATED} AS sev_rank, 'Statutory ' || replace(grp, '_', ' ') || ' requirement' AS explanation FROM stat_hits"))
ELIGIBLE = (
    ("sized", "SELECT *, len(regexp_extract_all(text, '\\S+')) AS words FROM sections"),
    ("counted", "SELECT *, row_number() OVER (PARTITION BY doc_id, words > 30 ORDER BY sec_pos) AS nth FROM sized"),
    ("eligible", "SELECT * FROM counted WHERE words > 30 AND nth <= 50"),
)
TAX = (*_hits("tax", 1, TAXONOMY, "eligible", 100, False), ("taxonomy", f"SELECT *, {case('burden_type', RANK, 2)} AS sev_rank, 'Pattern match: ' || burden_type AS explanation FROM tax_hits"))
MERGED = ("merged", "SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sec_pos, burden_type, location ORDER BY rule_ord, match_ord) AS nth FROM taxonomy) WHERE nth = 1")
FINDINGS = (*STAT, *ELIGIBLE, *TAX, MERGED, ("raw", "SELECT * FROM statutory UNION ALL BY NAME SELECT * FROM merged"), ("findings", f"SELECT *, {CATEGORY} AS category, {SEVERITY_LIST}[sev_rank] AS severity FROM raw"))
COLUMNS = "doc_id, sec_pos, source_ord::INTEGER AS source_ord, rule_ord::INTEGER AS rule_ord, match_ord, start, burden_type, category, severity, sev_rank::INTEGER AS sev_rank, location, text_excerpt, explanation"

PRIORITY = ("priority", "SELECT burden_type, max(sev_rank) AS mx, count(*) AS n, min((doc_id, sec_pos, source_ord, rule_ord, match_ord)) AS first FROM findings GROUP BY 1")
ADVICE = "CASE burden_type " + " ".join(f"WHEN {q(k)} THEN printf({q(v)}, n)" for k, v in rules.RECOMMENDATIONS.items()) + f" ELSE printf({q(rules.OTHER_RECOMMENDATION)}, burden_type, n) END"

# Readability: syllables by words
WORDS = ("SELECT {key}, unnest(regexp_extract_all(text, '\\S+')) AS w FROM {frm}", "regexp_replace(lower(w), '^[.,!?;:]+|[.,!?;:]+$', '', 'g')")


def flesch(frm: str) -> tuple:
    return (
        ("spoken", f"SELECT doc_id, {WORDS[1]} AS w FROM ({WORDS[0].format(key='doc_id', frm=frm)})"),
        ("syllables", "SELECT doc_id, sum(CASE WHEN w = '' THEN 0 ELSE greatest(1, len(regexp_extract_all(w, '[aeiouy]+')) - CASE WHEN w LIKE '%e' THEN 1 ELSE 0 END) END) AS syl FROM spoken GROUP BY 1"),
        ("parts", f"SELECT t.doc_id, greatest(1, len(regexp_extract_all(text, '[.!?]+'))) AS s, len(regexp_extract_all(text, '\\S+')) AS w, coalesce(syl, 0) AS syl FROM {frm} t LEFT JOIN syllables USING (doc_id)"),
        ("eased", "SELECT *, greatest(0.0::DOUBLE, least(100.0::DOUBLE, 206.835::DOUBLE - 1.015::DOUBLE * (greatest(w, 1)::DOUBLE / s) - 84.6::DOUBLE * (syl::DOUBLE / greatest(w, 1)))) AS ease FROM parts"),
    )


RATING = "CASE " + " ".join(f"WHEN ease >= {v} THEN {q(k)}" for k, v in rules.RATINGS.items()) + f" ELSE {q(rules.LOWEST_RATING)} END"
WHOLE = ("whole", "SELECT doc_id, coalesce(text, '') AS text FROM documents")
PASSIVE = " + ".join(n("text", p) for p in rules.PASSIVE)


def without_jargon(x: str) -> str:
    for term, plain in rules.JARGON.items():
        x = f"regexp_replace({x}, {q(rf'\b{term}\b')}, {q(plain)}, 'gi')"
    return f"regexp_replace({x}, '  +', ' ', 'g')"


JARGON_MATCHES = " UNION ALL ".join(f"SELECT doc_id, {i} AS term_ord, {q(plain or '(removed)')} AS after, unnest(regexp_extract_all(text, {rx(rf'\b{t}\b')})) AS before FROM corpus" for i, (t, plain) in enumerate(rules.JARGON.items()))

# Provisions: all documents of a source
NAMED = (*CORPUS, ("named", "SELECT * FROM corpus WHERE source <> '' AND text <> ''"))
SCORE = "greatest(1.0::DOUBLE, least(10.0::DOUBLE, 5.0::DOUBLE" + "".join(f" + {n('text', p)} * {w}::DOUBLE" for p, w in rules.SCORE_WEIGHTS.items()) + "))"
SUMMED_SCORE = "greatest(1.0::DOUBLE, least(10.0::DOUBLE, 5.0::DOUBLE" + "".join(f" + sum({n('text', p)})::DOUBLE * {w}::DOUBLE" for p, w in rules.SCORE_WEIGHTS.items()) + "))"
RANKED = ("ranked", f"SELECT source AS jurisdiction, min(doc_id) AS input_ord, round({SUMMED_SCORE}, 6) AS score, 'Based on ' || sum(len(regexp_extract_all(text, '\\S+'))) || ' words of regulation' AS notes FROM named GROUP BY 1")
NUMBERED = ("numbered", "SELECT *, row_number() OVER (ORDER BY score, input_ord)::INTEGER AS rank FROM ranked")
FEES = f"CASE WHEN regexp_matches(text, {q(rules.FEE)}) THEN array_to_string(list_transform(regexp_extract_all(text, {q(rules.FEE)}, 1)[1:3], lambda f: '$' || f), ', ') ELSE 'Not specified' END"
TIMES = f"CASE WHEN regexp_matches(text, {rx(rules.TIMEFRAME)}) THEN array_to_string(list_transform(range(1, least(3, len(regexp_extract_all(text, {rx(rules.TIMEFRAME)}, 1))) + 1), lambda i: regexp_extract_all(text, {rx(rules.TIMEFRAME)}, 1)[i] || ' ' || regexp_extract_all(text, {rx(rules.TIMEFRAME)}, 2)[i] || 's'), ', ') ELSE 'Not specified' END"
DIGITAL = f"CASE WHEN regexp_matches(text, {rx(rules.DIGITAL)}) THEN 'Available' ELSE 'Not mentioned' END"


TIME_LIST = f"list_transform(list_zip(regexp_extract_all(text, {rx(rules.TIMEFRAME)}, 1), regexp_extract_all(text, {rx(rules.TIMEFRAME)}, 2)), lambda x: x[1] || ' ' || x[2] || 's')"
FEE_LIST = f"list_transform(regexp_extract_all(text, {q(rules.FEE)}, 1), lambda f: '$' || f)"


def differing(aspect: str, detail: str) -> str:
    return with_(*NAMED, ("d", f"SELECT {q(aspect)} AS aspect, source AS jurisdiction, {detail} AS detail FROM named GROUP BY source")) + "SELECT * FROM d WHERE (SELECT count(DISTINCT detail) FROM d) > 1"


def first_three(items: str) -> str:
    return f"coalesce(nullif(array_to_string(flatten(list({items} ORDER BY doc_id))[1:3], ', '), ''), 'Not specified')"


LICENSE_COLUMNS = "license_key, state, license_type, training_hours, experience_days, processing_days, application_fee, exam_fee, license_fee, renewal_fee, exam_required, in_person_required, notarization_required, background_check, renewal_years, ce_hours_per_cycle, recent_reforms, burden_score, input_ord"
LIC = (f"lic({LICENSE_COLUMNS})", values((*r, i) for i, r in enumerate(LICENSES)))
_states, _keys = ("[" + ", ".join(map(q, sorted({r[i] for r in LICENSES}))) + "]" for i in (1, 0))
APPLIED = ("applied", f"SELECT ({_states})[1 + c_nationkey % len({_states})] AS state, ({_keys})[1 + c_custkey % len({_keys})] AS license_key, count(*)::BIGINT AS applications FROM customer GROUP BY ALL")


def applied(body: str, license_type: str | None = None, more: str = "") -> str:
    """Rows of states, and of licences unless one is given, with the number of applications."""
    own = f"(SELECT state, applications FROM applied WHERE license_key = {q(license_type)})" if license_type else "applied"
    return with_(LIC, APPLIED) + f"SELECT r.*, coalesce(a.applications, 0)::BIGINT AS applications{more} FROM ({body}) r LEFT JOIN {own} a USING (state{'' if license_type else ', license_key'})"

STAGED = ("staged", "SELECT user_id, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS scans, count(*) FILTER (WHERE event_type = 'purchase' AND value > 200) AS comparisons FROM events GROUP BY 1")
STAGE = "CASE WHEN comparisons > 0 THEN 'analyzed' WHEN scans > 0 THEN 'scanned' ELSE 'created' END"
INDEX = "list_position([" + ", ".join(map(q, rules.STAGES)) + "], stage) - 1"

_low = "lower(text)"
DOC_TYPE = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains({_low}, {q(p)})' for p in phrases)} THEN {q(kind)}" for kind, phrases in rules.DOCUMENT_TYPES.items()) + " ELSE 'unknown' END"
CROSS = q("(?i)" + rules.CROSS_REFERENCE)
COMPLEXITY = (
    "least(1.0::DOUBLE, (words::DOUBLE / greatest(sentences, 1) / 20) * 0.3::DOUBLE + (refs::DOUBLE / 5) * 0.2::DOUBLE"
    f" + ({n('text', rules.NESTED_CLAUSE, False)}::DOUBLE / 10) * 0.2::DOUBLE + ({n('text', rules.COMPLEX_JARGON)}::DOUBLE / 5) * 0.15::DOUBLE + ({n('text', rules.COMPLEX_PASSIVE, False)}::DOUBLE / 10) * 0.15::DOUBLE)"
)


#: Type of a free-text name, of which l is the lower case with "_" for blanks and hyphens.
MAPPED = (
    "CASE "
    + " ".join(f"WHEN contains(l, {q(t)}) OR contains({q(t)}, l) THEN {q(t)}" for t in rules.BURDEN_TYPES)
    + " "
    + " ".join(f"WHEN contains(l, {q(w)}) THEN {q(t)}" for w, t in rules.TYPE_WORDS.items())
    + f" ELSE {q(rules.DEFAULT_TYPE)} END"
)


def sql() -> dict[str, str]:
    by = lambda column: with_(*FINDINGS) + f"SELECT {column} AS value, count(*)::BIGINT AS n FROM findings GROUP BY 1"
    return {
        "readability": with_(WHOLE, *flesch("whole")) + f"SELECT doc_id, w::BIGINT AS words, s::BIGINT AS sentences, syl::BIGINT AS syllables, round(ease, 6) AS score, {RATING} AS rating FROM eased",
        "complexity_rating_counts": with_(WHOLE, *flesch("whole")) + f"SELECT {RATING} AS complexity_rating, count(*)::BIGINT AS documents FROM eased GROUP BY 1",
        "sections": with_(*SECTIONS) + "SELECT doc_id, sec_pos, section_id, title, text, location FROM sections",
        "section_word_counts": with_(*SECTIONS) + "SELECT doc_id, count(*)::BIGINT AS total_sections, sum(len(regexp_extract_all(text, '\\S+')))::BIGINT AS total_words FROM sections GROUP BY 1",
        "statutory_hits": with_(*STAT) + "SELECT burden_type, grp AS \"group\", count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS documents FROM statutory GROUP BY 1, 2",
        "taxonomy_hits": with_(*SECTIONS, ("eligible", "SELECT * FROM sections"), *TAX) + "SELECT burden_type, rule_ord::INTEGER AS rule_ord, count(*)::BIGINT AS n FROM taxonomy GROUP BY 1, 2",
        "severity_escalation": with_(*STAT) + f"SELECT burden_type, {case('burden_type', RANK, 2)}::INTEGER AS typical, sev_rank::INTEGER AS escalated, count(*)::BIGINT AS n FROM statutory GROUP BY 1, 2, 3",
        "scan_findings_patterns": with_(*FINDINGS) + f"SELECT {COLUMNS} FROM findings WHERE source_ord = 0",
        "scan_findings_combined": with_(*FINDINGS) + f"SELECT {COLUMNS} FROM findings",
        "merged_findings": with_(*SECTIONS, ("eligible", "SELECT * FROM sections"), *TAX)
        + "SELECT doc_id, location, burden_type, min((sec_pos, rule_ord, match_ord))[1]::INTEGER AS sec_pos, arg_min(text_excerpt, (sec_pos, rule_ord, match_ord)) AS text_excerpt FROM taxonomy GROUP BY 1, 2, 3",
        "burdens_by_type": by("burden_type"),
        "burdens_by_category": by("category"),
        "burdens_by_severity": by("severity"),
        "high_priority": with_(*FINDINGS) + f"SELECT {COLUMNS} FROM findings WHERE sev_rank >= 3",
        "scan_totals": with_(*FINDINGS)
        + "SELECT (SELECT count(*) FROM corpus)::BIGINT AS documents_scanned, (SELECT count(*) FROM sections)::BIGINT AS sections_analyzed, count(*)::BIGINT AS total_burdens, (count(*) FILTER (WHERE sev_rank >= 3))::BIGINT AS high_priority_count, (count(*) FILTER (WHERE sev_rank = 4))::BIGINT AS critical_count FROM findings",
        "scan_recommendations": with_(*FINDINGS, PRIORITY, ("top", "SELECT *, row_number() OVER (ORDER BY mx DESC, n DESC, first)::INTEGER AS rank FROM priority")) + f"SELECT rank, burden_type, {ADVICE} AS recommendation FROM top WHERE rank <= 5",
        "engine_recommendations": with_(*FINDINGS, ("said", "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec_pos, source_ord, rule_ord, match_ord)::INTEGER AS rank, 'Review and simplify ' || burden_type || ' requirement at ' || location AS recommendation FROM findings WHERE sev_rank >= 3"))
        + "SELECT * FROM said WHERE rank <= 10",
        "burden_summary": with_(*FINDINGS, ("per", "SELECT doc_id, count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE sev_rank = {i}) AS s{i}" for i in (1, 2, 3, 4)) + " FROM findings GROUP BY 1"))
        + "SELECT c.doc_id, CASE WHEN n IS NULL THEN 'No significant procedural burdens identified.' ELSE 'Identified ' || n || ' procedural burdens:' || "
        + " || ".join(f"CASE WHEN s{i} > 0 THEN chr(10) || '- {rules.SEVERITIES[i - 1]}: ' || s{i} ELSE '' END" for i in (4, 3, 2, 1))
        + " END AS summary FROM corpus c LEFT JOIN per USING (doc_id)",
        "doc_type": with_(*CORPUS) + f"SELECT doc_id, {DOC_TYPE} AS doc_type FROM corpus",
        "section_complexity": with_(*SECTIONS, ("refs", f"SELECT doc_id, regexp_extract_all(text, {CROSS}, 0) AS r FROM corpus"), ("sized", f"SELECT s.*, len(regexp_extract_all(s.text, '\\S+')) AS words, len(regexp_extract_all(s.text, '[.!?]+')) AS sentences, len(list_filter(r, lambda x: contains(s.text, x))) AS refs FROM sections s JOIN refs USING (doc_id)"))
        + f"SELECT doc_id, sec_pos, section_id, words::BIGINT AS words, sentences::BIGINT AS sentences, refs::BIGINT AS \"references\", round({COMPLEXITY}, 6) AS complexity FROM sized",
        "cross_references": with_(*CORPUS, ("r", f"SELECT doc_id, regexp_extract_all(text, {CROSS}, 0) AS raw, regexp_extract_all(text, {CROSS}, 1) AS sec FROM corpus"), ("e", "SELECT *, unnest(range(1, len(raw) + 1)) AS k FROM r")) + "SELECT doc_id, (k - 1)::INTEGER AS ref_pos, raw[k] AS raw_text, sec[k] AS section FROM e",
        "attached_references": with_(*SECTIONS, ("r", f"SELECT doc_id, regexp_extract_all(text, {CROSS}, 0) AS raw FROM corpus"), ("e", "SELECT *, unnest(range(1, len(raw) + 1)) AS k FROM r"))
        + "SELECT s.doc_id, s.sec_pos, (k - 1)::INTEGER AS ref_pos, raw[k] AS raw_text FROM sections s JOIN e ON s.doc_id = e.doc_id AND contains(s.text, raw[k])",
        "definitions": with_(*CORPUS, ("r", f"SELECT doc_id, regexp_extract_all(text, {rx(rules.DEFINITION)}, 1) AS a, regexp_extract_all(text, {rx(rules.DEFINITION)}, 2) AS b FROM corpus"), ("e", "SELECT *, unnest(range(1, len(a) + 1)) AS k FROM r"))
        + f"SELECT doc_id, lower(a[k]) AS term, arg_max({strip('b[k]')}, k) AS definition FROM e GROUP BY 1, 2",
        "citations": with_(*CORPUS, ("r", "SELECT doc_id, " + ", ".join(f"regexp_extract_all(text, {q(rules.CITATION)}, {g}) AS g{g}" for g in range(4)) + " FROM corpus"), ("e", "SELECT *, unnest(range(1, len(g0) + 1)) AS k FROM r"))
        + "SELECT doc_id, g0[k] AS raw_text, coalesce(g1[k], '') AS title, coalesce(g2[k], '') AS section, coalesce(g3[k], '') AS subsection FROM e",
        "jargon_rewrite": with_(*CORPUS) + f"SELECT doc_id, {without_jargon('text')} AS rewritten_text FROM corpus",
        "jargon_changes": with_(*CORPUS, ("found", JARGON_MATCHES)) + "SELECT doc_id, before, after, count(*)::BIGINT AS n FROM found GROUP BY 1, 2, 3",
        "complexity_report": with_(*CORPUS, *flesch("corpus"), ("jargon", JARGON_MATCHES), ("per", "SELECT doc_id, count(*) AS jn, array_to_string(list_sort(list_distinct(list(before)))[1:10], '|') AS examples FROM jargon GROUP BY 1"))
        + f"SELECT e.doc_id, round(ease, 6) AS readability_score, e.w::BIGINT AS word_count, e.s::BIGINT AS sentence_count, round(e.w::DOUBLE / e.s, 6) AS avg_sentence_length, ({PASSIVE})::BIGINT AS passive_voice_count, coalesce(jn, 0)::BIGINT AS jargon_count, coalesce(examples, '') AS jargon_examples, {RATING} AS complexity_rating FROM eased e JOIN corpus USING (doc_id) LEFT JOIN per USING (doc_id)",
        "long_sentences": with_(*CORPUS, ("l", "SELECT doc_id, list_filter(string_split_regex(text, '[.!?]+'), lambda x: len(regexp_extract_all(x, '\\S+')) > 30)[1:5] AS l FROM corpus"), ("e", "SELECT *, unnest(range(1, len(l) + 1)) AS k FROM l"))
        + f"SELECT doc_id, (k - 1)::INTEGER AS pos, substr({strip('l[k]')}, 1, 100) || '...' AS sentence FROM e",
        "provision_scores": with_(*CORPUS) + f"SELECT doc_id, round({SCORE}, 6) AS score, {FEES} AS fees, {TIMES} AS timeframes, {DIGITAL} AS digital FROM corpus",
        "burden_score_rank": with_(*NAMED, RANKED, NUMBERED) + "SELECT rank, jurisdiction, score, notes FROM numbered",
        "fee_differences": differing("Fees", first_three(FEE_LIST)),
        "timeframe_differences": differing("Timeframes", first_three(TIME_LIST)),
        "digital_options": differing("Digital/Online Options", f"CASE WHEN bool_or(regexp_matches(text, {rx(rules.DIGITAL)})) THEN 'Available' ELSE 'Not mentioned' END"),
        "basic_recommendations": with_(*NAMED, RANKED, NUMBERED, ("ends", "SELECT count(*) AS n, arg_min(jurisdiction, rank) AS best, arg_max(jurisdiction, rank) AS worst, arg_max(score, rank) AS top FROM numbered"))
        + "SELECT 0 AS ord, 'Consider adopting approaches from ' || best || ', which has the lowest burden score.' AS recommendation FROM ends WHERE n >= 2 UNION ALL SELECT 1, printf('Significant simplification opportunities exist - %s has a high burden score of %.1f.', worst, top) FROM ends WHERE n >= 2 AND top > 7 UNION ALL SELECT (CASE WHEN n < 2 THEN 0 WHEN top > 7 THEN 2 ELSE 1 END)::INTEGER, 'Conduct detailed analysis of specific provisions to identify model language.' FROM ends",
        "compare_states": applied("WITH asked(state, o) AS (" + values([("New York", 0), ("Texas", 1), ("Nowhere", 2), ("Florida", 3)]) + ") "
        "SELECT row_number() OVER (ORDER BY burden_score NULLS LAST, o)::INTEGER AS rank, state, training_hours::INTEGER AS training_hours, (application_fee + exam_fee + license_fee)::DOUBLE AS total_cost, processing_days::INTEGER AS processing_days, burden_score::INTEGER AS burden_score, recent_reforms, in_person_required, notarization_required FROM lic JOIN asked USING (state) WHERE license_key = 'cosmetology'", "cosmetology"),
        "best_practice_state": applied("SELECT license_key, arg_min(state, (coalesce(nullif(burden_score, 0), 10), input_ord)) AS state FROM lic GROUP BY 1"),
        "model_provisions": applied("SELECT license_key, row_number() OVER (PARTITION BY license_key ORDER BY burden_score NULLS LAST, input_ord)::INTEGER AS rank, state, recent_reforms AS reform, burden_score::INTEGER AS burden_score FROM lic WHERE recent_reforms <> ''"),
        "license_cost_time": applied("SELECT license_key, state, (application_fee + exam_fee + license_fee)::DOUBLE AS total_initial_cost, (experience_days + processing_days)::INTEGER AS total_time_days FROM lic", more=", r.total_initial_cost * coalesce(a.applications, 0) AS all_costs"),
        "stage_progress": with_(STAGED, ("s", f"SELECT user_id, scans, comparisons, {STAGE} AS stage FROM staged")) + f"SELECT user_id, scans::BIGINT AS scans, comparisons::BIGINT AS comparisons, stage, round(({INDEX})::DOUBLE / 6 * 100, 6) AS progress FROM s",
        "next_step": with_(STAGED, ("s", f"SELECT user_id, {STAGE} AS stage FROM staged")) + "SELECT stage, CASE stage WHEN 'created' THEN 'Use the Burden Scanner to analyze your target statute.' WHEN 'scanned' THEN 'Use the Gap Analyzer to compare against regulations.' WHEN 'analyzed' THEN 'Use the Cross-State Comparator to find best practices.' END AS next_step, count(*)::BIGINT AS projects FROM s GROUP BY 1, 2",
        "stage_rows": with_(STAGED, ("s", f"SELECT user_id, {STAGE} AS stage FROM staged"), ("all_stages(o, st)", values(enumerate(rules.STAGES)))) + f"SELECT user_id, o::INTEGER AS stage_ord, st AS stage, o = {INDEX} AS is_current, o < {INDEX} AS is_complete FROM s, all_stages",
        "project_upsert": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1",
        "type_mapping": "WITH words AS (SELECT DISTINCT event_type AS name FROM events UNION SELECT DISTINCT p_name FROM part UNION SELECT unnest(['', 'Wet Signature', 'late fees', 'notarised', 'an in-person visit', 'long wait', 'reporting', 'paper-only forms', 'mail', 'vague'])), low AS (SELECT name, translate(lower(name), ' -', '__') AS l FROM words) SELECT name, "
        + f"{MAPPED} AS burden_type FROM low",
    }
