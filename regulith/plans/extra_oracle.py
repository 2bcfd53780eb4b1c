"""SQL for DuckDB of the queries in ``extra``."""

from __future__ import annotations

from ..functions.rules import STAGES
from . import oracle
from .oracle import CATEGORY, FINDINGS, MAPPED, q, with_

#: The files that can be read, in place of all documents.
READABLE = tuple((n, b.replace("FROM documents d", "FROM (SELECT * FROM documents WHERE doc_id % 4 <> 3) d") if n == "corpus" else b) for n, b in FINDINGS)
NEWLINES = r"replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))"


def sql() -> dict[str, str]:
    stages = "[" + ", ".join(map(q, STAGES)) + "]"
    step = "CASE WHEN e.kind = 'set' THEN e.too WHEN e.kind = 'scan' AND s.too = 'created' THEN 'scanned' WHEN e.kind = 'comparison' AND s.too IN ('created', 'scanned') THEN 'analyzed' ELSE s.too END"
    run = lambda start: f"list_reduce(e, lambda s, e: {{'kind': 'x', 'too': {step}}}, {{'kind': 'x', 'too': {q(start)}}}).too"
    own = ("own", "SELECT f.*, coalesce(c.source, '') AS src FROM findings f JOIN corpus c USING (doc_id)")
    least = "min((doc_id, sec_pos, source_ord, rule_ord, match_ord))[1]::BIGINT AS first_doc"
    grouped = " UNION ALL ".join(f"SELECT src AS source, {q(d)} AS dimension, {c} AS value, count(*)::BIGINT AS n, {least} FROM own GROUP BY ALL" for d, c in (("by_type", "burden_type"), ("by_category", "category"), ("by_severity", "severity"), ("all", "NULL::VARCHAR")))
    places = ("places", "SELECT coalesce(source, '') AS source, doc_id FROM corpus")
    rolled = " UNION ALL ".join((
        "SELECT source, 'documents' AS dimension, '' AS value, count(*)::BIGINT AS n FROM places GROUP BY 1",
        "SELECT source, 'sections', '', count(*)::BIGINT FROM sections JOIN places USING (doc_id) GROUP BY 1",
        "SELECT src, 'by_type', burden_type, count(*)::BIGINT FROM own GROUP BY 1, 3", "SELECT src, 'by_category', category, count(*)::BIGINT FROM own GROUP BY 1, 3",
    ))
    return {
        "sql_readability": oracle.sql()["readability"],
        "sql_provision_scores": oracle.sql()["provision_scores"],
        "sql_type_mapping": f"WITH low AS (SELECT p_name AS name, translate(lower(p_name), ' -', '__') AS l FROM part), typed AS (SELECT name, {MAPPED} AS burden_type FROM low) SELECT name, burden_type, {CATEGORY} AS category, count(*)::BIGINT AS n FROM typed GROUP BY 1, 2, 3",
        "stage_machine": f"""WITH kinds AS (SELECT user_id, ts, event_id, CASE WHEN event_type IN ('view', 'click') THEN 'scan' WHEN event_type = 'purchase' THEN 'comparison' ELSE 'set' END AS kind, {stages}[1 + event_id % {len(STAGES)}] AS too FROM events),
            runs AS (SELECT user_id, list({{'kind': kind, 'too': too}} ORDER BY ts, event_id) AS e FROM kinds GROUP BY 1),
            done AS (SELECT user_id, len(e)::BIGINT AS events, {run('created')} AS stage, {run('drafted')} AS stage_of_a_draft FROM runs)
            SELECT *, round((list_position({stages}, stage) - 1)::DOUBLE / {len(STAGES) - 1} * 100, 6) AS progress FROM done""",
        "finding_counts": with_(*FINDINGS, own) + grouped,
        "report_findings": with_(*FINDINGS, own) + "SELECT src AS jurisdiction, doc_id, burden_type AS type, category, severity, location, substr(text_excerpt, 1, 200) AS excerpt, NULL::VARCHAR AS reform FROM own",
        "report_heads": with_(*FINDINGS, own, places, ("n", "SELECT source, count(DISTINCT doc_id) AS d, count(*) AS s FROM sections JOIN places USING (doc_id) GROUP BY 1"))
        + """SELECT source AS jurisdiction, d::BIGINT AS documents_scanned, s::BIGINT AS sections_analyzed, (SELECT count(*) FROM own WHERE src = source)::BIGINT AS total_burdens,
            (SELECT count(*) FROM own WHERE src = source AND sev_rank >= 3)::BIGINT AS high_priority_count, (SELECT count(DISTINCT burden_type) FROM own WHERE src = source)::BIGINT AS types FROM n""",
        "result_blobs": """SELECT user_id::VARCHAR AS id, count(*)::BIGINT AS burdens_found, nullif(count(*) FILTER (WHERE event_type = 'click'), 0)::BIGINT AS clicks,
            max(value) FILTER (WHERE event_type = 'purchase') AS most, NULL::INTEGER AS wrong, true AS no_draft, true AS same FROM events GROUP BY user_id""",
        "stream_rollup": with_(*FINDINGS, own, places) + rolled,
        "file_formats": f"""SELECT doc_id, 'docs/' || doc_id || ['.txt', '.docx', '.pdf', '.md'][1 + doc_id % 4] AS path,
            CASE doc_id % 4 WHEN 0 THEN {NEWLINES} WHEN 3 THEN NULL ELSE coalesce(text, '') END AS text,
            CASE WHEN doc_id % 4 = 3 THEN 'ValueError: Unsupported file type: .md' END AS error FROM documents""",
        "directory_scan": with_(*READABLE)
        + """SELECT (SELECT count(*) FROM corpus)::BIGINT AS documents_scanned, (SELECT count(*) FROM sections)::BIGINT AS sections_analyzed, count(*)::BIGINT AS total_burdens,
            (count(*) FILTER (WHERE sev_rank >= 3))::BIGINT AS high_priority_count, (count(*) FILTER (WHERE sev_rank = 4))::BIGINT AS critical_count,
            (SELECT count(*) FROM documents WHERE doc_id % 4 = 3)::BIGINT AS files_with_errors FROM findings""",
    }
