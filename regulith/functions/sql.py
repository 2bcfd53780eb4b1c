"""The text functions as functions of Spark SQL, so that a query in SQL text calls them without Python.

``register`` creates temporary functions ``legal_…`` in a session. Their bodies are expressions over the same
catalogs as the columns in ``text``, which Spark puts in place of each call, so plans are those of the DataFrame form.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import SparkSession

from . import rules, rx
from .text import WORD


class Function(NamedTuple):
    parameters: str
    returns: str
    body: str


def q(x: str) -> str:
    """A literal of Spark SQL."""
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _choice(pairs, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {condition} THEN {value}" for condition, value in pairs) + f" ELSE {otherwise} END"


def _count(pattern: str) -> str:
    return f"regexp_count(t, {q(rx.fold(pattern))})"


def definitions() -> dict[str, Function]:
    """Name → parameters, type and body."""
    words, sentences = f"CAST(regexp_count(t, {q(WORD)}) AS BIGINT)", f"CAST({_count(rules.SENTENCE_END)} AS BIGINT)"
    bare = f"regexp_replace(lower(w), {q(r'^[.,!?;:]+|[.,!?;:]+' + chr(92) + 'z')}, '')"
    spoken = f"CASE WHEN {bare} = '' THEN 0 ELSE greatest(1, regexp_count({bare}, '[aeiouy]+') - CAST(endswith({bare}, 'e') AS INT)) END"
    syllables = f"aggregate(regexp_extract_all(t, {q(WORD)}, 0), 0L, (n, w) -> n + CAST({spoken} AS BIGINT))"
    ease = f"greatest(0.0D, least(100.0D, 206.835D - 1.015D * (greatest({words}, 1) / greatest({sentences}, 1)) - 84.6D * ({syllables} / greatest({words}, 1))))"
    weighed = " + ".join(f"{_count(p)} * {w}D" for p, w in rules.SCORE_WEIGHTS.items())
    fees = f"slice(regexp_extract_all(t, {q(rx.cased(rules.FEE))}, 1), 1, 3)"
    part = lambda g: f"slice(regexp_extract_all(t, {q(rx.fold(rules.TIMEFRAME))}, {g}), 1, 3)"
    low = "translate(lower(name), ' -', '__')"
    types = [(f"contains({low}, {q(k)}) OR contains({q(k)}, {low})", q(k)) for k in rules.BURDEN_TYPES] + [(f"contains({low}, {q(w)})", q(k)) for w, k in rules.TYPE_WORDS.items()]
    kinds = [(" OR ".join(f"contains(lower(t), {q(p)})" for p in phrases), q(kind)) for kind, phrases in rules.DOCUMENT_TYPES.items()]
    stages = "array(" + ", ".join(map(q, rules.STAGES)) + ")"
    return {
        "words": Function("t STRING", "BIGINT", words),
        "sentences": Function("t STRING", "BIGINT", sentences),
        "syllables": Function("t STRING", "BIGINT", syllables),
        "readability": Function("t STRING", "DOUBLE", ease),
        "rating": Function("score DOUBLE", "STRING", _choice([(f"score >= {least}", q(name)) for name, least in rules.RATINGS.items()], q(rules.LOWEST_RATING))),
        "document_type": Function("t STRING", "STRING", _choice(kinds, "'unknown'")),
        "burden_score": Function("t STRING", "DOUBLE", f"greatest({rules.SCORE_LOW}D, least({rules.SCORE_HIGH}D, {rules.SCORE_START}D + {weighed}))"),
        "fees": Function("t STRING", "STRING", f"CASE WHEN size({fees}) > 0 THEN array_join(transform({fees}, f -> concat('$', f)), ', ') ELSE 'Not specified' END"),
        "timeframes": Function("t STRING", "STRING", f"CASE WHEN size({part(1)}) > 0 THEN array_join(zip_with({part(1)}, {part(2)}, (n, u) -> concat(n, ' ', u, 's')), ', ') ELSE 'Not specified' END"),
        "digital": Function("t STRING", "STRING", f"CASE WHEN rlike(t, {q(rx.fold(rules.DIGITAL))}) THEN 'Available' ELSE 'Not mentioned' END"),
        "burden_type": Function("name STRING", "STRING", _choice(types, q(rules.DEFAULT_TYPE))),
        "category": Function("kind STRING", "STRING", _choice([(f"kind = {q(k)}", q(v)) for k, v in rules.CATEGORY.items()], q(rules.DEFAULT_CATEGORY))),
        "severity_rank": Function("name STRING", "INT", _choice([(f"upper(name) = {q(s)}", str(i)) for i, s in enumerate(rules.SEVERITIES, 1)], "2")),
        "stage_progress": Function("stage STRING", "DOUBLE", f"(nullif(array_position({stages}, stage), 0) - 1) / {len(rules.STAGES) - 1} * 100"),
    }


def register(spark: SparkSession, prefix: str = "legal_") -> list[str]:
    """Creates the functions in the session, and ``legal_report``, a table of a text's figures; gives their names."""
    made = definitions()
    for name, f in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({f.parameters}) RETURNS {f.returns} RETURN {f.body}")
    figures = f"SELECT {prefix}words(t), {prefix}sentences(t), {prefix}readability(t), {prefix}rating({prefix}readability(t)), {prefix}document_type(t)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}report(t STRING) RETURNS TABLE(words BIGINT, sentences BIGINT, score DOUBLE, rating STRING, doc_type STRING) RETURN {figures}")
    return [f"{prefix}{name}" for name in (*made, "report")]
