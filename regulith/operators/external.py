"""Steps that a language model may take, as an interface.

A completer is any function from prompts to answers, list to list; it runs in Arrow
batches on the executors. Without one, and where a call fails, every step falls back to
what it gives without a model. Answers are parsed by Spark expressions.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rx, text
from . import compare
from . import rewrite as plain

Completer = Callable[[list[str]], list[str]]

# What is said where there is no model.
NO_KEY_REWRITE = "API key required for plain language rewriting"
NO_KEY_GAPS = "API key required for gap analysis"
NO_KEY_BILL = "API key required for model bill generation."
#: Characters of text in a prompt, and words that a section must exceed to be asked about.
LIMITS = {"scan": 4000, "rewrite": 6000, "gap": 8000, "comparison": 10000}
LEAST_WORDS = 50


def _asked(completer: Completer, prompts: list[str]) -> list[dict]:
    """Answers to a batch; where the batch fails, to one prompt after another, so that one bad prompt costs its own answer only."""
    try:
        answers = list(completer(prompts))
        if len(answers) != len(prompts):
            raise ValueError(f"{len(answers)} answers to {len(prompts)} prompts")
        return [{"text": a, "error": None} for a in answers]
    except Exception as e:  # noqa: BLE001  a failing model mustn't fail the scan
        if len(prompts) == 1:
            return [{"text": None, "error": str(e)}]
        return [told for p in prompts for told in _asked(completer, [p])]


def complete(df: DataFrame, prompt: Column, completer: Completer | None, name: str = "answer") -> DataFrame:
    """Adds struct ``name``<text, error>: the answer, or what went wrong; both null without a completer or a prompt."""
    kind = "struct<text: string, error: string>"
    if completer is None:
        return df.withColumn(name, F.lit(None).cast(kind))

    def batch(prompts: pa.Array) -> pa.Array:
        asked = prompts.to_pylist()
        some = [p for p in asked if p is not None]
        answers = iter(_asked(completer, some) if some else [])
        return pa.array([next(answers) if p is not None else None for p in asked], pa.struct([("text", pa.string()), ("error", pa.string())]))

    return df.withColumn(name, F.arrow_udf(batch, kind)(prompt))


# Prompts --------------------------------------------------------------------------------


BURDEN_HEAD = 'List the procedural burdens of this legal text as JSON {"burdens": [{"text_excerpt", "burden_type", "severity", "affected_parties", "estimated_impact", "reform_recommendation"}]}.\n\n'
GAP_HEADS = ('Where does the regulation go beyond the statute or leave something out? JSON {"gaps": [{"type", "regulation_text", "statute_text", "analysis", "recommendation"}], "alignment_score": 0-100, "summary"}.\n\nSTATUTE\n', "\n\nREGULATION\n")
COMPARISON_HEADS = ("Compare these provisions on ", '. JSON {"rankings": [{"jurisdiction", "score", "notes"}], "key_differences": [{"aspect", "details"}], "model_provisions": [{"source", "text", "rationale"}], "recommendations"}.\n\n')
BILL_HEADS = ("Draft a model bill for ", ".\n\nCURRENT LAW\n", "\n\nBEST PRACTICE\n")


def burden_prompt(body: Column) -> Column:
    return F.concat(F.lit(BURDEN_HEAD), F.substring(body, 1, LIMITS["scan"]))


def rewrite_head(audience: str = "general_public", keep_structure: bool = False) -> str:
    return f"Rewrite this text in plain language for readers of level {audience}, {'keeping its paragraphs' if keep_structure else 'restructured where that helps'}. Answer under the headings REWRITTEN TEXT:, CHANGES MADE:, LEGAL CONFIDENCE: and WARNINGS:.\n\n"


def rewrite_prompt(body: Column, audience: str = "general_public", keep_structure: bool = False) -> Column:
    """``audience`` is one of ``rules.READABILITY_LEVELS``."""
    return F.concat(F.lit(rewrite_head(audience, keep_structure)), F.substring(body, 1, LIMITS["rewrite"]))


def gap_prompt(statute: Column, regulation: Column) -> Column:
    shown = [F.substring(c, 1, LIMITS["gap"]) for c in (statute, regulation)]
    return F.concat(F.lit(GAP_HEADS[0]), shown[0], F.lit(GAP_HEADS[1]), shown[1])


def comparison_prompt(topic: Column, formatted: Column) -> Column:
    return F.concat(F.lit(COMPARISON_HEADS[0]), topic, F.lit(COMPARISON_HEADS[1]), F.substring(formatted, 1, LIMITS["comparison"]))


def bill_prompt(jurisdiction: Column, current: Column, practice: Column) -> Column:
    return F.concat(*(x for head, c in zip(BILL_HEADS, (jurisdiction, current, practice)) for x in (F.lit(head), c)))


# Answers --------------------------------------------------------------------------------


def fenced(answer: Column, plain_fences: bool = True) -> Column:
    """What stands in the first ```json fence, else in the first fence of any kind (unless ``plain_fences`` is off), else all."""
    inside = lambda mark: F.substring_index(F.element_at(F.split(answer, mark, -1), 2), "```", 1)
    other = F.when(F.contains(answer, F.lit("```")), inside("```")).otherwise(answer) if plain_fences else answer
    return F.when(F.contains(answer, F.lit("```json")), inside("```json")).otherwise(other)


def _after(answer: Column, mark: str) -> Column:
    return F.when(F.contains(answer, F.lit(mark)), F.substring(answer, F.instr(answer, mark) + len(mark), F.length(answer)))


def _before_first_listed(body: Column, marks: list[str]) -> Column:
    """Up to the first place of the first of ``marks`` that there is, in the order of the list."""
    out = body
    for mark in reversed(marks):
        out = F.when(F.contains(body, F.lit(mark)), F.substring_index(body, mark, 1)).otherwise(out)
    return out


def _bullets(body: Column) -> Column:
    lines = F.transform(F.split(rx.strip(body), "\n", -1), rx.strip)
    marked = F.filter(lines, lambda x: F.startswith(x, F.lit("-")) | F.startswith(x, F.lit("•")))
    return F.coalesce(F.transform(marked, lambda x: rx.strip(F.substring(x, F.lit(2), F.length(x)))), F.array().cast("array<string>"))


def parsed_rewrite(answer: Column) -> Column:
    """struct<rewritten, changes, confidence, warnings> with "", [], 0.8 and [] for what isn't there."""
    changes, confidence, warnings = "CHANGES MADE:", "LEGAL CONFIDENCE:", "WARNINGS:"
    share = F.regexp_extract(_after(answer, confidence), rx.cased(r"(\d+)\s*%"), 1)
    return F.struct(
        F.coalesce(rx.strip(_before_first_listed(_after(answer, "REWRITTEN TEXT:"), [changes, confidence, warnings])), F.lit("")).alias("rewritten"),
        _bullets(_before_first_listed(_after(answer, changes), [confidence, warnings])).alias("changes"),
        F.coalesce(F.when(share != "", share.cast("double") / 100), F.lit(0.8)).alias("confidence"),
        _bullets(_after(answer, warnings)).alias("warnings"),
    )


BURDENS = "burdens array<struct<text_excerpt: string, burden_type: string, severity: string, affected_parties: string, estimated_impact: string, reform_recommendation: string>>"
GAPS = "gaps array<map<string, string>>, alignment_score double, summary string"
COMPARISON = "rankings array<struct<jurisdiction: string, score: double, notes: string>>, key_differences array<struct<aspect: string, details: map<string, string>>>, model_provisions array<struct<source: string, text: string, rationale: string>>, recommendations array<string>, _bad string"


def answered_findings(answers: DataFrame, answer: Column, *keys: str) -> DataFrame:
    """Findings from answers to ``burden_prompt``, on rows with ``keys``, sec_pos and location. An answer that can't be read gives none."""
    read = F.from_json(fenced(answer), BURDENS)["burdens"]
    each = answers.select(*keys, "sec_pos", "location", F.posexplode(read).alias("match_ord", "b"))
    none = F.lit(None).cast("string")
    kind = text.mapped_type(F.coalesce("b.burden_type", F.lit("")))
    rank = text.severity_rank(F.coalesce("b.severity", F.lit("MEDIUM"))).cast("int")
    return each.select(
        *keys, "sec_pos", F.lit(2).alias("source_ord"), F.lit(0).alias("rule_ord"), "match_ord", F.lit(None).cast("int").alias("start"), kind.alias("burden_type"), text.category(kind).alias("category"),
        text.severity_name(rank).alias("severity"), rank.alias("sev_rank"), "location", F.coalesce("b.text_excerpt", F.lit("")).alias("text_excerpt"), F.coalesce("b.estimated_impact", F.lit("")).alias("explanation"),
        F.col("b.reform_recommendation").alias("reform_suggestion"), none.alias("estimated_time_cost"), none.alias("estimated_dollar_cost"), F.col("b.affected_parties").alias("affects_population"),
    )


def analysed_sections(split: DataFrame, completer: Completer | None, *keys: str) -> DataFrame:
    """Findings of a model on sections of over LEAST_WORDS words; none without a completer."""
    asked = complete(split.where(text.word_count(F.col("text")) > LEAST_WORDS), burden_prompt(F.col("text")), completer)
    return answered_findings(asked, F.col("answer.text"), *keys)


def rewritten(docs: DataFrame, completer: Completer | None = None, id_col: str = "doc_id", text_col: str = "text", audience: str = "general_public", keep_structure: bool = False) -> DataFrame:
    """As ``rewrite.rewrite``; with a completer the text without jargon is rewritten by it, and kept with half the confidence if that fails."""
    base = plain.rewrite(docs, id_col, text_col)
    if completer is None:
        return base
    told = complete(base, rewrite_prompt(F.col("rewritten_text"), audience, keep_structure), completer)
    parsed, failed = parsed_rewrite(F.col("answer.text")), F.col("answer.error").isNotNull()
    out = told.withColumn("p", parsed).withColumn("rewritten_text", F.when(failed, F.col("rewritten_text")).otherwise(F.col("p.rewritten")))
    none = F.array().cast("array<struct<before: string, after: string>>")
    changes = F.transform("p.changes", lambda d: F.struct(F.lit("").alias("before"), d.alias("after")))
    return out.withColumns(
        {
            "changes": F.when(failed, none).otherwise(changes),
            "readability_after": text.readability(F.col("rewritten_text")),
            "confidence": F.when(failed, 0.5).otherwise(F.col("p.confidence")),
            "warnings": F.when(failed, F.array(F.concat(F.lit("LLM rewrite failed: "), F.col("answer.error")))).otherwise(F.col("p.warnings")),
        }
    ).drop("p", "answer")


def engine_rewrite(docs: DataFrame, completer: Completer | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, original, rewritten, mode, error."""
    told = complete(docs, rewrite_prompt(F.col(text_col)), completer)
    error = F.lit(NO_KEY_REWRITE) if completer is None else F.col("answer.error")
    return told.select(id_col, F.col(text_col).alias("original"), F.col("answer.text").alias("rewritten"), F.lit("plain_language").alias("mode"), error.alias("error"))


def budgeted(rows: DataFrame, keys: list[str], order: list[str], text_col: str = "text", budget: int = LIMITS["gap"], separator: str = "\n\n", cells: int = 64, first: dict[str, Column] | None = None, again: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(keys, text): the texts of a key in order, ``separator`` between them, as far as ``budget`` characters go. A null text is empty.

    Which rows are shown follows from lengths alone, before a text moves: a row is out once the rows before it fill the
    budget. That is worked out within ``cells`` of a key first, where it can only leave too many in (what fills the budget in
    a cell fills it in the whole), so no task sees all rows of a key; then among what is left, which is little. Only texts
    that are shown are gathered, so a key's row holds ``budget`` characters, and as many of the last text, at most.
    ``first``: columns to add, by name, of a key's first row, which is always shown. Where rows are dear to make, ``again`` makes those that
    are shown, given their (keys, order), and no need to make only these: all are made once then, and few twice.
    """
    more = first or {}
    body = F.coalesce(F.col(text_col), F.lit(""))
    extra = [c.alias(f"__first_{n}") for n, c in more.items()]
    marked = rows.select(*keys, *order, F.xxhash64(body).alias("__h"), body.alias("__text"), *extra)
    by = [*order, "__h"]
    sizes = marked.groupBy(*keys, *by).agg(F.sum(F.length("__text") + len(separator)).alias("__n")).withColumn("__cell", F.pmod(F.xxhash64(*by), F.lit(cells)))

    def left(df: DataFrame, *within: str) -> DataFrame:
        before = F.sum("__n").over(Window.partitionBy(*keys, *within).orderBy(*by)) - F.col("__n")
        return df.withColumn("__before", before - len(separator)).where(F.col("__before") < budget)  # the blank line before a row may still be shown

    shown, names = left(left(sizes, "__cell")), [f"__first_{n}" for n in more]
    if again is None:
        other = shown.select(*(F.col(c).alias(f"__{i}") for i, c in enumerate([*keys, *by])))
        some = marked.join(other, [F.col(c).eqNullSafe(F.col(f"__{i}")) for i, c in enumerate([*keys, *by])], "left_semi")
    else:  # rows that come after the shown ones are out as before, as there is enough before them
        few = again(shown.select(*keys, *order)).select(*keys, *order, F.xxhash64(body).alias("__h"), F.substring(body, 1, budget).alias("__text"), (F.length(body) + len(separator)).alias("__n"), *extra)
        before = F.sum("__n").over(Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
        some = few.withColumn("__before", before - len(separator)).where(F.col("__before") < budget)
    texts = some.select(*keys, F.struct(*by, F.substring("__text", 1, budget).alias("text"), *names).alias("__s")).groupBy(*keys).agg(F.array_sort(F.collect_list("__s")).alias("__s"))
    joined = F.array_join(F.transform("__s", lambda x: x["text"]), separator)
    return texts.select(*keys, F.substring(joined, 1, budget).alias("text"), *(F.try_element_at("__s", F.lit(1))[f"__first_{n}"].alias(n) for n in more))


def joined_sections(split: DataFrame, *keys: str, budget: int = LIMITS["gap"]) -> DataFrame:
    """(keys, text): a document's sections in order, a blank line between them, as far as a prompt shows them."""
    return budgeted(split, list(keys), ["sec_pos"], budget=budget)


def paired(statutes: DataFrame, regulations: DataFrame, topic_cols: list[str], id_col: str = "doc_id", title_col: str | None = None, again: tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """(topic, statute, regulation, statute_title, regulation_title): statutes and the regulations on the same topic, from sections (topic, id, sec_pos, text).

    Of each side the sections stand in order of documents and places, as far as a prompt shows them; its title is the first document's. Topics
    that one side lacks have no pair. ``again``: for each side, what splits again the documents whose sections (topic, id, sec_pos) are shown,
    so that not all of them are split twice.
    """

    def side(split: DataFrame, name: str, few: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
        title = {f"{name}_title": F.col(title_col or id_col).cast("string")}
        return budgeted(split, topic_cols, [id_col, "sec_pos"], first=title, again=few).withColumnRenamed("text", name)

    one, two = again or (None, None)
    return side(statutes, "statute", one).join(side(regulations, "regulation", two), topic_cols)


def gaps(pairs: DataFrame, completer: Completer | None = None) -> DataFrame:
    """Rows (statute_title, regulation_title, statute, regulation) → title, findings, summary, confidence (alignment as a share), error."""
    told = complete(pairs, gap_prompt(F.col("statute"), F.col("regulation")), completer)
    read = F.from_json(fenced(F.col("answer.text"), plain_fences=False), GAPS)
    title = F.concat_ws(" vs ", "statute_title", "regulation_title")
    error = F.lit(NO_KEY_GAPS) if completer is None else F.col("answer.error")
    none = F.array().cast("array<map<string, string>>")
    return told.withColumn("r", read).select(title.alias("title"), F.coalesce("r.gaps", none).alias("findings"), F.coalesce("r.summary", F.lit("")).alias("summary"), F.coalesce(F.col("r.alignment_score") / 100, F.lit(0.0)).alias("confidence"), error.alias("error"))


def alignment_band(score: Column) -> Column:
    """Of a score of 0 to 100."""
    return F.when(score >= 80, "high").when(score >= 60, "medium").otherwise("low")


def gap_icon(kind: Column) -> Column:
    return F.when(F.contains(F.lower(kind), F.lit("exceeds")), "🔴").otherwise("🟡")


def model_bill(rows: DataFrame, completer: Completer | None = None) -> DataFrame:
    """Rows (jurisdiction, current_text, best_practice_text) get bill."""
    told = complete(rows, bill_prompt(F.col("jurisdiction"), F.col("current_text"), F.col("best_practice_text")), completer)
    return told.withColumn("bill", F.lit(NO_KEY_BILL) if completer is None else F.col("answer.text")).drop("answer")


def compared(rows: DataFrame, topic: str, completer: Completer | None = None) -> DataFrame:
    """One row: topic, rankings, key_differences, recommendations, model_provisions of provisions (jurisdiction, text, input_ord), as arrays.

    Without a completer, and where its answer fails or can't be read, it is the comparison by patterns. The
    provisions stand in one prompt as far as it shows them; others are not gathered.
    """
    headed = rows.select("input_ord", F.concat(F.lit("=== "), F.col("jurisdiction"), F.lit(" ===\n"), F.coalesce("text", F.lit(""))).alias("text"))
    one = budgeted(headed, [], ["input_ord"], budget=LIMITS["comparison"]).withColumnRenamed("text", "formatted")
    told = complete(one, comparison_prompt(F.lit(topic), F.col("formatted")), completer)
    read = told.select(F.from_json(fenced(F.col("answer.text")), COMPARISON, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("m"))

    ranked, differing = compare.rankings(rows), compare.differences(rows)
    said = compare.recommendations(ranked)
    in_order = lambda order, *cols: F.transform(F.array_sort(F.collect_list(F.struct(*order, *cols))), lambda x: F.struct(*(x[c].alias(c) for c in cols)))
    ranks = ranked.agg(in_order(["rank"], "jurisdiction", "score", "notes").alias("ranks"))
    details = differing.groupBy("aspect").agg(F.map_from_entries(in_order(["input_ord"], "jurisdiction", "detail")).alias("details"))
    places = F.array_position(F.array(*map(F.lit, compare.ASPECTS)), F.col("aspect")).alias("at")
    gathered = details.select(places, "aspect", "details").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "aspect", F.map_entries("details").alias("d")))), lambda x: F.struct(x["aspect"].alias("aspect"), F.map_from_entries(x["d"]).alias("details"))).alias("differ"))
    advice = said.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "recommendation"))), lambda x: x["recommendation"]).alias("advice"))
    # single rows, each with each
    both = read.crossJoin(ranks).crossJoin(gathered).crossJoin(advice)
    empty = lambda name: F.array().cast(both.schema["m"].dataType[name].dataType)
    bad = F.col("m").isNull() | F.col("m._bad").isNotNull()
    part = lambda name, plain: F.when(bad, plain).otherwise(F.coalesce(F.col(f"m.{name}"), empty(name))).alias(name)
    return both.select(F.lit(topic).alias("topic"), part("rankings", F.col("ranks")), part("key_differences", F.col("differ")), part("recommendations", F.col("advice")), part("model_provisions", empty("model_provisions")))
