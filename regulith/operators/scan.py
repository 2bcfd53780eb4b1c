"""Burden findings of sections: rules, severities, merging, filters and counts.

A finding's order is (document, sec_pos, source_ord, rule_ord, match_ord): statutory rules
before taxonomy rules, rules in catalog order, matches by place. Whatever takes the first
of something takes it in this order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import rules, rx, text
from . import external, sections

ORDER = ("sec_pos", "source_ord", "rule_ord", "match_ord")
FINDING = ("burden_type", "category", "severity", "sev_rank", "location", "text_excerpt", "explanation", "reform_suggestion", "estimated_time_cost", "estimated_dollar_cost", "affects_population")


@dataclass(frozen=True)
class Rule:
    group: str
    burden_type: str
    pattern: str


STATUTORY = tuple(Rule(g, rules.GROUP_TYPE.get(g, g), p) for g, ps in rules.STATUTORY.items() for p in ps)
TAXONOMY = tuple(Rule(t, t, p) for t, ps in rules.TAXONOMY.items() for p in ps)


@dataclass(frozen=True)
class ScanConfig:
    """``combined`` adds the taxonomy's rules, for eligible sections, to the statutory ones."""

    combined: bool = True
    min_severity: str = "LOW"
    burden_types: tuple[str, ...] = rules.BURDEN_TYPES
    max_sections: int = 50
    least_words: int = 30


CATALOG = STATUTORY + TAXONOMY


def _of_rule(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), number + 1)


def _searched(split: DataFrame, catalog: tuple[Rule, ...]) -> tuple[DataFrame, Callable[[Rule], Column]]:
    """``split`` with its text ``folded`` as __folded, and where a rule can match: a text that it needs stands there.

    Of the many texts that are needed few roots are looked for first; a text is looked for only where its root stands.
    """
    wanted = {r: rx.needed_any(r.pattern) for r in catalog}
    roots = rx.roots(sorted({x for xs in wanted.values() for x in xs}))
    order = {x: i + 1 for i, x in enumerate(sorted(set(roots.values())))}
    low = F.col("__folded")

    def here(r: Rule) -> Column:
        out = F.lit(False)
        for x in wanted[r]:
            stands = F.element_at("__roots", F.lit(order[roots[x]]))
            out = out | (stands if roots[x] == x else stands & F.contains(low, F.lit(x)))
        return out

    some = split.withColumn("__folded", rx.folded(F.col("text"))).withColumn("__roots", F.array(*(F.contains(low, F.lit(x)) for x in order)))
    return some, here


def rule_matches(split: DataFrame, catalog: tuple[Rule, ...], gate: tuple[int, Column] | None = None, statutory: int = 0, whole: bool = False) -> DataFrame:
    """``split``, without the text, with one row for each match: number (of the rule), match_ord, start, group, burden_type, text_excerpt.

    A rule's pattern is tried where the plain text that it needs stands, in the text ``folded``, which has the
    same offsets; all patterns are literals, compiled once a task, and offsets are looked for where one matched.
    Outer explodes, as for others Spark would work out an array once more to see if it is empty.
    Rows are multiplied in place. With ``gate`` = (n, condition), rules from the n-th on are tried
    only where the condition holds, and give just the first match of each type. The first
    ``statutory`` rules' excerpts show more round the match. Excerpts are cut from blocks of the text
    within the row, so a match carries no text along and work grows with text and matches. With ``whole``, a section without a match
    gives a row too, whose number is null, and a column ``leads`` marks one row of each section.
    """
    first, condition = gate or (len(catalog), F.lit(True))
    some, here = _searched(split, catalog)
    tried, body, low = [], F.col("text"), F.col("__folded")
    for i, r in enumerate(catalog):
        pattern = F.lit(rx.lowered(r.pattern))
        hit = F.struct(F.lit(i).alias("number"), F.regexp_extract_all(low, pattern, F.lit(0)).alias("found"), F.split(low, pattern, -1).alias("pieces"))
        stands = here(r) & F.rlike(low, pattern)
        tried.append(F.when(condition & stands if i >= first else stands, hit))
    some = some.withColumn("__hits", F.array_compact(F.array(*tried))).drop("__folded", "__roots")
    if gate is not None:
        kinds = F.array(*(F.lit(r.burden_type) for r in catalog))
        kind = lambda h: F.element_at(kinds, h["number"] + 1)
        again = lambda h, i: F.exists(F.slice("__hits", 1, i), lambda g: (g["number"] >= first) & (kind(g) == kind(h)))
        some = some.withColumn("__hits", F.filter("__hits", lambda h, i: (h["number"] < first) | ~again(h, i)))
    if whole:
        each = some.select(*(c for c in some.columns if c != "__hits"), F.posexplode_outer("__hits").alias("__nth", "__hit"))
    else:
        each = some.withColumn("__hit", F.explode_outer("__hits")).drop("__hits").where(F.col("__hit").isNotNull())
    each = each.withColumn("number", F.col("__hit.number"))
    found = rx.placed(F.col("__hit.found"), F.col("__hit.pieces"))
    if gate is not None:
        found = F.slice(found, F.lit(1), F.when(F.col("number") < first, F.lit(2**31 - 1)).otherwise(1))

    def shown(parts: Column, length: Column) -> Callable[[Column], Column]:
        def one(m: Column) -> Column:
            wide, narrow = (rx.excerpt(parts, length, m["start"], F.length(m["text"]), n, s) for n, s in ((150, True), (100, False)))
            told = F.when(F.col("number") < statutory, wide).otherwise(narrow)
            return F.struct(m["start"].alias("start"), told.alias("text_excerpt"))

        return one

    told = rx.let(rx.blocks(body), lambda parts: rx.let(F.length(body), lambda length: F.transform(found, shown(parts, length))))
    kept = [c for c in each.columns if c not in ("text", "__hit")]
    each = each.select(*kept, F.posexplode_outer(told).alias("match_ord", "__m"))
    if whole:
        each = each.withColumn("leads", (F.coalesce("__nth", F.lit(0)) == 0) & (F.coalesce("match_ord", F.lit(0)) == 0))
        kept = [*(c for c in kept if c != "__nth"), "leads"]
    else:
        each = each.where(F.col("match_ord").isNotNull())
    return each.select(*kept, "match_ord", F.col("__m.start").alias("start"), F.col("__m.text_excerpt").alias("text_excerpt"), _of_rule([r.group for r in catalog], F.col("number")).alias("group"), _of_rule([r.burden_type for r in catalog], F.col("number")).alias("burden_type"))


def section_counts(split: DataFrame, catalog: tuple[Rule, ...], gate: tuple[int, Column] | None = None) -> DataFrame:
    """As ``rule_matches``, with the sections as they are, without their text, and an array of their rules' numbers of matches (number, n, group, burden_type) as hits: no offsets, no excerpts."""
    first, condition = gate or (len(catalog), F.lit(True))
    some, here = _searched(split, catalog)
    counted, low = [], F.col("__folded")
    for i, r in enumerate(catalog):
        stands = here(r)
        times = F.when(condition & stands if i >= first else stands, rx.count(low, rx.lowered(r.pattern))).otherwise(0)
        counted.append(F.struct(F.lit(i).alias("number"), times.alias("n"), F.lit(r.group).alias("group"), F.lit(r.burden_type).alias("burden_type")))
    some = some.withColumn("hits", F.filter(F.array(*counted), lambda h: h["n"] > 0)).drop("__folded", "__roots")
    if gate is not None:
        again = lambda h, i: F.exists(F.slice("hits", 1, i), lambda g: (g["number"] >= first) & (g["burden_type"] == h["burden_type"]))
        some = some.withColumn("hits", F.filter("hits", lambda h, i: (h["number"] < first) | ~again(h, i)))
    n = lambda h: F.when(h["number"] < first, h["n"]).otherwise(1).cast("long")
    return some.drop("text").withColumn("hits", F.transform("hits", lambda h: h.withField("n", n(h))))


def match_counts(split: DataFrame, catalog: tuple[Rule, ...], gate: tuple[int, Column] | None = None) -> DataFrame:
    """``section_counts`` with one row for each section and rule."""
    each = section_counts(split, catalog, gate).withColumn("__h", F.explode_outer("hits")).drop("hits").where(F.col("__h").isNotNull())
    return each.select(*(c for c in each.columns if c != "__h"), "__h.number", "__h.n", "__h.group", "__h.burden_type")


def _findings(found: DataFrame, keys: tuple[str, ...], statutory: int) -> DataFrame:
    """Findings of matches; rules from number ``statutory`` on are the taxonomy's.

    Words round a statutory match raise its severity.
    """
    none, own = F.lit(None).cast("string"), F.col("number") < statutory
    typical = text.typical_rank(F.col("burden_type"))
    out = found.withColumn("sev_rank", F.when(own, text.escalated(typical, F.col("text_excerpt"))).otherwise(typical).cast("int"))
    said = F.when(own, F.concat(F.lit("Statutory "), F.translate("group", "_", " "), F.lit(" requirement"))).otherwise(F.concat(F.lit("Pattern match: "), F.col("burden_type")))
    return out.select(
        *(keys or ("doc_id",)), "sec_pos", (~own).cast("int").alias("source_ord"), F.when(own, F.col("number")).otherwise(F.col("number") - statutory).alias("rule_ord"), "match_ord", "start", "burden_type",
        text.category(F.col("burden_type")).alias("category"), text.severity_name(F.col("sev_rank")).alias("severity"), "sev_rank", "location", "text_excerpt", said.alias("explanation"),
        none.alias("reform_suggestion"), none.alias("estimated_time_cost"), none.alias("estimated_dollar_cost"), none.alias("affects_population"),
    )


def statutory_findings(split: DataFrame, *keys: str) -> DataFrame:
    """Findings of the statutory rules."""
    return _findings(rule_matches(split, STATUTORY, statutory=len(STATUTORY)), keys, len(STATUTORY))


def taxonomy_findings(split: DataFrame, *keys: str) -> DataFrame:
    """Findings of the taxonomy's rules, with their types' typical severities."""
    return _findings(rule_matches(split, TAXONOMY), keys, 0)


def merged(findings: DataFrame, *keys: str) -> DataFrame:
    """One finding for each key, type and location: the last with a reform suggestion, else the first, at the place of the first."""
    by = [*(keys or ("doc_id",)), "burden_type", "location"]
    place = F.struct(*ORDER)
    rest = [c for c in findings.columns if c not in by]
    whole = F.struct(*rest)
    best = F.coalesce(F.max_by(whole, F.when(F.col("reform_suggestion") != "", place)), F.min_by(whole, place))
    out = findings.groupBy(*by).agg(best.alias("b"), F.min(place).alias("p"))
    return out.select(*(F.col(c) if c in by else F.col(f"p.{c}").alias(c) if c in ORDER else F.col(f"b.{c}").alias(c) for c in findings.columns))


def scan(docs: DataFrame, config: ScanConfig = ScanConfig(), id_col: str = "doc_id", text_col: str = "text", completer: external.Completer | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Findings of whole documents, filtered by severity and type, without a shuffle.

    Columns ``keep`` of the documents come before the findings' own; there are none with a ``completer``.

    Findings of patterns have no reform suggestion, so merging those of the taxonomy in a section
    comes to the first match of each type, which is known where the section is. With a ``completer``
    eligible sections are put to it too, and its findings are merged with the taxonomy's, which takes a shuffle.
    """
    if keep and completer is not None:
        raise ValueError("columns are kept in scans without a completer only")
    if not config.combined:
        found = statutory_findings(sections.split_sections(docs, id_col, text_col, *keep), *keep, id_col)
        return filtered(found, config.min_severity, config.burden_types)
    split = sections.with_eligibility(docs, id_col, text_col, config.least_words, config.max_sections, keep)
    if completer is None:
        found = _findings(rule_matches(split, CATALOG, (len(STATUTORY), F.col("eligible")), len(STATUTORY)), (*keep, id_col), len(STATUTORY))
    else:
        some = split.where("eligible")
        both = taxonomy_findings(some, id_col).unionByName(external.analysed_sections(some, completer, id_col))
        found = statutory_findings(split, id_col).unionByName(from_engine(merged(both, id_col, "sec_pos")))
    return filtered(found, config.min_severity, config.burden_types)


def scan_counts(docs: DataFrame, config: ScanConfig = ScanConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(burden_type, category, n) of ``scan``'s findings of all severities, from numbers of matches."""
    if config.combined:
        split = sections.with_eligibility(docs, id_col, text_col, config.least_words, config.max_sections)
        found = match_counts(split, CATALOG, (len(STATUTORY), F.col("eligible")))
    else:
        found = match_counts(sections.split_sections(docs, id_col, text_col), STATUTORY)
    found = found.where(F.col("burden_type").isin(*config.burden_types))
    return found.groupBy("burden_type").agg(F.sum("n").alias("n")).select("burden_type", text.category(F.col("burden_type")).alias("category"), "n")


def filtered(findings: DataFrame, min_severity: str = "LOW", burden_types: tuple[str, ...] = rules.BURDEN_TYPES) -> DataFrame:
    out = findings.where(F.col("sev_rank") >= rules.SEVERITIES.index(min_severity) + 1)
    return out if set(burden_types) >= set(rules.BURDEN_TYPES) else out.where(F.col("burden_type").isin(*burden_types))


def high_priority(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("severity").isin("HIGH", "CRITICAL"))


def from_engine(rows: DataFrame) -> DataFrame:
    """Findings from rows with the names of a finding: rows of an unknown type or severity go, and costs are left out."""
    known = rows.where(F.col("burden_type").isin(*rules.BURDEN_TYPES) & F.col("severity").isin(*rules.SEVERITIES))
    none = F.lit(None).cast("string")
    return known.withColumns({"category": text.category(F.col("burden_type")), "sev_rank": text.severity_rank(F.col("severity")), "estimated_time_cost": none, "estimated_dollar_cost": none})


# Counts and texts -------------------------------------------------------------------------


def counts(findings: DataFrame, *keys: str, id_col: str = "doc_id", whole: bool = False) -> DataFrame:
    """(keys, dimension, value, n, first) for type, category and severity; ``first`` is the place of the first finding. With ``whole``, also a row "all" without a value.

    Findings are summed where they lie to a row for each type and severity, and only these few rows are grouped three ways.
    """
    names = {"burden_type": "by_type", "category": "by_category", "severity": "by_severity"}
    place = F.struct(id_col, *ORDER).alias("place")
    few = findings.select(*keys, *names, place).groupBy(*keys, *names).agg(F.count("*").alias("n"), F.min("place").alias("first"))
    return regrouped(few, *keys, whole=whole)


def regrouped(few: DataFrame, *keys: str, whole: bool = False) -> DataFrame:
    """``counts`` of rows (keys, burden_type, category, severity, n, first)."""
    names = {"burden_type": "by_type", "category": "by_category", "severity": "by_severity"}
    sets = [[F.col(c) for c in (*keys, *own)] for own in (*([n] for n in names), *([[]] if whole else []))]
    grouped = few.groupingSets(sets, *keys, *names).agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.grouping_id(*keys, *names).alias("g"))
    named = F.lit("all")  # of the bits of the names, the one of the column that is grouped by is 0
    for i, (column, name) in enumerate(names.items()):
        named = F.when(F.col("g").bitwiseAND(F.lit(4 >> i)) == 0, F.lit(name)).otherwise(named)
    out = grouped.select(*keys, named.alias("dimension"), F.coalesce(*names).alias("value"), "n", "first")
    return out.where(F.col("n").isNotNull())  # no findings at all: no row


def totals(docs: DataFrame, findings: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row: documents_scanned, sections_analyzed, total_burdens, high_priority_count, critical_count."""
    split = docs.select(sections.section_count(F.coalesce(F.col(text_col), F.lit(""))).alias("n"))
    left = split.agg(F.count("*").alias("documents_scanned"), F.coalesce(F.sum("n"), F.lit(0)).alias("sections_analyzed"))
    right = findings.agg(F.count("*").alias("total_burdens"), F.count_if(F.col("sev_rank") >= 3).alias("high_priority_count"), F.count_if(F.col("severity") == "CRITICAL").alias("critical_count"))
    return left.crossJoin(right)  # one row with one row


def scanned_totals(docs: DataFrame, error_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``totals`` of the documents without an error and of their ``scan``, with the number of the others as files_with_errors; one row.

    All of it comes from one pass, in which each section has a row that leads: texts may be dear to read, as those of files are.
    """
    config, error = ScanConfig(), F.col(error_col).isNotNull()
    body = F.when(~error, F.col(text_col))
    split = sections.with_eligibility(docs.select(id_col, body.alias(text_col), error.alias("__bad")), id_col, text_col, config.least_words, config.max_sections, ("__bad",))
    matched = rule_matches(split, CATALOG, (len(STATUTORY), F.col("eligible")), len(STATUTORY), whole=True)
    found, good = _findings(matched, ("__bad", "leads"), len(STATUTORY)), ~F.col("__bad")
    starts = F.col("leads") & (F.col("sec_pos") == 0)
    return found.agg(
        F.count_if(starts & good).alias("documents_scanned"), F.count_if(F.col("leads") & good).alias("sections_analyzed"), F.count("match_ord").alias("total_burdens"),
        F.count_if(F.col("match_ord").isNotNull() & (F.col("sev_rank") >= 3)).alias("high_priority_count"), F.count_if(F.col("match_ord").isNotNull() & (F.col("severity") == "CRITICAL")).alias("critical_count"), F.count_if(starts & ~good).alias("files_with_errors"),
    )


def type_priority(findings: DataFrame, *keys: str, id_col: str = "doc_id", most: int = 5) -> DataFrame:
    """(keys, rank, burden_type, max_rank, n): the ``most`` types with the highest severity, then the most findings, then the first finding."""
    by = findings.groupBy(*keys, "burden_type").agg(F.max("sev_rank").alias("max_rank"), F.count("*").alias("n"), F.min(F.struct(id_col, *ORDER)).alias("first"))
    return ranked_types(by, *keys, most=most)


def ranked_types(by: DataFrame, *keys: str, most: int = 5) -> DataFrame:
    """``type_priority`` of rows (keys, burden_type, max_rank, n, first)."""
    # there are as many rows for a key as types of burden
    ordered = by.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("max_rank")).alias("a"), (-F.col("n")).alias("b"), "first", "burden_type"))), 1, most).alias("t"))
    each = ordered.select(*keys, F.posexplode("t").alias("i", "x"))
    return each.select(*keys, (F.col("i") + 1).alias("rank"), F.col("x.burden_type").alias("burden_type"), (-F.col("x.a")).alias("max_rank"), (-F.col("x.b")).alias("n"))


def recommendation(kind: Column, n: Column) -> Column:
    out = F.format_string(rules.OTHER_RECOMMENDATION, kind, n)
    for name, form in rules.RECOMMENDATIONS.items():
        out = F.when(kind == name, F.format_string(form, n)).otherwise(out)
    return out


def scan_recommendations(findings: DataFrame, *keys: str, id_col: str = "doc_id") -> DataFrame:
    return advised(type_priority(findings, *keys, id_col=id_col), *keys)


def advised(top: DataFrame, *keys: str) -> DataFrame:
    """(keys, rank, burden_type, recommendation) of ``type_priority``'s rows."""
    return top.select(*keys, "rank", "burden_type", recommendation(F.col("burden_type"), F.col("n")).alias("recommendation"))


def _advice(f: Column) -> Column:
    """Of a finding: its suggestion, or a sentence if it is of high severity."""
    simplify = F.format_string("Review and simplify %s requirement at %s", f["burden_type"], f["location"])
    return F.when(f["reform_suggestion"] != "", f["reform_suggestion"]).when(f["sev_rank"] >= 3, simplify)


def engine_recommendations(findings: DataFrame, id_col: str = "doc_id", most: int = 10) -> DataFrame:
    """(id, rank, recommendation): the first ``most`` of each document: a finding's suggestion, or a sentence for those of high severity."""
    rows = findings.select(id_col, *ORDER, _advice(F.struct(*findings.columns)).alias("recommendation")).where(F.col("recommendation").isNotNull())
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(*ORDER))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most).select(id_col, "rank", "recommendation")


NO_BURDENS = "No significant procedural burdens identified."


def _summary(n: Column, times: dict[str, Column]) -> Column:
    lines = F.concat_ws("\n", F.format_string("Identified %d procedural burdens:", n), *(F.when(times[s] > 0, F.format_string(f"- {s}: %d", times[s])) for s in reversed(rules.SEVERITIES)))
    return F.when(n > 0, lines).otherwise(NO_BURDENS)


def burden_summary(docs: DataFrame, findings: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, summary): how many findings of each severity, the highest first; every document has one. Rows that share an id share one."""
    marks = {s: (F.col("severity") == s).cast("long") for s in rules.SEVERITIES}
    found = findings.select(id_col, *(c.alias(s) for s, c in marks.items()))
    all_ids = docs.select(id_col, *(F.lit(0).cast("long").alias(s) for s in marks))  # ids only: no text is read for them, and there is no join
    per = all_ids.unionByName(found).groupBy(id_col).agg(*(F.sum(s).alias(s) for s in marks)).withColumn("n", sum((F.col(s) for s in marks), F.lit(0)))
    return per.select(id_col, _summary(F.col("n"), {s: F.col(s) for s in marks}).alias("summary"))


def analysis(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", title_col: str | None = None, completer: external.Completer | None = None) -> DataFrame:
    """The engine's result for each document: mode, title, findings, summary, confidence, citations, recommendations. Findings merge across sections that share a location."""
    split = sections.split_sections(docs, id_col, text_col)
    found = taxonomy_findings(split, id_col)
    if completer is not None:
        found = found.unionByName(external.analysed_sections(split, completer, id_col))
    in_order = lambda order, *cols: F.array_sort(F.collect_list(F.struct(*order, *cols)))  # noqa: E731  one document's
    listed = merged(found, id_col).groupBy(id_col).agg(in_order(ORDER, *FINDING).alias("findings"))
    # what else is told of findings follows from a document's list, so that the rules go over the texts once
    told = F.filter(F.transform("findings", _advice), lambda x: x.isNotNull())
    severe = lambda s: F.size(F.filter("findings", lambda f: f["severity"] == s)).cast("long")
    times = {s: severe(s) for s in rules.SEVERITIES}
    listed = listed.select(id_col, "findings", F.slice(told, 1, 10).alias("recommendations"), _summary(F.size("findings").cast("long"), times).alias("summary"))
    listed = listed.withColumn("recommendations", F.when(F.size("recommendations") > 0, F.col("recommendations")))
    places = docs.select(id_col, F.posexplode_outer(sections.locations(F.coalesce(F.col(text_col), F.lit("")))).alias("sec_pos", "location")).where("sec_pos is not null")
    cited = places.groupBy(id_col).agg(F.transform(in_order(["sec_pos"], "location"), lambda s: s["location"]).alias("citations"))
    out = docs.select(id_col, (F.col(title_col) if title_col else F.lit("Untitled")).alias("document_title"))
    out = out.join(listed, id_col, "left").join(cited, id_col, "left").withColumn("summary", F.coalesce("summary", F.lit(NO_BURDENS)))
    return out.select(id_col, "document_title", "summary", "findings", "citations", "recommendations", F.lit("burden_scan").alias("mode"), F.lit(0.85).alias("confidence_score"))


def observed(analysed: DataFrame, name: str = "engine") -> tuple[DataFrame, Observation]:
    """``analysis``'s rows, and the engine's counters of them (documents_analyzed, burdens_identified) once an action has run."""
    counters = Observation(name)
    n = F.coalesce(F.sum(F.when(F.col("findings").isNotNull(), F.size("findings")).otherwise(0)), F.lit(0))
    return analysed.observe(counters, F.count("*").alias("documents_analyzed"), n.alias("burdens_identified")), counters
