"""Further registered queries: projects, licences, exports, and steps of a language model with a stand-in for it."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..functions.rules import STAGES
from ..operators import compare, external, licensing, rewrite, scan, sections, workflow
from ..sources import files, licenses, reports
from . import queries as base

#: What the stand-in calls its findings, by the length of the prompt.
TYPES = ("Wet Signature", "late fees", "an in-person visit", "zzz", "mail")
LEVELS = ("high", "odd", "critical")
CHOSEN = ("wet_signature", "notarization", "excessive_fee", "waiting_period")
SEVERITY_NAMES = ("low", "Medium", "HIGH", "critical", "odd", "")


def answer_burdens(prompts: list[str]) -> list[str]:
    """A model that names one burden, which depends on the prompt's length alone."""
    found = lambda n: {"text_excerpt": f"of {n}", "burden_type": TYPES[n % 5], "severity": LEVELS[n % 3], "reform_recommendation": "use forms"}
    return ["```json\n" + json.dumps({"burdens": [found(len(p))]}) + "\n```" for p in prompts]


def answer_rewrite(prompts: list[str]) -> list[str]:
    return [f"REWRITTEN TEXT:\nplain {len(p)}\nCHANGES MADE:\n- shorter\n- clearer\nLEGAL CONFIDENCE: {len(p) % 101}%\nWARNINGS:\n- check {len(p) % 7}\n" for p in prompts]


def answer_gaps(prompts: list[str]) -> list[str]:
    kinds = ("exceeds_authority", "missing")
    return ["```json\n" + json.dumps({"gaps": [{"type": kinds[len(p) % 2]}], "alignment_score": len(p) % 101, "summary": "s"}) + "\n```" for p in prompts]


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as projects with all their columns."""
    plain = {"name": F.concat(F.lit("Project "), F.col("user_id").cast("string")), "state": F.lit("Ohio"), "topic": F.lit("fees"), "created_at": F.lit("2024-01-01T00:00:00"), "updated_at": F.lit("2024-01-01T00:00:00"), "tags": F.array(F.lit("a"))}
    made = base.staged(spark, sf_dir).withColumns({"id": F.col("user_id").cast("string"), **plain, "notes": F.array().cast(workflow.NOTE)})
    columns = T.StructType.fromDDL(workflow.SCHEMA).names
    return made.withColumns({c: F.lit("") for c in columns if c not in made.columns}).select(*columns)


def project_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest views as stored rows, newest purchases as changes."""
    events = base.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts")
    newest = lambda kind: workflow.newest(events.where(F.col("event_type") == kind), "user_id", ["ts", "event_id"])
    return workflow.upsert(newest("view"), newest("purchase"), "user_id", "ts").select("user_id", "event_id", "event_type", "value")


def advanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = F.element_at(F.array(*map(F.lit, STAGES)), (F.pmod("event_id", F.lit(len(STAGES))) + 1).cast("int"))
    event = F.when(F.col("event_type").isin("view", "click"), "scan").when(F.col("event_type") == "purchase", "comparison").otherwise("note")
    each = base.table(spark, sf_dir, "events").select(stage.alias("stage"), event.alias("event"))
    return each.groupBy("stage", "event", workflow.advance(F.col("stage"), F.col("event")).alias("next")).agg(F.count("*").alias("n"))


def engine_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = scan.analysis(base.corpus(spark, sf_dir))
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long")
    return told.select("doc_id", "mode", "document_title", "summary", size("findings").alias("findings"), F.coalesce(F.array_join("citations", "|"), F.lit("")).alias("citations"), size("recommendations").alias("recommendations"))


def rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = rewrite.rewrite(base.corpus(spark, sf_dir), re2=True)
    return done.select("doc_id", text.rounded(F.col("readability_before")).alias("readability_before"), text.rounded(F.col("readability_after")).alias("readability_after"), F.size("changes").cast("long").alias("changes"), "confidence", F.element_at("warnings", 1).alias("warning"))


def model_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = external.rewritten(base.corpus(spark, sf_dir), answer_rewrite)
    return done.select("doc_id", "rewritten_text", "confidence", F.size("changes").cast("long").alias("changes"), F.element_at("warnings", 1).alias("warning"))


def gap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source: those with even ids as statutes, those with odd ids as the regulations on the same topic."""
    docs = base.corpus(spark, sf_dir)
    sides = [docs.where(F.pmod("doc_id", F.lit(2)) == odd) for odd in (0, 1)]
    split = lambda rows: sections.split_sections(rows, "doc_id", "text", "source")
    again = tuple(lambda shown, rows=rows: split(rows.join(shown.select("doc_id"), "doc_id", "left_semi")) for rows in sides)
    return external.paired(*map(split, sides), ["source"], again=again)


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = external.gaps(gap_pairs(spark, sf_dir), answer_gaps)
    return done.select("title", "summary", text.rounded(F.col("confidence")).alias("confidence"), external.alignment_band(F.round(F.col("confidence") * 100)).alias("band"), external.gap_icon(F.col("findings")[0]["type"]).alias("icon"))


def bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bill for each source from its documents, as far as a prompt goes, and those of the source with the lowest burden."""
    docs = base.corpus(spark, sf_dir).where("source <> ''")
    texts = external.budgeted(docs, ["source"], ["doc_id"]).select(F.col("source").alias("jurisdiction"), F.col("text").alias("current_text"))
    best = base.ranked(spark, sf_dir).where("rank = 1").select(F.col("jurisdiction").alias("best"))
    best = texts.join(best, F.col("jurisdiction") == F.col("best")).select("best", F.col("current_text").alias("best_practice_text"))
    told = external.model_bill(texts.crossJoin(best), lambda prompts: [f"bill {len(p)}" for p in prompts])  # one best source
    return told.select("jurisdiction", "best", "bill")


def answer_comparison(prompts: list[str]) -> list[str]:
    """A model that scores each provision that it is shown by the length of its name, the latest first."""
    told = []
    for p in prompts:
        names = [line[4:-4] for line in p.split("\n") if line.startswith("=== ") and line.endswith(" ===")]
        ranks = [{"jurisdiction": n, "score": len(n), "notes": str(len(p))} for n in reversed(names)]
        told.append("```json\n" + json.dumps({"rankings": ranks, "recommendations": [f"{len(names)} shown"]}) + "\n```")
    return told


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compare.provisions(base.corpus(spark, sf_dir), "source", "text", "doc_id")
    told = external.compared(rows, "filing", answer_comparison)
    ranks = F.transform("rankings", lambda r: F.concat_ws(":", r["jurisdiction"], r["score"].cast("int").cast("string"), r["notes"]))
    return told.select("topic", F.array_join(ranks, "|").alias("rankings"), F.array_join("recommendations", "|").alias("recommendations"), F.size("model_provisions").alias("models"))


def model_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = external.analysed_sections(base.split(spark, sf_dir), answer_burdens, "doc_id")
    return found.select("doc_id", "sec_pos", "burden_type", "category", "severity", "location", "text_excerpt", "reform_suggestion")


def united_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan.scan(base.corpus(spark, sf_dir), completer=answer_burdens)
    return found.where(F.col("source_ord") > 0).select("doc_id", "sec_pos", "source_ord", "burden_type", "severity", "text_excerpt", "reform_suggestion")


def named(spark: SparkSession, sf_dir: str, words: tuple[str, ...]) -> DataFrame:
    own = spark.createDataFrame([(x,) for x in words], "name string")
    return base.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("name")).union(own).distinct()


def citation_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    none: Column = F.lit(None).cast("string")
    return sections.citations(base.corpus(spark, sf_dir)).select("doc_id", "raw_text", text.citation(F.col("title"), none, F.col("section"), F.col("subsection"), F.col("raw_text")).alias("citation"))


def looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = licenses.licenses(spark)
    found = licensing.for_license(rows, "COSMETOLOGY").union(licensing.state_data(rows, "Texas", "contractor")).select("license_key", "state", "burden_score")
    return base.applied(found, spark, sf_dir)


def side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = licensing.shown(licensing.compare_states(licenses.licenses(spark), ["Texas", "Florida"], "cosmetology"))
    return licensing.transposed(base.applied(shown, spark, sf_dir, "cosmetology"))


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.ranked(spark, sf_dir).select("rank", "jurisdiction", compare.medal(F.col("rank")).alias("medal"), compare.burden_light(F.col("score")).alias("light"))


QUERIES: dict[str, base.Query] = {
    "scan_min_severity": lambda s, d: scan.scan(base.corpus(s, d), scan.ScanConfig(min_severity="HIGH", burden_types=CHOSEN)).select(*base.SHOWN),
    "findings_export": lambda s, d: reports.findings_json(base.findings(s, d)),
    "engine_analysis": engine_analysis,
    "rewrite_documents": rewritten,
    "citation_strings": citation_strings,
    "non_blank_documents": lambda s, d: files.non_blank(base.documents(s, d)).select("doc_id"),
    "severity_ranks": lambda s, d: named(s, d, SEVERITY_NAMES).select("name", text.severity_rank(F.col("name")).alias("severity_rank")),
    "ranking_marks": marks,
    "license_lookup": looked_up,
    "states_side_by_side": side_by_side,
    "sample_provisions": lambda s, d: base.applied(licensing.with_sample_statute(licenses.licenses(s), licenses.sample_statutes(s)), s, d).select("state", "license_type", F.length("sample_text").alias("characters"), "applications"),
    "project_changes": project_changes,
    "project_advance": advanced,
    "project_delete": lambda s, d: workflow.delete(projects(s, d), ["1", "2", "30"]).select("id", "stage"),
    "project_moves": lambda s, d: workflow.advance_to(projects(s, d), "drafted").select("id", "stage", workflow.progress(F.col("stage")).alias("progress"), workflow.icon(F.col("stage")).alias("icon")),
    "project_notes": lambda s, d: workflow.add_note(projects(s, d), F.concat(F.lit("note on "), F.col("name"))).select("id", F.size("notes").alias("n"), F.col("notes")[0]["text"].alias("note")),
    "project_scans": lambda s, d: workflow.save_scan(projects(s, d), F.struct(F.lit(3).alias("burdens_found")), F.repeat("name", F.lit(100))).select("id", "stage", "scan_results", F.length("target_statute").alias("characters")),
    "project_json": lambda s, d: workflow.from_json(workflow.to_json(projects(s, d))).select("name", "state", "topic", "stage", F.array_join("tags", ",").alias("tags")),
    "stage_icons": lambda s, d: named(s, d, STAGES).select("name", workflow.icon(F.col("name")).alias("icon"), workflow.next_step(F.col("name")).alias("next_step")),
    "model_findings": model_findings,
    "united_findings": united_findings,
    "model_rewrite": model_rewritten,
    "model_gaps": gaps,
    "gap_pairs": gap_pairs,
    "model_comparison": compared,
    "provisions": lambda s, d: compare.provisions(base.corpus(s, d), "source", "text", "doc_id"),
    "model_bills": bills,
}
