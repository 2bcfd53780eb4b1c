"""Registered queries over documents as files, pairs of legal texts, events in order, reports and blobs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sql as functions
from ..functions import text
from ..functions.rules import STAGES
from ..operators import scan, workflow
from ..sources import files, reports
from ..streaming import rollup
from . import more
from . import queries as base

#: By the remainder of the id: the kinds of files that documents become; the last can't be read.
KINDS = (".txt", ".docx", ".pdf", ".md")


def kind_of(id_col: str = "doc_id") -> Column:
    return F.element_at(F.array(*map(F.lit, KINDS)), (F.pmod(F.col(id_col), F.lit(len(KINDS))) + 1).cast("int"))


def as_files(docs: DataFrame) -> DataFrame:
    """doc_id, path, content: each document as a file."""
    named = docs.select("doc_id", "text", F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("title"))
    return files.rendered(named, kind_of()).select("doc_id", "path", "content")


def file_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as text, Word, PDF and other files, and read back: their texts, and an error for what can't be read."""
    return files.decoded(as_files(base.documents(spark, sf_dir))).select("doc_id", "path", "text", "error")


def directory_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan of those files that can be read, with the number of those that can't."""
    return scan.scanned_totals(files.decoded(as_files(base.corpus(spark, sf_dir))), "error")


def stage_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as projects whose stages go forth and back: views and clicks are saved scans, purchases comparisons, and others set a stage."""
    events = base.table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("view", "click"), "scan").when(F.col("event_type") == "purchase", "comparison").otherwise("set")
    to = F.element_at(F.array(*map(F.lit, STAGES)), (F.pmod("event_id", F.lit(len(STAGES))) + 1).cast("int"))
    told = workflow.composed(events, "user_id", ["ts", "event_id"], kind, to)
    new, drafted = (workflow.after(F.lit(s), F.col("outcomes")) for s in ("created", "drafted"))
    return told.select("user_id", "events", new.alias("stage"), drafted.alias("stage_of_a_draft"), text.rounded(workflow.progress(new)).alias("progress"))


def finding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of each source by type, category and severity, and in all."""
    found = scan.scan(base.corpus(spark, sf_dir).withColumn("source", F.coalesce("source", F.lit(""))), keep=("source",))
    return scan.counts(found, "source", whole=True).select("source", "dimension", "value", "n", F.col("first.doc_id").alias("first_doc"))


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.corpus(spark, sf_dir).withColumnRenamed("source", "jurisdiction")
    return reports.scan_lines(docs, scan.scan(docs, keep=("jurisdiction",)))


def report_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings' lines of all sources' reports, read again."""
    lines = report_lines(spark, sf_dir).where("ord = 1").select("jurisdiction", "place.doc_id", F.from_json(F.ltrim("line", F.lit(",")), "type string, category string, severity string, location string, excerpt string, reform string").alias("f"))
    return lines.select("jurisdiction", "doc_id", "f.*")


def report_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heads of all sources' reports, closed and read again."""
    head = F.from_json(F.concat("line", F.lit("]}")), "documents_scanned long, sections_analyzed long, total_burdens long, high_priority_count long, summary_stats struct<by_type: map<string, long>>")
    told = report_lines(spark, sf_dir).where("ord = 0").select("jurisdiction", head.alias("h")).select("jurisdiction", "h.*")
    return told.withColumn("types", F.size("summary_stats.by_type").cast("long")).drop("summary_stats")


def result_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' projects with a blob of counts of their events, parsed once, read by paths, and exported again."""
    kinds = base.table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("value").alias("most"))
    parts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", F.struct("n", "most")))))  # a row for each kind of event
    blob = kinds.groupBy("user_id").agg(parts.alias("by_type"), F.sum("n").alias("total"))
    saved = more.projects(spark, sf_dir).join(blob.withColumnRenamed("user_id", "u"), F.col("id") == F.col("u").cast("string"))
    saved = saved.withColumn("scan_results", F.to_json(F.struct("total", "by_type"))).withColumn("draft_results", F.lit("not JSON"))
    parsed = workflow.with_parsed_results(saved)
    told = parsed.select("*", *(workflow.result(F.col("scan_results"), p, k).alias(n) for n, p, k in (("burdens_found", "$.total", "long"), ("clicks", "$.by_type.click.n", "long"), ("most", "$.by_type.purchase.most", "double"), ("wrong", "$.by_type.click", "int"))))
    out = workflow.with_exported_results(told)
    same = F.from_json("scan_results", "total long, by_type map<string, struct<n: long, most: double>>")
    return out.select("id", "burdens_found", "clicks", "most", "wrong", F.col("draft_results").isNull().alias("no_draft"), (F.array_sort(F.map_entries(same["by_type"])) == F.array_sort(F.map_entries("by_type"))).alias("same"))


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one; in one process without such a setting, below the system's."""
    base_folder = spark.conf.get("spark.checkpoint.dir", None)
    if not base_folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base_folder = os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{base_folder.rstrip('/')}/stream-{uuid.uuid4().hex}"


def stream_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running counts of documents as a stream, when all of them have come."""
    folder = scratch(spark)
    schema = base.table(spark, sf_dir, "documents").schema
    docs = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]")
    rollup.rollup_stream(base.spliced(spark, docs), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return rollup.rollup(spark, f"{folder}/out")


def in_sql(text: str, table: str = "documents") -> base.Query:
    """A query in SQL text over ``{rows}``: a table, or documents with regulatory wording ("corpus")."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        functions.register(spark)
        return spark.sql(text, rows=base.corpus(spark, sf_dir) if table == "corpus" else base.table(spark, sf_dir, table))

    return run


QUERIES: dict[str, base.Query] = {
    "sql_readability": in_sql("SELECT doc_id, legal_words(x) AS words, greatest(1, legal_sentences(x)) AS sentences, legal_syllables(x) AS syllables, round(legal_readability(x), 6) AS score, legal_rating(legal_readability(x)) AS rating FROM (SELECT doc_id, coalesce(text, '') AS x FROM {rows})"),
    "sql_provision_scores": in_sql("SELECT doc_id, round(legal_burden_score(text), 6) AS score, legal_fees(text) AS fees, legal_timeframes(text) AS timeframes, legal_digital(text) AS digital FROM {rows}", "corpus"),
    "sql_type_mapping": in_sql("SELECT p_name AS name, legal_burden_type(p_name) AS burden_type, legal_category(legal_burden_type(p_name)) AS category, count(*) AS n FROM {rows} GROUP BY 1, 2, 3", "part"),
    "stage_machine": stage_machine,
    "finding_counts": finding_counts,
    "report_findings": report_findings,
    "report_heads": report_heads,
    "result_blobs": result_blobs,
    "stream_rollup": stream_rollup,
    "file_formats": file_formats,
    "directory_scan": directory_scan,
}
