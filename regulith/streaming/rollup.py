"""Running counts of a stream of documents, an extension: what a scan of all documents so far would count.

Ids of documents that have come are Spark's state: a document that comes again, in the same batch or a later
one, counts once. One that comes late counts when it comes, as counts don't depend on time. Each batch adds the
counts of its new documents, a few rows for each source, as a folder of its own, which a batch that is run again
after a failure overwrites; the running counts are the sum of the folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text
from ..operators import sections
from ..operators.scan import CATALOG, STATUTORY, ScanConfig, section_counts

OUT = "source string, dimension string, value string, n long"


def batch_counts(docs: DataFrame, config: ScanConfig = ScanConfig(), text_col: str = "text", source_col: str = "source") -> DataFrame:
    """source, dimension (documents, sections, by_type), value, n of a table of documents, in one pass over the texts."""
    rows = docs.select(F.coalesce(source_col, F.lit("")).alias("source"), F.col(text_col).alias("text"))
    if config.combined:
        counted = section_counts(sections.with_eligibility(rows, "source", "text", config.least_words, config.max_sections), CATALOG, (len(STATUTORY), F.col("eligible")))
    else:
        counted = section_counts(sections.split_sections(rows, "source", "text"), STATUTORY)
    row = lambda dimension, value, n: F.struct(F.lit(dimension).alias("dimension"), value.alias("value"), n.cast("long").alias("n"))
    hits = F.transform(F.filter("hits", lambda h: h["burden_type"].isin(*config.burden_types)), lambda h: row("by_type", h["burden_type"], h["n"]))
    whole = F.array(row("documents", F.lit(""), F.col("sec_pos") == 0), row("sections", F.lit(""), F.lit(1)))
    each = counted.select("source", F.explode_outer(F.concat(whole, hits)).alias("x"))  # never empty; for an inner explode all rules would be counted twice
    return each.groupBy("source", "x.dimension", "x.value").agg(F.sum("x.n").alias("n")).where("n > 0")


def rollup_stream(docs: DataFrame, out: str, checkpoint: str, config: ScanConfig = ScanConfig(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", time_col: str | None = None, remember: str = "30 days", once: bool = True) -> StreamingQuery:
    """Counts of a streaming ``docs``, as ``rollup`` reads them.

    Ids are kept for good, or, with a ``time_col``, as long as ``remember`` behind the latest time seen; what is older than that doesn't count
    then. The counter documents_seen of each batch, repeated documents included, is its observed metric "engine".
    """
    seen = docs.observe("engine", F.count("*").alias("documents_seen"))
    new = seen.withWatermark(time_col, remember).dropDuplicatesWithinWatermark([id_col]) if time_col else seen.dropDuplicates([id_col])

    def batch(rows: DataFrame, number: int) -> None:
        cores = rows.sparkSession.sparkContext.defaultParallelism
        if rows.rdd.getNumPartitions() < cores:  # as many as the state has parts; the rules are bound by computing
            rows = rows.repartition(cores)
        batch_counts(rows, config, text_col, source_col).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = new.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def rollup(spark: SparkSession, out: str) -> DataFrame:
    """source, dimension (documents, sections, by_type, by_category), value, n: counts so far."""
    whole = spark.read.schema(OUT).parquet(f"{out}/batch=*").groupBy("source", "dimension", "value").agg(F.sum("n").alias("n"))
    category = whole.where("dimension = 'by_type'").groupBy("source", F.lit("by_category").alias("dimension"), text.category(F.col("value")).alias("value")).agg(F.sum("n").alias("n"))
    return whole.unionByName(category)
