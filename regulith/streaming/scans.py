"""Scanning a stream of documents, an extension: the scan is stateless for each document, so each micro-batch is scanned as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.scan import ScanConfig, scan


def scan_stream(docs: DataFrame, out: str, checkpoint: str, config: ScanConfig = ScanConfig(), id_col: str = "doc_id", text_col: str = "text", once: bool = True) -> StreamingQuery:
    """Findings of a streaming ``docs``, a folder of Parquet for each batch.

    A batch that is run again after a failure overwrites its folder, so findings are neither lost nor doubled.
    """

    def batch(rows: DataFrame, number: int) -> None:
        scan(rows, config, id_col, text_col).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
