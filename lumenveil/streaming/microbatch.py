"""Scanning a stream of documents in micro-batches (beyond the batch engine's own operators).

Detection is stateless for each document, so a stream of (path, text) becomes a stream of public findings by the
same expressions; counts in event-time windows need a watermark only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import detect, summary


def findings_stream(docs: DataFrame) -> DataFrame:
    """Public findings of a streaming table (path, text)."""
    return summary.public_findings(detect.detect_all(docs))


def counts_by_window(docs: DataFrame, time: str = "ts", every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """How many findings of each type each window has. docs: (path, text, ts), streaming or not."""
    found = detect.detect_all(docs.withWatermark(time, late)).select(time, F.explode_outer("findings").alias("f")).filter("f IS NOT NULL")
    return found.groupBy(F.window(time, every), "f.type").agg(F.count("*").alias("n"))


def write_idempotent(batch: DataFrame, batch_id: int, path: str) -> None:
    """For foreachBatch: a batch's findings go to a folder of its number, so that a repeated batch replaces itself."""
    findings_stream(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
