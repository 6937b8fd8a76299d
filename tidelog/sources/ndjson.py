"""Bulk export: an action line and a document line per document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.jsonio import blank_out, encode
from tidelog.functions.times import format_rfc3339, index_name


def bulk_lines(documents: DataFrame) -> DataFrame:
    """``(doc_id, line_no, line)``; empty trace and address are left out."""
    action = F.to_json(
        F.struct(F.struct(index_name(F.col("event_date")).alias("_index"), F.col("doc_id").alias("_id")).alias("index"))
    )
    body = encode(
        F.col("tenant_id"), F.col("timestamp"), F.col("level"), F.col("service"), F.col("message"),
        blank_out("trace_id"), blank_out("ip"), format_rfc3339(F.col("ingested_at")).alias("ingested_at"),
    )
    return documents.select("doc_id", F.posexplode(F.array(action, body)).alias("line_no", "line"))


def export_ndjson(documents: DataFrame, path: str) -> None:
    """Text files in which the two lines of a document stay together."""
    lines = documents.transform(bulk_lines)
    lines.select("line").write.mode("overwrite").text(path)
