"""The streaming side: one query from raw records to store, metrics and rejects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.operators import ingest
from tidelog.sources import log_store

# Flush interval of the micro-batches (fixed value).
FLUSH_INTERVAL = "100 milliseconds"


def batch_writer(root: str, processor_id: str | None = None) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        log_store.process_batch(batch, root, batch_id, processor_id)

    return write


def start_ingest(
    raw: DataFrame,
    root: str,
    checkpoint: str,
    flush_interval: str | None = FLUSH_INTERVAL,
    processor_id: str | None = None,
) -> StreamingQuery:
    """Run the ingest query; ``flush_interval=None`` drains what is there and stops.

    Offsets are committed to ``checkpoint`` only after a batch has been written
    as a whole.  No watermark is set: an event of any age goes to its own day.
    """
    writer = raw.writeStream.foreachBatch(batch_writer(root, processor_id)).option("checkpointLocation", checkpoint)
    if flush_interval is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=flush_interval).start()


def rebuild_views(raw: DataFrame, root: str, staging: str) -> None:
    """Store, metrics and rejects again from the event log, in batch.

    Uses the functions of the stream, so the merged results are the same.
    """
    log_store.process_batch(raw, root, batch_id=0, staging=staging)


# ------------------------------------------------------------ stateful views


def stream_counts(raw: DataFrame) -> DataFrame:
    """Running message counts per tenant, service and level (update mode).

    State holds one row per key; partial sums are made before the shuffle.
    """
    return ingest.accepted(raw).groupBy("tenant_id", "service", "level").agg(F.count(F.lit(1)).alias("logs"))


def drain(query: StreamingQuery) -> StreamingQuery:
    query.awaitTermination()
    return query


def stream_lag(query: StreamingQuery) -> list[dict]:
    """Start, end and latest offsets of the last progress report of a live query."""
    progress = query.lastProgress
    return [] if progress is None else [
        {"source": s["description"], "read": s["endOffset"], "latest": s.get("latestOffset")} for s in progress["sources"]
    ]


