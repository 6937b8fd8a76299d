"""Keep-last, recent errors and the two five-minute error counters.

None of these sorts a whole service in one task.  The idle counter works on
five-minute buckets (a bucket narrower than the gap limit cannot contain a
gap), so its windows see at most 288 rows per service and day.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.text import is_error
from tidelog.functions.times import as_timestamp
from tidelog.operators.ranking import first_per_group

# Limits (fixed values).
IDLE_SECONDS = 300
RECENT_KEPT = 100
RECENT_DEFAULT = 10

_US = 1_000_000

# Columns that the document id determines.  Grouping by all of them lets filters
# on any of them pass below the aggregate and reach the Parquet scan.  The id
# comes first because it tells rows apart soonest when they are sorted.
IDENTITY = ["doc_id", "event_date", "tenant_id", "service", "level", "timestamp", "trace_id", "message", "event_ts"]


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def keep_last_document(messages: DataFrame) -> DataFrame:
    """One row per document id: the latest arrival wins ``ip`` and ``ingested_at``."""
    kept = messages.groupBy(*IDENTITY).agg(
        F.max(F.struct("ingested_at", "partition", "offset", "ip")).alias("_last")
    )
    return kept.select(*IDENTITY, "_last.*")


def recent_errors(messages: DataFrame, n: int = RECENT_KEPT, payload: str = "payload") -> DataFrame:
    """The newest ``n`` error payloads per tenant and service, newest arrival first."""
    errors = messages.where(is_error(F.col("level"))).select(
        "tenant_id", "service", "ingested_at", "partition", "offset", payload
    )
    return newest_payloads(errors, n)


def newest_payloads(errors: DataFrame, n: int) -> DataFrame:
    order = [F.desc("ingested_at"), F.desc("partition"), F.desc("offset")]
    return first_per_group(errors, ["tenant_id", "service"], order, n, spread=["partition", "offset"], rank="position")


def read_recent_errors(kept: DataFrame, service: str, n: int | None = None, tenant_id: str = "default") -> DataFrame:
    """Reader of the capped list: default 10, at most 100 payloads of one service."""
    if n is not None and n <= 0:
        raise ValueError("n must be a positive integer")
    size = min(n or RECENT_DEFAULT, RECENT_KEPT)
    mine = kept.where((F.col("tenant_id") == tenant_id) & (F.col("service") == service))
    return mine.where(F.col("position") <= size).orderBy("position")


# ------------------------------------------------------------- idle counter


def error_ticks(
    messages: DataFrame, ts: str = "ingested_at", until: Column | str | dt.datetime | None = None
) -> DataFrame:
    """Errors per tenant, service and five-minute bucket, with first and last time.

    ``until`` leaves out later errors, to look at the counter of an earlier moment.
    """
    at = micros(F.col(ts))
    errors = messages.where(is_error(F.col("level")))
    if until is not None:
        errors = errors.where(F.col(ts) <= as_timestamp(until))
    return (
        errors
        .groupBy("tenant_id", "service", F.floor(at / F.lit(IDLE_SECONDS * _US)).alias("bucket"))
        .agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("errors"))
    )


def merge_ticks(parts: DataFrame) -> DataFrame:
    return parts.groupBy("tenant_id", "service", "bucket").agg(
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("errors").alias("errors")
    )


def error_islands(ticks: DataFrame) -> DataFrame:
    """Runs of errors without a quiet gap of more than five minutes."""
    by_time = Window.partitionBy("tenant_id", "service").orderBy("bucket")
    gap = micros(F.col("first_ts")) - micros(F.lag("last_ts").over(by_time))
    starts = ticks.withColumn("_new", F.coalesce((gap > IDLE_SECONDS * _US).cast("int"), F.lit(1)))
    numbered = starts.withColumn("island", F.sum("_new").over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("tenant_id", "service", "island").agg(
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("errors").alias("errors")
    )


def errors_idle_5m(ticks: DataFrame, as_of: Column | str | dt.datetime) -> DataFrame:
    """The counter that every error keeps alive for five minutes more.

    Its value at ``as_of`` is the size of the last run of errors, or 0 once five
    minutes have passed without one.  It is a live counter: ``ticks`` must not
    reach beyond ``as_of`` (see ``error_ticks(until=...)``).
    """
    now = micros(as_timestamp(as_of))
    last = error_islands(ticks).groupBy("tenant_id", "service").agg(
        F.max(F.struct("island", "last_ts", "errors")).alias("_last")
    )
    alive = now - micros(F.col("_last.last_ts")) <= IDLE_SECONDS * _US
    return last.select("tenant_id", "service", F.when(alive, F.col("_last.errors")).otherwise(F.lit(0)).alias("errors"))


# ---------------------------------------------------------- sliding counter


def errors_sliding_5m(
    messages: DataFrame, as_of: Column | str | dt.datetime, ts: str = "ingested_at", minutes: int = 5
) -> DataFrame:
    """Errors in the trailing five minutes at ``as_of``, both ends included."""
    now = as_timestamp(as_of)
    window = F.col(ts).between(now - F.expr(f"INTERVAL {int(minutes)} MINUTES"), now)
    recent = messages.where(is_error(F.col("level")) & window)
    return recent.groupBy("tenant_id", "service").agg(F.count(F.lit(1)).alias("errors"))


def errors_sliding_series(messages: DataFrame, ts: str = "ingested_at") -> DataFrame:
    """For each error time, the errors of the five minutes up to it.

    Times are counted first, then every count goes to its own five-minute chunk
    and, as look-back only, to the next one.  A window never spans more than two
    chunks, so no task sees a service as a whole.
    """
    width = IDLE_SECONDS * _US
    at = micros(F.col(ts))
    counted = (
        messages.where(is_error(F.col("level")))
        .groupBy("tenant_id", "service", at.alias("at"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    own = F.floor(F.col("at") / F.lit(width))
    spread = counted.withColumn("chunk", F.explode(F.array(own, own + 1)))
    trailing = Window.partitionBy("tenant_id", "service", "chunk").orderBy("at").rangeBetween(-width, 0)
    return (
        spread.withColumn("errors_5m", F.sum("n").over(trailing))
        .where(F.col("chunk") == F.floor(F.col("at") / F.lit(width)))
        .select("tenant_id", "service", F.timestamp_micros("at").alias("at"), "n", "errors_5m")
    )
