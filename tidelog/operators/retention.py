"""Daily index inventory and retention plans.

Plans are DataFrames over one row per day, so they are cheap at any data size
and can be inspected before anything is dropped.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.times import as_timestamp, index_day, index_name, parse_moment

# Default of a tenant without an enabled policy (fixed value).
DEFAULT_RETENTION_DAYS = 30

KEEP, DROP, SKIP = "keep", "delete", "skip"


class InvalidIndexName(ValueError):
    """The name is not a daily index name."""


class ProtectedIndex(ValueError):
    """Today's index takes writes and is never dropped."""


class IndexNotFound(LookupError):
    """There is no such day in the store."""


def parse_index_name(names: DataFrame, name: str = "name") -> DataFrame:
    """Add the ``day`` of each name; NULL for a name that is not a daily index."""
    return names.withColumn("day", index_day(F.col(name)))


def index_documents(documents: DataFrame, compacted: bool = False) -> DataFrame:
    """Documents per day: ids are counted once whatever number of copies is stored.

    A compacted store holds every id once and is counted without a shuffle of ids.
    """
    if not compacted:
        # 16 bytes instead of 32 hex digits through the shuffle.
        documents = documents.select("event_date", F.unhex("doc_id").alias("id")).distinct()
    return documents.groupBy("event_date").agg(F.count(F.lit(1)).alias("doc_count"))


def list_indices(documents: DataFrame, files: DataFrame | None = None, compacted: bool = False) -> DataFrame:
    """Inventory of the store: ``name, doc_count, store_size_bytes, creation_date, status``.

    ``files`` is ``log_store.store_files``; without it sizes and dates are NULL.
    """
    days = index_documents(documents, compacted)
    if files is None:
        sized = days.withColumn("store_size_bytes", F.lit(None).cast("long")).withColumn(
            "creation_date", F.lit(None).cast("timestamp")
        )
    else:
        per_day = files.groupBy("event_date").agg(
            F.sum("length").alias("store_size_bytes"), F.min("modificationTime").alias("creation_date")
        )
        sized = days.join(per_day, "event_date", "left")
    return sized.select(
        index_name(F.col("event_date")).alias("name"), "doc_count", "store_size_bytes", "creation_date",
        F.lit("open").alias("status"),
    )


def index_stats(indices: DataFrame) -> DataFrame:
    """Totals over all indices; oldest and newest only among well-formed names."""
    dated = parse_index_name(indices)
    named = F.when(F.col("day").isNotNull(), F.struct("day", "name"))
    totals = dated.agg(
        F.coalesce(F.sum("doc_count"), F.lit(0)).alias("total_logs"),
        F.count(F.lit(1)).alias("total_indices"),
        F.coalesce(F.sum("store_size_bytes"), F.lit(0)).alias("total_size_bytes"),
        F.min(named).alias("_old"),
        F.max(named).alias("_new"),
    )
    return totals.select(
        "total_logs", "total_indices", "total_size_bytes",
        F.col("_old.name").alias("oldest_index"), F.col("_old.day").alias("oldest_log_date"),
        F.col("_new.name").alias("newest_index"), F.col("_new.day").alias("newest_log_date"),
    )


def _plan(indices: DataFrame, now: Column, expired: Column) -> DataFrame:
    dated = parse_index_name(indices.select("name"))
    active = F.col("name") == index_name(F.to_date(now))
    reason = (
        F.when(F.col("day").isNull(), "not_a_daily_index")
        .when(active, "active_write_index")
        .when(expired, "expired")
        .otherwise("within_retention")
    )
    action = F.when(reason == "not_a_daily_index", SKIP).when(reason == "expired", DROP).otherwise(KEEP)
    return dated.select("name", "day", action.alias("action"), reason.alias("reason"))


def retention_plan(indices: DataFrame, retention_days: int, as_of: Column | str | dt.datetime) -> DataFrame:
    """What a retention run does with each index.

    A day expires when it lies strictly before midnight of ``as_of`` minus
    ``retention_days``.  Today's index is always kept.
    """
    if retention_days <= 0:
        raise ValueError("retention days must be a positive integer greater than zero")
    now = as_timestamp(as_of)
    cutoff = F.date_sub(F.to_date(now), retention_days)
    return _plan(indices, now, F.col("day") < cutoff)


def delete_before_plan(
    indices: DataFrame, before: str | dt.datetime, as_of: Column | str | dt.datetime
) -> DataFrame:
    """What dropping everything before a time does with each index.

    The *midnight* of a day is compared, so a cutoff at noon drops that day too.
    """
    if not isinstance(as_of, Column) and _moment(before) > _moment(as_of):
        raise ValueError("cutoff timestamp cannot be in the future")
    now = as_timestamp(as_of)
    return _plan(indices, now, F.col("day").cast("timestamp") < as_timestamp(before))


def _moment(value: str | dt.datetime) -> dt.datetime:
    return parse_moment(value) if isinstance(value, str) else value


def plan_summary(plan: DataFrame) -> DataFrame:
    return plan.agg(
        F.count(F.lit(1)).alias("evaluated"), F.count_if(F.col("action") == DROP).alias("deleted")
    )


def retention_by_policy(
    documents: DataFrame,
    policies: DataFrame,
    as_of: Column | str | dt.datetime,
    default_days: int = DEFAULT_RETENTION_DAYS,
) -> DataFrame:
    """Per tenant and stored day: documents, the days granted, and whether they ran out.

    An absent or disabled policy means ``default_days``.
    """
    per_id = documents.select("tenant_id", "event_date", F.unhex("doc_id").alias("id")).distinct()
    stored = per_id.groupBy("tenant_id", "event_date").agg(F.count(F.lit(1)).alias("doc_count"))
    granted = policies.where("enabled").select("tenant_id", "retention_days")
    joined = stored.join(granted, "tenant_id", "left").withColumn(
        "retention_days", F.coalesce("retention_days", F.lit(default_days))
    )
    cutoff = F.date_sub(F.to_date(as_timestamp(as_of)), F.col("retention_days"))
    return joined.withColumn("expired", F.col("event_date") < cutoff)
