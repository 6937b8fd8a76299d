"""Per-tenant counters, boards and live metrics over accepted messages.

Counters count messages: a message sent twice counts twice even though the
store keeps one document for it.  Every aggregate combines on the map side, so
a service that owns a third of the rows costs no more than any other.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.text import DEFAULT_TENANT, is_error, split_list
from tidelog.functions.times import as_timestamp
from tidelog.operators.ranking import first_per_group

# Limits of the boards (fixed values).
BOARD_DEFAULT = 10
BOARD_MAX = 100
IP_SET_TTL_HOURS = 24


def _count() -> Column:
    return F.count(F.lit(1))


# ---------------------------------------------------------------- counters


def logs_total(messages: DataFrame) -> DataFrame:
    return messages.groupBy("tenant_id").agg(_count().alias("logs"))


def logs_by_service(messages: DataFrame) -> DataFrame:
    return messages.groupBy("tenant_id", "service").agg(_count().alias("logs"))


def logs_by_level(messages: DataFrame) -> DataFrame:
    return messages.groupBy("tenant_id", F.lower("level").alias("level")).agg(_count().alias("logs"))


def errors_by_service(messages: DataFrame) -> DataFrame:
    return messages.where(is_error(F.col("level"))).groupBy("tenant_id", "service").agg(_count().alias("errors"))


def counters(messages: DataFrame) -> DataFrame:
    """All counters as narrow rows ``(tenant_id, metric, dim, value)``, error board included."""
    return service_counters(messages).unionByName(error_board(messages))


def service_counters(messages: DataFrame) -> DataFrame:
    """Counters per tenant, service and level.

    One pass groups by all three; the unpivot then runs on that small result.
    """
    base = messages.groupBy("tenant_id", "service", "level").agg(_count().alias("n"))

    def row(metric: str, dim: Column) -> Column:
        return F.struct(F.lit(metric).alias("metric"), dim.alias("dim"))

    kinds = F.array_compact(
        F.array(
            row("logs_total", F.lit("")),
            row("logs_service", F.col("service")),
            row("logs_level", F.lower("level")),
            F.when(is_error(F.col("level")), row("errors_service", F.col("service"))),
        )
    )
    return (
        base.select("tenant_id", "n", F.inline(kinds))
        .groupBy("tenant_id", "metric", "dim")
        .agg(F.sum("n").alias("value"))
    )


def error_board(messages: DataFrame) -> DataFrame:
    """Counts per error message; by far the largest of the counters, so a table of its own."""
    return (
        messages.where(is_error(F.col("level")))
        .groupBy("tenant_id", F.lit("leaderboard_errors").alias("metric"), F.col("message").alias("dim"))
        .agg(_count().alias("value"))
    )


def merge_counters(parts: DataFrame) -> DataFrame:
    """Sum the per-batch parts that the stream wrote."""
    return parts.groupBy("tenant_id", "metric", "dim").agg(F.sum("value").alias("value"))


# --------------------------------------------------------------- unique IPs


def unique_ips(messages: DataFrame, day: str = "ingested_at") -> DataFrame:
    """Members of the daily sets with the time of the last add.

    ``day`` is the arrival time by default; pass ``event_ts`` for event days.
    """
    return (
        messages.where(F.col("ip").isNotNull())
        .groupBy("tenant_id", F.to_date(day).alias("day"), "ip")
        .agg(F.max("ingested_at").alias("last_seen"))
    )


def merge_ips(parts: DataFrame) -> DataFrame:
    return parts.groupBy("tenant_id", "day", "ip").agg(F.max("last_seen").alias("last_seen"))


def unique_ips_daily(messages: DataFrame, day: str = "ingested_at", approximate: bool = False) -> DataFrame:
    """Size of each daily set; ``approximate`` trades exactness for one small sketch per set."""
    members = messages.where(F.col("ip").isNotNull())
    size = F.approx_count_distinct("ip") if approximate else F.count_distinct("ip")
    return members.groupBy("tenant_id", F.to_date(day).alias("day")).agg(size.alias("unique_ips"))


def unique_ips_live(members: DataFrame, as_of: Column | str | dt.datetime) -> DataFrame:
    """Sizes of the sets whose last add is at most 24 hours old.

    ``members`` are the rows of ``unique_ips``, one per address.
    """
    sets = members.groupBy("tenant_id", "day").agg(
        F.max("last_seen").alias("last_seen"), _count().alias("unique_ips")
    )
    oldest = as_timestamp(as_of) - F.expr(f"INTERVAL {IP_SET_TTL_HOURS} HOURS")
    return sets.where(F.col("last_seen") >= oldest).select("tenant_id", "day", "unique_ips")


# ------------------------------------------------------------- live metrics


def service_totals(messages: DataFrame, idle: DataFrame) -> DataFrame:
    """Per tenant and service: logs, errors and the live five-minute counter.

    ``idle`` is ``windows.errors_idle_5m``; it holds a row per service at most.
    """
    totals = messages.groupBy("tenant_id", "service").agg(
        _count().alias("total_logs"), F.count_if(is_error(F.col("level"))).alias("total_errors")
    )
    recent = idle.select("tenant_id", "service", F.col("errors").alias("errors_last_5m"))
    return totals.join(recent, ["tenant_id", "service"], "left").fillna(0, ["errors_last_5m"])


def wanted_services(services: str | list[str] | None) -> list[str] | None:
    """The requested services, or None for all known ones."""
    names = split_list(services) if isinstance(services, str) else [s.strip() for s in services or [] if s.strip()]
    return None if not names or names == ["all"] else sorted(set(names))


def requested_services_zero_fill(totals: DataFrame, services: list[str]) -> DataFrame:
    """One row per requested service; an unknown one has zeros."""
    measures = [c for c in totals.columns if c not in ("tenant_id", "service")]
    names = F.array(*[F.lit(s) for s in services])
    wanted = totals.sparkSession.range(1).select(F.explode(names).alias("service"))
    return wanted.join(totals.drop("tenant_id"), "service", "left").fillna(0, measures)


def live_metrics(
    messages: DataFrame,
    idle: DataFrame,
    services: str | list[str] | None = None,
    tenant_id: str = DEFAULT_TENANT,
) -> DataFrame:
    """Tenant total beside each service's numbers.

    A list of names limits the services; empty or ``all`` means every known one.
    """
    mine = messages.where(F.col("tenant_id") == tenant_id)
    totals = service_totals(mine, idle.where(F.col("tenant_id") == tenant_id))
    wanted = wanted_services(services)
    if wanted is None:
        # Every service is listed, so the tenant total is the sum of the rows;
        # the window runs over one row per service.
        whole = Window.partitionBy("tenant_id")
        return totals.select(
            "service", F.sum("total_logs").over(whole).alias("tenant_total_logs"),
            "total_logs", "total_errors", "errors_last_5m",
        )
    total = mine.agg(_count().alias("n")).scalar()
    return requested_services_zero_fill(totals, wanted).select(
        "service", total.alias("tenant_total_logs"), "total_logs", "total_errors", "errors_last_5m"
    )


# -------------------------------------------------------------------- boards


def board_size(n: int | None) -> int:
    """Default 10, at most 100; zero and negative sizes are refused."""
    if n is None:
        return BOARD_DEFAULT
    if n <= 0:
        raise ValueError("n must be a positive integer")
    return min(n, BOARD_MAX)


def top_services(messages: DataFrame, n: int | None = None, tenant_id: str = DEFAULT_TENANT) -> DataFrame:
    """Services by volume; ties in reverse lexical order."""
    counts = messages.where(F.col("tenant_id") == tenant_id).groupBy("service").agg(_count().alias("count"))
    return counts.orderBy(F.desc("count"), F.desc("service")).limit(board_size(n))


def top_errors(messages: DataFrame, n: int | None = None, tenant_id: str = DEFAULT_TENANT) -> DataFrame:
    """Error messages by frequency; ties in reverse lexical order."""
    mine = messages.where((F.col("tenant_id") == tenant_id) & is_error(F.col("level")))
    counts = mine.groupBy("message").agg(_count().alias("count"))
    return counts.orderBy(F.desc("count"), F.desc("message")).limit(board_size(n))


def top_n_per_tenant(messages: DataFrame, n: int | None = None) -> DataFrame:
    """Both boards of every tenant: ``(tenant_id, board, member, count, rank)``."""
    services = messages.groupBy(
        "tenant_id", F.lit("services").alias("board"), F.col("service").alias("member")
    ).agg(_count().alias("count"))
    errors = (
        messages.where(is_error(F.col("level")))
        .groupBy("tenant_id", F.lit("errors").alias("board"), F.col("message").alias("member"))
        .agg(_count().alias("count"))
    )
    return first_per_group(
        services.unionByName(errors),
        ["tenant_id", "board"],
        [F.desc("count"), F.desc("member")],
        board_size(n),
        spread=["member"],
        rank="rank",
    )


# ----------------------------------------------------------- store outcomes


def bulk_result(rows: DataFrame, batch: Column | str) -> DataFrame:
    """Per batch: documents stored and refused, and the batch status.

    ``rows`` are classified records; records that did not parse were never sent.
    """
    sent = rows.where(F.coalesce(F.col("reject_reason"), F.lit("")) != "parse_error")
    key = F.col(batch) if isinstance(batch, str) else batch
    per_batch = sent.groupBy(key.alias("batch")).agg(
        _count().alias("total_docs"),
        F.count_if(F.col("reject_reason").isNull()).alias("success_docs"),
        F.count_if(F.col("reject_reason").isNotNull()).alias("failed_docs"),
    )
    status = (
        F.when(F.col("failed_docs") == 0, "success")
        .when(F.col("success_docs") > 0, "partial_failure")
        .otherwise("failure")
    )
    return per_batch.withColumn("status", status)


def failures_by_reason(dlq: DataFrame) -> DataFrame:
    return dlq.groupBy("topic", "reason").agg(_count().alias("failures"))


def terms_by_service(documents: DataFrame, as_of: Column | str | dt.datetime, hours: int = 1) -> DataFrame:
    """Documents per service over the last hour before ``as_of``."""
    since = as_timestamp(as_of) - F.expr(f"INTERVAL {int(hours)} HOURS")
    recent = documents.where((F.col("event_ts") >= since) & (F.col("event_date") >= F.to_date(since)))
    return recent.groupBy("service").agg(_count().alias("doc_count"))


def rate_limit_report(
    requests: DataFrame, ip: str = "ip", ts: str = "ingested_at", limit: int = 100, window: str = "1 minute"
) -> DataFrame:
    """Addresses with more than ``limit`` requests in a fixed one-minute window."""
    per_window = (
        requests.where(F.col(ip).isNotNull())
        .groupBy(F.col(ip).alias("ip"), F.window(ts, window).alias("w"))
        .agg(_count().alias("requests"))
    )
    return per_window.where(F.col("requests") > limit).select(
        "ip", F.col("w.start").alias("window_start"), "requests"
    )
