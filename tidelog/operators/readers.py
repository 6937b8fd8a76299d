"""Live metrics, boards and sets from the merged metric parts.

Counters were counted when messages came in, so nothing here looks at the document
store: compaction and retention do not change any of these numbers, and a query
costs what the few counter rows cost.  ``counters`` are rows
``(tenant_id, metric, dim, value)``, ``board`` the error board in the same form,
``members`` the rows of the daily address sets, ``idle`` the five-minute counters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.text import DEFAULT_TENANT
from tidelog.operators.ranking import first_per_group
from tidelog.operators.rollups import board_size, requested_services_zero_fill, wanted_services


def _metric(counters: DataFrame, name: str) -> DataFrame:
    return counters.where(F.col("metric") == name)


def logs_total(counters: DataFrame) -> DataFrame:
    return _metric(counters, "logs_total").select("tenant_id", F.col("value").alias("logs"))


def logs_by_service(counters: DataFrame) -> DataFrame:
    return _metric(counters, "logs_service").select("tenant_id", F.col("dim").alias("service"), F.col("value").alias("logs"))


def logs_by_level(counters: DataFrame) -> DataFrame:
    return _metric(counters, "logs_level").select("tenant_id", F.col("dim").alias("level"), F.col("value").alias("logs"))


def errors_by_service(counters: DataFrame) -> DataFrame:
    return _metric(counters, "errors_service").select("tenant_id", F.col("dim").alias("service"), F.col("value").alias("errors"))


def unique_ips_daily(members: DataFrame) -> DataFrame:
    return members.groupBy("tenant_id", "day").agg(F.count(F.lit(1)).alias("unique_ips"))


def service_totals(counters: DataFrame, idle: DataFrame) -> DataFrame:
    """Per tenant and service: logs, errors and the live five-minute counter."""
    both = counters.where(F.col("metric").isin("logs_service", "errors_service"))

    def total(metric: str):
        return F.coalesce(F.sum(F.when(F.col("metric") == metric, F.col("value"))), F.lit(0))

    totals = both.groupBy("tenant_id", F.col("dim").alias("service")).agg(
        total("logs_service").alias("total_logs"), total("errors_service").alias("total_errors")
    )
    recent = idle.select("tenant_id", "service", F.col("errors").alias("errors_last_5m"))
    return totals.join(recent, ["tenant_id", "service"], "left").fillna(0, ["errors_last_5m"])


def live_metrics(
    counters: DataFrame, idle: DataFrame, services: str | list[str] | None = None, tenant_id: str = DEFAULT_TENANT
) -> DataFrame:
    """Tenant total beside each service's numbers; see ``rollups.live_metrics``."""
    mine = counters.where(F.col("tenant_id") == tenant_id)
    totals = service_totals(mine, idle.where(F.col("tenant_id") == tenant_id))
    wanted = wanted_services(services)
    if wanted is None:
        # One row per service; their sum is the tenant's total.
        total = F.sum("total_logs").over(Window.partitionBy("tenant_id"))
        rows = totals
    else:
        total = F.coalesce(logs_total(mine).agg(F.sum("logs")).scalar(), F.lit(0).cast("long"))
        rows = requested_services_zero_fill(totals, wanted)
    return rows.select("service", total.alias("tenant_total_logs"), "total_logs", "total_errors", "errors_last_5m")


def _board(counters: DataFrame, metric: str, member: str, n: int | None, tenant_id: str) -> DataFrame:
    mine = _metric(counters, metric).where(F.col("tenant_id") == tenant_id)
    rows = mine.select(F.col("dim").alias(member), F.col("value").alias("count"))
    return rows.orderBy(F.desc("count"), F.desc(member)).limit(board_size(n))


def top_services(counters: DataFrame, n: int | None = None, tenant_id: str = DEFAULT_TENANT) -> DataFrame:
    """Services by volume; ties in reverse lexical order."""
    return _board(counters, "logs_service", "service", n, tenant_id)


def top_errors(board: DataFrame, n: int | None = None, tenant_id: str = DEFAULT_TENANT) -> DataFrame:
    """Error messages by frequency; ties in reverse lexical order."""
    return _board(board, "leaderboard_errors", "message", n, tenant_id)


def top_n_per_tenant(counters: DataFrame, board: DataFrame, n: int | None = None) -> DataFrame:
    """Both boards of every tenant: ``(tenant_id, board, member, count, rank)``."""
    services = _metric(counters, "logs_service").withColumn("board", F.lit("services"))
    rows = services.unionByName(board.withColumn("board", F.lit("errors")))
    rows = rows.select("tenant_id", "board", F.col("dim").alias("member"), F.col("value").alias("count"))
    order = [F.desc("count"), F.desc("member")]
    return first_per_group(rows, ["tenant_id", "board"], order, board_size(n), spread=["member"], rank="rank")
