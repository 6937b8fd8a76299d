"""Registered queries: counters, boards, windows and sets."""

from pyspark.sql import functions as F

from tidelog.operators import readers as RE
from tidelog.operators import rollups as RU
from tidelog.operators import windows as WI
from tidelog.plans import zones
from tidelog.plans.derive_sql import CLASSIFIED, DOCUMENTS, rfc3339, with_tables
from tidelog.plans.registry import day, query, stamp
from tidelog.sources import log_store, retention_runs



def _counters(spark, sf):
    return log_store.read_service_counters(spark, zones.store_root(spark, sf))


def _board(spark, sf):
    return log_store.read_error_board(spark, zones.store_root(spark, sf))


def _idle(spark, sf, root=None):
    return WI.errors_idle_5m(log_store.read_ticks(spark, root or zones.store_root(spark, sf)), zones.clock(spark, sf))


_ERR = "level IN ('ERROR', 'FATAL')"


@query("logs_total", with_tables(CLASSIFIED, "SELECT tenant_id, count(*) AS logs FROM accepted GROUP BY ALL"))
def logs_total(spark, sf):
    return RE.logs_total(_counters(spark, sf))


@query("logs_by_service", with_tables(CLASSIFIED, "SELECT tenant_id, service, count(*) AS logs FROM accepted GROUP BY ALL"))
def logs_by_service(spark, sf):
    return RE.logs_by_service(_counters(spark, sf))


@query("logs_by_level", with_tables(CLASSIFIED, "SELECT tenant_id, lower(level) AS level, count(*) AS logs FROM accepted GROUP BY ALL"))
def logs_by_level(spark, sf):
    return RE.logs_by_level(_counters(spark, sf))


@query("errors_by_service", with_tables(CLASSIFIED, f"""
SELECT tenant_id, service, count(*) AS errors FROM accepted WHERE {_ERR} GROUP BY ALL"""))
def errors_by_service(spark, sf):
    return RE.errors_by_service(_counters(spark, sf))


@query("unique_ips_daily", with_tables(CLASSIFIED, """
SELECT tenant_id, strftime(ingested_at, '%Y-%m-%d') AS day, count(DISTINCT ip) AS unique_ips FROM accepted WHERE ip IS NOT NULL GROUP BY ALL"""))
def unique_ips_daily(spark, sf):
    members = log_store.read_ip_members(spark, zones.store_root(spark, sf))
    return RE.unique_ips_daily(members).withColumn("day", day("day"))


@query("unique_ips_members", with_tables(CLASSIFIED, f"""
SELECT tenant_id, strftime(ingested_at, '%Y-%m-%d') AS day, ip, {rfc3339('max(ingested_at)')} AS last_seen
FROM accepted WHERE ip IS NOT NULL GROUP BY tenant_id, strftime(ingested_at, '%Y-%m-%d'), ip"""))
def unique_ips_members(spark, sf):
    rows = log_store.read_ip_members(spark, zones.store_root(spark, sf))
    return rows.select("tenant_id", day("day"), "ip", stamp("last_seen"))


@query("unique_ips_live", with_tables(DOCUMENTS, """
SELECT tenant_id, strftime(day, '%Y-%m-%d') AS day, unique_ips FROM (
  SELECT tenant_id, CAST(ingested_at AS DATE) AS day, count(DISTINCT ip) AS unique_ips, max(ingested_at) AS last_seen
  FROM accepted WHERE ip IS NOT NULL GROUP BY ALL), clock WHERE last_seen >= as_of - INTERVAL 24 HOURS"""))
def unique_ips_live(spark, sf):
    members = log_store.read_ip_members(spark, zones.store_root(spark, sf))
    return RU.unique_ips_live(members, zones.clock(spark, sf)).withColumn("day", day("day"))


# ----------------------------------------------------- five-minute counters

#: The end of the five minutes with most errors, the latest of equal ones: a moment at which the counters are not zero.
BUSY = f""",
busy AS (
  SELECT make_timestamp((b + 1) * 300000000) AS as_of FROM (
    SELECT epoch_us(ingested_at) // 300000000 AS b, count(*) AS n FROM accepted WHERE {_ERR} GROUP BY 1 ORDER BY n DESC, b DESC LIMIT 1)
)"""


def _islands(clock: str, until: str = "") -> str:
    return f""",
marked AS (
  SELECT tenant_id, service, ingested_at,
    CASE WHEN ingested_at - lag(ingested_at) OVER w <= INTERVAL 5 MINUTES THEN 0 ELSE 1 END AS fresh
  FROM accepted WHERE {_ERR}{until}
  WINDOW w AS (PARTITION BY tenant_id, service ORDER BY ingested_at)
),
numbered AS (
  SELECT *, sum(fresh) OVER (PARTITION BY tenant_id, service ORDER BY ingested_at RANGE UNBOUNDED PRECEDING) AS island FROM marked
),
islands AS (
  SELECT tenant_id, service, island, min(ingested_at) AS first_ts, max(ingested_at) AS last_ts, count(*) AS errors FROM numbered GROUP BY ALL
),
idle AS (
  SELECT tenant_id, service, CASE WHEN (SELECT as_of FROM {clock}) - last_ts <= INTERVAL 5 MINUTES THEN errors ELSE 0 END AS errors
  FROM islands QUALIFY row_number() OVER (PARTITION BY tenant_id, service ORDER BY island DESC) = 1
)"""


ISLANDS = _islands("clock")
BUSY_ISLANDS = BUSY + _islands("busy", " AND ingested_at < (SELECT as_of FROM busy)")


@query("errors_idle_5m", with_tables(DOCUMENTS + BUSY_ISLANDS, "SELECT tenant_id, service, errors FROM idle"))
def errors_idle_5m(spark, sf):
    ticks = log_store.read_ticks(spark, zones.store_root(spark, sf))
    return WI.errors_idle_5m(ticks.where(F.col("last_ts") < zones.busy_clock(spark, sf)), zones.busy_clock(spark, sf))


@query("errors_idle_5m_latest", with_tables(DOCUMENTS + ISLANDS, "SELECT tenant_id, service, errors FROM idle"))
def errors_idle_5m_latest(spark, sf):
    return _idle(spark, sf)


@query("error_islands", with_tables(DOCUMENTS + ISLANDS, f"""
SELECT tenant_id, service, {rfc3339('first_ts')} AS first_ts, {rfc3339('last_ts')} AS last_ts, errors FROM islands"""))
def error_islands(spark, sf):
    islands = WI.error_islands(log_store.read_ticks(spark, zones.store_root(spark, sf)))
    return islands.select("tenant_id", "service", stamp("first_ts"), stamp("last_ts"), "errors")


@query("errors_sliding_5m", with_tables(DOCUMENTS + BUSY, f"""
SELECT tenant_id, service, count(*) AS errors FROM accepted, busy
WHERE {_ERR} AND ingested_at BETWEEN as_of - INTERVAL 5 MINUTES AND as_of GROUP BY ALL"""))
def errors_sliding_5m(spark, sf):
    return WI.errors_sliding_5m(zones.messages(spark, sf), zones.busy_clock(spark, sf))


@query("errors_sliding_6h", with_tables(DOCUMENTS, f"""
SELECT tenant_id, service, count(*) AS errors FROM accepted, clock
WHERE {_ERR} AND ingested_at BETWEEN as_of - INTERVAL 360 MINUTES AND as_of GROUP BY ALL"""))
def errors_sliding_6h(spark, sf):
    return WI.errors_sliding_5m(zones.messages(spark, sf), zones.clock(spark, sf), minutes=360)


@query("errors_sliding_series", with_tables(CLASSIFIED, f"""
SELECT DISTINCT tenant_id, service, {rfc3339('ingested_at')} AS at,
  count(*) OVER (PARTITION BY tenant_id, service, ingested_at) AS n,
  count(*) OVER (PARTITION BY tenant_id, service ORDER BY ingested_at RANGE BETWEEN INTERVAL 5 MINUTES PRECEDING AND CURRENT ROW) AS errors_5m
FROM accepted WHERE {_ERR}"""))
def errors_sliding_series(spark, sf):
    return WI.errors_sliding_series(zones.messages(spark, sf)).withColumn("at", stamp("at"))


@query("recent_errors", with_tables(CLASSIFIED, f"""
SELECT tenant_id, service, value AS payload, position FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, service ORDER BY ingested_at DESC, "partition" DESC, "offset" DESC) AS position
  FROM accepted WHERE {_ERR}) WHERE position <= 100"""))
def recent_errors(spark, sf):
    kept = log_store.read_recent(spark, zones.store_root(spark, sf))
    return kept.select("tenant_id", "service", "payload", "position")


@query("read_recent_errors", with_tables(CLASSIFIED, f"""
SELECT value AS payload FROM accepted WHERE {_ERR} AND tenant_id = 'default' AND service = 'svc-2'
ORDER BY ingested_at DESC, "partition" DESC, "offset" DESC LIMIT 10"""))
def read_recent_errors(spark, sf):
    kept = log_store.read_recent(spark, zones.store_root(spark, sf))
    return WI.read_recent_errors(kept, "svc-2").select("payload")


# ------------------------------------------------------- boards, live metrics


@query("top_services", with_tables(CLASSIFIED, """
SELECT service, count(*) AS count FROM accepted WHERE tenant_id = 'default' GROUP BY ALL ORDER BY count DESC, service DESC LIMIT 5"""))
def top_services(spark, sf):
    return RE.top_services(_counters(spark, sf), 5)


@query("top_errors", with_tables(CLASSIFIED, f"""
SELECT message, count(*) AS count FROM accepted WHERE tenant_id = 'default' AND {_ERR} GROUP BY ALL ORDER BY count DESC, message DESC LIMIT 10"""))
def top_errors(spark, sf):
    return RE.top_errors(_board(spark, sf))


@query("top_n_per_tenant", with_tables(CLASSIFIED, f"""
SELECT tenant_id, board, member, count, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, board ORDER BY count DESC, member DESC) AS rank FROM (
    SELECT tenant_id, 'services' AS board, service AS member, count(*) AS count FROM accepted GROUP BY ALL
    UNION ALL SELECT tenant_id, 'errors', message, count(*) FROM accepted WHERE {_ERR} GROUP BY ALL)) WHERE rank <= 10"""))
def top_n_per_tenant(spark, sf):
    return RE.top_n_per_tenant(_counters(spark, sf), _board(spark, sf))


_LIVE = with_tables(DOCUMENTS + ISLANDS, f"""
SELECT a.service, (SELECT count(*) FROM accepted WHERE tenant_id = 'default') AS tenant_total_logs, count(*) AS total_logs,
  count(*) FILTER ({_ERR}) AS total_errors, coalesce(any_value(i.errors), 0) AS errors_last_5m
FROM accepted a LEFT JOIN idle i ON i.tenant_id = 'default' AND i.service = a.service WHERE a.tenant_id = 'default' GROUP BY a.service""")


@query("live_metrics", _LIVE)
def live_metrics(spark, sf):
    return RE.live_metrics(_counters(spark, sf), _idle(spark, sf))


# Counters count messages: neither merging a store nor dropping days changes them.
@query("live_metrics_after_retention", _LIVE)
def live_metrics_after_retention(spark, sf):
    root = zones.scratch(spark, sf, "live-after-retention")
    zones.load_store(spark, sf, root)
    retention_runs.delete_before(spark, root, "2024-01-20T00:00:00Z", "2024-02-01T00:00:00Z")
    return RE.live_metrics(log_store.read_service_counters(spark, root), _idle(spark, sf, root))


@query("live_metrics_after_compaction", _LIVE)
def live_metrics_after_compaction(spark, sf):
    root, target = zones.streamed_root(spark, sf), zones.scratch(spark, sf, "live-after-compaction")
    last = log_store.read_messages(spark, root).agg(F.max("batch_id")).first()[0]
    log_store.compact_store(spark, root, target, last)
    return RE.live_metrics(log_store.read_service_counters(spark, target), _idle(spark, sf, target))


@query("requested_services_zero_fill", with_tables(DOCUMENTS + ISLANDS, f"""
SELECT s AS service, (SELECT count(*) FROM accepted WHERE tenant_id = 'tenant-a') AS tenant_total_logs,
  (SELECT count(*) FROM accepted WHERE tenant_id = 'tenant-a' AND service = s) AS total_logs,
  (SELECT count(*) FROM accepted WHERE tenant_id = 'tenant-a' AND service = s AND {_ERR}) AS total_errors,
  coalesce((SELECT errors FROM idle WHERE tenant_id = 'tenant-a' AND service = s), 0) AS errors_last_5m
FROM (SELECT unnest(['svc-1', 'svc-4', 'no-such-service']) AS s)"""))
def requested_services_zero_fill(spark, sf):
    return RE.live_metrics(_counters(spark, sf), _idle(spark, sf), " svc-1, svc-4,, no-such-service", tenant_id="tenant-a")


@query("rate_limit_report", with_tables(CLASSIFIED, f"""
SELECT ip, {rfc3339("date_trunc('day', ingested_at)")} AS window_start, count(*) AS requests
FROM accepted WHERE ip IS NOT NULL GROUP BY ip, date_trunc('day', ingested_at) HAVING count(*) > 1"""))
def rate_limit_report(spark, sf):
    # One request a day instead of 100 a minute: the test data is sparse.
    report = RU.rate_limit_report(zones.messages(spark, sf), limit=1, window="1 day")
    return report.withColumn("window_start", stamp("window_start"))


@query("rate_limit_report_minute", with_tables(CLASSIFIED, f"""
SELECT ip, {rfc3339("date_trunc('minute', ingested_at)")} AS window_start, count(*) AS requests
FROM accepted WHERE ip IS NOT NULL GROUP BY ip, date_trunc('minute', ingested_at) HAVING count(*) > 100"""))
def rate_limit_report_minute(spark, sf):
    return RU.rate_limit_report(zones.messages(spark, sf)).withColumn("window_start", stamp("window_start"))


