"""Registered queries: latency summaries, histograms, rates, dashboard panels."""

from pyspark.sql import functions as F

from tidelog.operators import telemetry as T
from tidelog.plans import derive, zones
from tidelog.plans.derive_sql import DOCUMENTS, rfc3339, with_tables
from tidelog.plans.registry import query, stamp

REQUESTS = """
requests AS (
  SELECT l_linenumber AS run, l_shipdate AS ts, CAST(round(l_extendedprice * 100) AS BIGINT) * 100 AS latency_ns,
    CASE l_returnflag WHEN 'A' THEN 202 WHEN 'R' THEN CASE l_linestatus WHEN 'F' THEN 400 ELSE 503 END
      ELSE CASE l_linestatus WHEN 'F' THEN 202 ELSE 0 END END AS status_code,
    l_returnflag = 'N' AND l_linestatus = 'O' AS failed FROM lineitem
)"""


@query("latency_summary", with_tables(REQUESTS, """
SELECT run, count(*) AS total, count(*) FILTER (ok) AS success, count(*) FILTER (NOT ok) AS failed,
  CASE WHEN max(ts) <= min(ts) THEN 1000000 ELSE date_diff('microsecond', min(ts), max(ts)) * 1000 END AS duration_ns,
  min(latency_ns) AS min_ns, CAST(sum(latency_ns) // count(*) AS BIGINT) AS avg_ns, max(latency_ns) AS max_ns,
  CAST(round(count(*) * 1e15 / (date_diff('microsecond', min(ts), max(ts)) * 1000)) AS BIGINT) AS rate_micro,
  quantile_disc(latency_ns, 0.5) AS p50, quantile_disc(latency_ns, 0.9) AS p90,
  quantile_disc(latency_ns, 0.95) AS p95, quantile_disc(latency_ns, 0.99) AS p99
FROM (SELECT *, status_code BETWEEN 200 AND 299 AND NOT failed AS ok FROM requests) GROUP BY run"""))
def latency_summary(spark, sf):
    summary = T.latency_summary(derive.request_samples(spark, sf), ["run"])
    return summary.withColumn("rate_micro", F.round(F.col("rate") * 1e6).cast("long")).drop("rate")


@query("status_code_counts", with_tables(REQUESTS, """
SELECT run, status_code, count(*) AS requests FROM requests WHERE status_code > 0 GROUP BY ALL"""))
def status_code_counts(spark, sf):
    return T.status_code_counts(derive.request_samples(spark, sf), ["run"])


def _bounds(values) -> str:
    return ", ".join(f"CAST({v!r} AS DOUBLE)" for v in values)


@query("histogram_buckets", with_tables(REQUESTS, f"""
SELECT run, CASE WHEN isinf(le) THEN '+Inf' ELSE CAST(CAST(round(le * 1000) AS BIGINT) AS VARCHAR) || 'ms' END AS le,
  (SELECT count(*) FROM requests q WHERE q.run = r.run AND q.latency_ns / 1e9 <= b.le) AS bucket_count
FROM (SELECT DISTINCT run FROM requests) r, (SELECT unnest([{_bounds(T.HTTP_SECONDS)}, CAST('inf' AS DOUBLE)]) AS le) b"""))
def histogram_buckets(spark, sf):
    samples = derive.request_samples(spark, sf).withColumn("seconds", F.col("latency_ns") / 1e9)
    buckets = T.histogram_buckets(samples, ["run"], "seconds", T.HTTP_SECONDS)
    name = F.when(F.col("le") == T.INFINITY, "+Inf").otherwise(
        F.concat(F.round(F.when(F.col("le") < T.INFINITY, F.col("le")) * 1000).cast("long").cast("string"), F.lit("ms"))
    )
    return buckets.select("run", name.alias("le"), "bucket_count")


# ------------------------------------------------------------ counter samples

SAMPLES = """
samples AS (
  SELECT ts, CAST(event_id % 5000 AS DOUBLE) AS value, user_id % 2 = 1 AS odd,
    CASE event_type WHEN 'click' THEN 'http_requests_total'
      WHEN 'error' THEN CASE WHEN user_id % 2 = 1 THEN 'kafka_dlq_messages_total' ELSE 'http_errors_total' END
      WHEN 'view' THEN CASE WHEN user_id % 2 = 1 THEN 'kafka_consumer_lag' ELSE 'kafka_messages_consumed_total' END
      WHEN 'purchase' THEN CASE WHEN user_id % 2 = 1 THEN 'bulk_batches_total' ELSE 'bulk_documents_total' END
      ELSE CASE WHEN user_id % 2 = 1 THEN 'redis_operations_total' ELSE 'elasticsearch_indexing_total' END END AS metric,
    CASE WHEN event_type = 'click' THEN CASE WHEN user_id % 2 = 1 THEN 'analytics' ELSE 'ingestor' END END AS service,
    CASE WHEN event_type IN ('purchase', 'signup') THEN CASE WHEN user_id % 5 = 0 THEN 'failure' ELSE 'success' END END AS status,
    CASE WHEN event_type = 'view' AND user_id % 2 = 1 THEN user_id % 3 END AS part
  FROM events
),
steps AS (
  SELECT *, lag(value) OVER (PARTITION BY metric, service, status, part ORDER BY ts, value) AS before FROM samples
),
increases AS (
  SELECT metric, service, status, part, date_trunc('minute', ts) AS minute,
    sum(CASE WHEN before IS NULL THEN 0 WHEN value < before THEN value ELSE value - before END) AS increase FROM steps GROUP BY ALL
)"""

_MINUTE = rfc3339("minute") + " AS minute"


def _micro(name: str):
    """A rate in millionths, as a whole number."""
    return F.round(F.col(name) * 1e6).cast("long").alias(name)


def _rate_sql(select: str, where: str) -> str:
    return with_tables(SAMPLES, f"""
SELECT {select}, {_MINUTE}, CAST(round(sum(increase) / 60 * 1e6) AS BIGINT) AS rate FROM increases WHERE {where} GROUP BY ALL""")


@query("counter_rate_1m", _rate_sql("metric, status", "true"))
def counter_rate_1m(spark, sf):
    rates = T.counter_rate_1m(derive.counter_samples(spark, sf), ["status"])
    return rates.select("metric", "status", stamp("minute"), _micro("rate"))


@query("ops_throughput", _rate_sql(
    "metric", "(metric = 'http_requests_total' AND service = 'ingestor') OR metric = 'kafka_messages_consumed_total'"))
def ops_throughput(spark, sf):
    return T.ops_throughput(derive.counter_samples(spark, sf)).select("metric", stamp("minute"), _micro("rate"))


_LATEST = """
SELECT metric, sum(value) AS total FROM (
  SELECT metric, value FROM samples WHERE metric = '{}'
  QUALIFY row_number() OVER (PARTITION BY service, status, part ORDER BY ts DESC, value DESC) = 1) GROUP BY metric"""


@query("ops_lag", with_tables(SAMPLES, _LATEST.format("kafka_consumer_lag")))
def ops_lag(spark, sf):
    return T.ops_lag(derive.counter_samples(spark, sf))


@query("ops_dlq", with_tables(SAMPLES, _LATEST.format("kafka_dlq_messages_total")))
def ops_dlq(spark, sf):
    return T.ops_dlq(derive.counter_samples(spark, sf))


@query("ops_error_ratio", with_tables(SAMPLES, f"""
SELECT {_MINUTE}, CAST(round(errors / CASE WHEN requests > 0 THEN requests ELSE 1 END * 1e6) AS BIGINT) AS error_ratio FROM (
  SELECT minute, sum(increase) FILTER (metric = 'http_errors_total') / 60 AS errors,
    sum(increase) FILTER (metric = 'http_requests_total') / 60 AS requests FROM increases GROUP BY minute) WHERE errors IS NOT NULL"""))
def ops_error_ratio(spark, sf):
    return T.ops_error_ratio(derive.counter_samples(spark, sf)).select(stamp("minute"), _micro("error_ratio"))


@query("ops_by_status", _rate_sql(
    "metric, status", "metric IN ('bulk_batches_total', 'bulk_documents_total', 'elasticsearch_indexing_total', 'redis_operations_total')"))
def ops_by_status(spark, sf):
    rates = T.ops_by_status(derive.counter_samples(spark, sf))
    return rates.select("metric", "status", stamp("minute"), _micro("rate"))


_QUANTILES = """
durations AS (
  SELECT CASE event_type WHEN 'click' THEN 'http_request_duration_seconds' ELSE 'bulk_batch_duration_seconds' END AS metric,
    CASE WHEN user_id % 2 = 1 THEN 'analytics' ELSE 'ingestor' END AS service, date_trunc('hour', ts) AS hour, value / 100 AS seconds FROM events
),
per_hour AS (
  SELECT metric, service, hour, le, count(*) FILTER (seconds <= le) AS n FROM durations, (SELECT unnest([{bounds}, CAST('inf' AS DOUBLE)]) AS le) b GROUP BY ALL
),
later AS (SELECT *, hour > min(hour) OVER (PARTITION BY metric, service) AS counts FROM per_hour),
rates AS (SELECT metric, service, hour AS minute, le, CASE WHEN counts THEN n ELSE 0 END / 60 AS rate FROM later),
laid AS (
  SELECT *, coalesce(lag(rate) OVER w, 0) AS below, coalesce(lag(le) OVER w, 0) AS low, max(rate) OVER (PARTITION BY metric, service, minute) AS total
  FROM rates WINDOW w AS (PARTITION BY metric, service, minute ORDER BY le)
)"""
_AT = "max(CASE WHEN rate >= {q} * total AND below < {q} * total THEN CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (({q} * total - below) / (rate - below)) END END)"


_P = ", ".join(f"CAST(round({_AT.format(q=q + '::DOUBLE')} * 1e6) AS BIGINT) AS {name}" for q, name in (("0.5", "p50"), ("0.95", "p95"), ("0.99", "p99")))
_LAID = _QUANTILES.format(bounds=_bounds(T.HTTP_SECONDS))


@query("ops_quantiles", with_tables(_LAID, f"SELECT metric, service, {_MINUTE}, {_P} FROM laid WHERE total > 0 GROUP BY metric, service, minute"))
def ops_quantiles(spark, sf):
    quantiles = T.ops_quantiles(derive.bucket_samples(spark, sf))
    return quantiles.select("metric", "service", stamp("minute"), _micro("p50"), _micro("p95"), _micro("p99"))


@query("ops_quantiles_of_service", with_tables(_LAID, f"""
SELECT metric, {_MINUTE}, {_P} FROM laid WHERE total > 0 AND service = 'analytics' GROUP BY metric, minute"""))
def ops_quantiles_of_service(spark, sf):
    quantiles = T.ops_quantiles(derive.bucket_samples(spark, sf), service="analytics")
    return quantiles.select("metric", stamp("minute"), _micro("p50"), _micro("p95"), _micro("p99"))


_LAG = """
  SELECT topic, "partition", greatest(max("offset" + 1)
    - max(CASE WHEN "timestamp" < as_of - INTERVAL 1 DAY THEN "offset" + 1 ELSE 0 END), 0) AS lag FROM raw_events, clock GROUP BY ALL"""


@query("consumer_lag_total", with_tables(DOCUMENTS + f", lags AS ({_LAG})", """
SELECT topic, "partition", lag FROM lags UNION ALL SELECT topic, NULL, sum(lag)::BIGINT FROM lags GROUP BY topic"""))
def consumer_lag_total(spark, sf):
    raw = zones.raw_zone(spark, sf)
    return T.lag_with_total(T.consumer_lag(derive.offset_observations(raw, zones.clock(spark, sf))))


@query("consumer_lag", with_tables(DOCUMENTS, """
SELECT topic, "partition", greatest(max("offset" + 1)
  - max(CASE WHEN "timestamp" < as_of - INTERVAL 1 DAY THEN "offset" + 1 ELSE 0 END), 0) AS lag FROM raw_events, clock GROUP BY ALL"""))
def consumer_lag(spark, sf):
    raw = zones.raw_zone(spark, sf)
    return T.consumer_lag(derive.offset_observations(raw, zones.clock(spark, sf)))
