"""Registered queries: parsing, validation, routing, rejects, export."""

from pyspark.sql import functions as F

from tidelog.functions.net import valid_ip
from tidelog.functions.text import is_error, metric_key, tenant_or_default
from tidelog.functions.times import index_name, parse_rfc3339
from tidelog.operators import ingest as I
from tidelog.operators import rollups as RU
from tidelog.operators.retention import parse_index_name
from tidelog.plans import derive, zones
from tidelog.plans.derive_sql import CLASSIFIED, DOCUMENTS, PARSED, RAW_EVENTS, RFC3339, V4, rfc3339, with_tables
from tidelog.plans.registry import day, query, stamp
from tidelog.sources import log_store, ndjson, synthetic


@query("src_raw_events", with_tables(RAW_EVENTS, f"""
SELECT key, value, topic, "partition", "offset", {rfc3339('"timestamp"')} AS arrived FROM raw_events"""))
def src_raw_events(spark, sf):
    raw = zones.raw_zone(spark, sf)
    return raw.select("key", "value", "topic", "partition", "offset", stamp("timestamp", "arrived"))


@query("src_log_store", with_tables(CLASSIFIED, f"""
SELECT doc_id, tenant_id, "timestamp", level, service, message, trace_id, ip, "partition", "offset",
  {rfc3339('ingested_at')} AS ingested_at, {rfc3339('event_ts')} AS event_ts,
  strftime(event_date, '%Y-%m-%d') AS event_date FROM accepted"""))
def src_log_store(spark, sf):
    return zones.messages(spark, sf).select(
        "doc_id", "tenant_id", "timestamp", "level", "service", "message", "trace_id", "ip", "partition", "offset",
        stamp("ingested_at"), stamp("event_ts"), day("event_date"),
    )


_TEMPLATES_SQL = "CASE level " + " ".join(
    f"WHEN '{level}' THEN list_extract([{', '.join(repr(t) for t in texts)}], (d3 % {len(texts)}) + 1)"
    for level, texts in synthetic.TEMPLATES.items()
) + " END"

_SYNTHETIC_SQL = with_tables(f"""
digests AS (SELECT event_id AS id, ts, sha256('42:' || event_id) AS h FROM events),
draws AS (
  SELECT id, ts, h, {', '.join(f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT) AS d{i}" for i in range(6))} FROM digests
),
levels AS (
  SELECT *, CASE WHEN d0 < floor(0.70 * 4294967296) THEN 'INFO' WHEN d0 < floor(0.85 * 4294967296) THEN 'DEBUG'
    WHEN d0 < floor(0.95 * 4294967296) THEN 'WARN' WHEN d0 < floor(0.99 * 4294967296) THEN 'ERROR' ELSE 'FATAL' END AS level
  FROM draws
)""", f"""
SELECT id, regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0{{1,6}}$', '') || 'Z' AS "timestamp", level,
  list_extract(['payment-api', 'auth-service', 'order-service'], (d2 % 3) + 1) AS service,
  replace(replace({_TEMPLATES_SQL}, '%d', CAST(d4 % 1000 + 1 AS VARCHAR)), '%%', '%') AS message,
  'trace-' || substr(h, 49, 16) AS trace_id,
  '192.168.' || (d5 % 254 + 1) || '.' || (d1 % 254 + 1) AS ip FROM levels""")


@query("src_synthetic_logs", _SYNTHETIC_SQL)
def src_synthetic_logs(spark, sf):
    return synthetic.synthetic_logs(derive.table(spark, sf, "events"), synthetic.SyntheticConfig(), "event_id", "ts")


DLQ_SQL = with_tables(CLASSIFIED, f"SELECT * REPLACE ({rfc3339('arrived_at')} AS arrived_at) FROM dlq")


@query("sink_dlq", DLQ_SQL)
def sink_dlq(spark, sf):
    return log_store.read_dlq(spark, zones.store_root(spark, sf)).withColumn("arrived_at", stamp("arrived_at"))


COUNTERS_SQL = """
SELECT tenant_id, 'logs_total' AS metric, '' AS dim, count(*) AS value FROM accepted GROUP BY ALL
UNION ALL SELECT tenant_id, 'logs_service', service, count(*) FROM accepted GROUP BY ALL
UNION ALL SELECT tenant_id, 'logs_level', lower(level), count(*) FROM accepted GROUP BY ALL
UNION ALL SELECT tenant_id, 'errors_service', service, count(*) FROM accepted WHERE level IN ('ERROR', 'FATAL') GROUP BY ALL
UNION ALL SELECT tenant_id, 'leaderboard_errors', message, count(*) FROM accepted WHERE level IN ('ERROR', 'FATAL') GROUP BY ALL"""


@query("sink_metrics", with_tables(CLASSIFIED, COUNTERS_SQL))
def sink_metrics(spark, sf):
    return log_store.read_counters(spark, zones.store_root(spark, sf))


@query("metric_key", with_tables(CLASSIFIED + f", counters AS ({COUNTERS_SQL})", """
SELECT CASE WHEN tenant_id = 'default' THEN '' ELSE 'tenant:' || tenant_id || ':' END
  || CASE metric WHEN 'logs_total' THEN 'stats:logs:total' WHEN 'logs_service' THEN 'stats:logs:' || dim
       WHEN 'logs_level' THEN 'stats:logs:level:' || lower(dim) WHEN 'errors_service' THEN 'stats:errors:' || dim
       ELSE 'leaderboard:errors' END AS key, CAST(sum(value) AS BIGINT) AS value
FROM counters GROUP BY ALL"""))
def metric_keys(spark, sf):
    rows = log_store.read_counters(spark, zones.store_root(spark, sf))
    key = metric_key(F.col("tenant_id"), F.col("metric"), F.col("dim"))
    return rows.groupBy(key.alias("key")).agg(F.sum("value").alias("value"))


@query("export_ndjson", with_tables(DOCUMENTS, r"""
SELECT line FROM (
  SELECT '{"index":{"_index":"logs-v1-' || strftime(event_date, '%Y.%m.%d') || '","_id":"' || doc_id || '"}}' AS line FROM documents_now
  UNION ALL
  SELECT '{"tenant_id":"' || tenant_id || '","timestamp":"' || "timestamp" || '","level":"' || level || '","service":"' || service
    || '","message":"' || message || '"' || CASE WHEN trace_id IS NULL THEN '' ELSE ',"trace_id":"' || trace_id || '"' END
    || CASE WHEN ip IS NULL THEN '' ELSE ',"ip":"' || ip || '"' END || ',"ingested_at":"'
    || regexp_replace(strftime(ingested_at, '%Y-%m-%dT%H:%M:%S.%f'), '\.?0{1,6}$', '') || 'Z"}' AS line FROM documents_now)"""))
def export_ndjson(spark, sf):
    path = zones.scratch(spark, sf, "export")
    ndjson.export_ndjson(zones.documents(spark, sf), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


# ----------------------------------------------------------- parse, validate


@query("parse_log", with_tables(PARSED, """
SELECT "partition", "offset", parse_error,
  CASE WHEN parse_error IS NULL THEN tenant_id END AS tenant_id,
  CASE WHEN parse_error IS NULL THEN "timestamp" END AS "timestamp",
  CASE WHEN parse_error IS NULL THEN level END AS level,
  CASE WHEN parse_error IS NULL THEN service END AS service,
  CASE WHEN parse_error IS NULL THEN message END AS message,
  CASE WHEN parse_error IS NULL THEN trace_id END AS trace_id,
  CASE WHEN parse_error IS NULL THEN ip END AS ip FROM parse_checked"""))
def parse_log(spark, sf):
    parsed = I.parse_log(zones.raw_zone(spark, sf))
    good = F.col("parse_error").isNull()
    return parsed.select("partition", "offset", "parse_error", *[F.when(good, F.col(c)).alias(c) for c in I.EVENT_FIELDS])


@query("require_fields", with_tables(PARSED, """
SELECT "partition", "offset" FROM parse_checked WHERE readable AND
  ("timestamp" IS NULL OR level IS NULL OR service IS NULL OR message IS NULL)"""))
def require_fields(spark, sf):
    readable = I.parse_log(zones.raw_zone(spark, sf)).where(F.coalesce(F.col("parse_error"), F.lit("")) != I.ERR_JSON)
    return readable.where(~I.has_required_fields()).select("partition", "offset")


# The endpoint reads the first JSON value, so text behind it passes.
_FIRST_VALUE = PARSED + f""",
bodies_read AS (
  SELECT "partition", "offset",
    CASE WHEN value LIKE '% trailing' THEN left(value, length(value) - 9) ELSE value END AS body FROM raw_events
),
first_value AS (
  SELECT "partition", "offset", json_valid(body) AND CASE WHEN json_valid(body)
    THEN json_type(body, '$.level') = 'VARCHAR' ELSE false END AS readable,
    CASE WHEN json_valid(body) THEN body ELSE '{{}}' END AS doc FROM bodies_read
),
fields AS (
  SELECT "partition", "offset", readable,
    coalesce(json_extract_string(doc, '$.timestamp'), '') AS ts, coalesce(json_extract_string(doc, '$.level'), '') AS level,
    coalesce(json_extract_string(doc, '$.service'), '') AS service, coalesce(json_extract_string(doc, '$.message'), '') AS message,
    coalesce(json_extract_string(doc, '$.ip'), '') AS ip, coalesce(json_extract_string(doc, '$.tenant_id'), '') AS tenant_id,
    coalesce(json_extract_string(doc, '$.trace_id'), '') AS trace_id FROM first_value
),
findings AS (
  SELECT "partition", "offset", 'timestamp' AS field,
    CASE WHEN trim(ts) = '' THEN 'timestamp is required' ELSE 'timestamp must be valid RFC3339 format' END AS message
  FROM fields WHERE readable AND NOT regexp_matches(ts, '{RFC3339}')
  UNION ALL SELECT "partition", "offset", 'level', 'must be one of: DEBUG, INFO, WARN, ERROR, FATAL' FROM fields
  WHERE readable AND upper(trim(level)) NOT IN ('DEBUG', 'INFO', 'WARN', 'ERROR', 'FATAL')
  UNION ALL SELECT "partition", "offset", 'service', 'service is required' FROM fields WHERE readable AND trim(service) = ''
  UNION ALL SELECT "partition", "offset", 'message', 'message must be between 1 and 1000 characters' FROM fields
  WHERE readable AND strlen(trim(message)) NOT BETWEEN 1 AND 1000
  UNION ALL SELECT "partition", "offset", 'ip', 'must be a valid IPv4 or IPv6 address' FROM fields
  WHERE readable AND ip <> '' AND NOT regexp_matches(ip, '{V4}')
)"""


@query("validate_log", with_tables(_FIRST_VALUE, 'SELECT "partition", "offset", field, message FROM findings'))
def validate_log(spark, sf):
    verdicts = I.ingest_verdict(zones.raw_zone(spark, sf))
    return verdicts.select("partition", "offset", F.inline("details"))


@query("ingest_verdict", with_tables(_FIRST_VALUE, """
SELECT "partition", "offset", CASE WHEN NOT readable THEN 'MALFORMED_JSON'
  WHEN ("partition", "offset") IN (SELECT ("partition", "offset") FROM findings) THEN 'VALIDATION_ERROR' ELSE 'queued' END AS verdict
FROM fields"""))
def ingest_verdict(spark, sf):
    return I.ingest_verdict(zones.raw_zone(spark, sf)).select("partition", "offset", "verdict")


@query("normalize_level", with_tables(CLASSIFIED, """
SELECT "partition", "offset", level, CASE WHEN upper(trim(level)) IN ('DEBUG', 'INFO', 'WARN', 'ERROR', 'FATAL')
  THEN upper(trim(level)) ELSE level END AS normal FROM accepted"""))
def normalize_level(spark, sf):
    return zones.messages(spark, sf).select("partition", "offset", "level", I.normalize_level(F.col("level")).alias("normal"))


@query("parse_rfc3339", with_tables(PARSED, f"""
SELECT "timestamp", CASE WHEN regexp_matches("timestamp", '{RFC3339}')
  THEN {rfc3339("strptime(\"timestamp\", '%Y-%m-%dT%H:%M:%S.%fZ')")} END AS event_ts
FROM parse_checked WHERE parse_error IS NULL"""))
def parse_rfc3339_(spark, sf):
    parsed = I.parse_log(zones.raw_zone(spark, sf)).where("parse_error IS NULL")
    return parsed.withColumn("event_ts", parse_rfc3339(F.col("timestamp"))).select("timestamp", stamp("event_ts"))


@query("valid_ip", with_tables(PARSED, f"""
SELECT ip, regexp_matches(ip, '{V4}') AS ok, count(*) AS n FROM parse_checked WHERE ip IS NOT NULL AND readable GROUP BY ALL"""))
def valid_ip_(spark, sf):
    parsed = I.parse_log(zones.raw_zone(spark, sf)).where(F.col("ip").isNotNull())
    parsed = parsed.where(F.coalesce(F.col("parse_error"), F.lit("")) != I.ERR_JSON)
    return parsed.groupBy("ip").agg(F.count(F.lit(1)).alias("n")).select("ip", valid_ip(F.col("ip")).alias("ok"), "n")


@query("tenant_default", with_tables(PARSED, """
SELECT "partition", "offset", coalesce(nullif(trim(tenant_id), ''), 'default') AS tenant FROM parse_checked WHERE parse_error IS NULL"""))
def tenant_default(spark, sf):
    parsed = I.parse_log(zones.raw_zone(spark, sf)).where("parse_error IS NULL")
    return parsed.select("partition", "offset", tenant_or_default(F.col("tenant_id")).alias("tenant"))


@query("sink_publish", with_tables(_FIRST_VALUE, """
SELECT coalesce(nullif(trace_id, ''), service) AS key,
  '{' || CASE WHEN tenant_id = '' THEN '' ELSE '"tenant_id":"' || tenant_id || '",' END
  || '"timestamp":"' || ts || '","level":"' || upper(trim(level)) || '","service":"' || service || '","message":"' || message || '"'
  || CASE WHEN trace_id = '' THEN '' ELSE ',"trace_id":"' || trace_id || '"' END
  || CASE WHEN ip = '' THEN '' ELSE ',"ip":"' || ip || '"' END || '}' AS value, 'app-logs' AS topic
FROM fields WHERE readable AND ("partition", "offset") NOT IN (SELECT ("partition", "offset") FROM findings)"""))
def sink_publish(spark, sf):
    path = zones.scratch(spark, sf, "published")
    events = I.ingest_verdict(zones.raw_zone(spark, sf)).where(F.col("verdict") == I.QUEUED)
    I.publish_records(events).write.mode("overwrite").parquet(path)
    return spark.read.schema("key string, value string, topic string").parquet(path)


# ---------------------------------------------------------------- documents


@query("to_document", with_tables(CLASSIFIED, f"""
SELECT tenant_id, "timestamp", level, service, message, trace_id, ip, {rfc3339('ingested_at')} AS ingested_at
FROM classified WHERE parse_error IS NULL"""))
def to_document(spark, sf):
    parsed = I.parse_log(zones.raw_zone(spark, sf)).where("parse_error IS NULL")
    documents = I.to_document(parsed, F.col("arrived_at"))
    return documents.select("tenant_id", "timestamp", "level", "service", "message", "trace_id", "ip", stamp("ingested_at"))


@query("doc_id", with_tables(CLASSIFIED, 'SELECT "partition", "offset", doc_id FROM classified WHERE parse_error IS NULL'))
def doc_id(spark, sf):
    parsed = I.parse_log(zones.raw_zone(spark, sf)).where("parse_error IS NULL")
    return I.to_document(parsed, F.col("arrived_at")).select("partition", "offset", "doc_id")


@query("route_daily", with_tables(CLASSIFIED, """
SELECT "partition", "offset", 'logs-v1-' || strftime(event_date, '%Y.%m.%d') AS index_name FROM classified WHERE parse_error IS NULL"""))
def route_daily(spark, sf):
    parsed = I.parse_log(zones.raw_zone(spark, sf)).where("parse_error IS NULL")
    return I.route_daily(I.to_document(parsed, F.col("arrived_at"))).select("partition", "offset", "index_name")


# Names as a store might list them: good ones, other prefixes, impossible dates.
@query("parse_index_name", """
SELECT name, strftime(CASE WHEN ok THEN try_cast(replace(substr(name, 9, 10), '.', '-') AS DATE) END, '%Y-%m-%d') AS day FROM (
  SELECT name, regexp_matches(name, '^logs-v1-[0-9]{4}\\.[0-9]{2}\\.[0-9]{2}$') AS ok FROM (
    SELECT CASE event_id % 5 WHEN 0 THEN 'logs-v1-' || strftime(ts, '%Y-%m-%d') WHEN 1 THEN 'other-' || strftime(ts, '%Y.%m.%d')
      WHEN 2 THEN 'logs-v1-2024.02.' || (event_id % 60 + 10) ELSE 'logs-v1-' || strftime(ts, '%Y.%m.%d') END AS name FROM events))""")
def parse_index_name_(spark, sf):
    ts, n = F.col("ts").cast("timestamp"), F.col("event_id")
    name = (
        F.when(n % 5 == 0, F.concat(F.lit("logs-v1-"), F.date_format(ts, "yyyy-MM-dd")))
        .when(n % 5 == 1, F.concat(F.lit("other-"), F.date_format(ts, "yyyy.MM.dd")))
        .when(n % 5 == 2, F.concat(F.lit("logs-v1-2024.02."), (n % 60 + 10).cast("string")))
        .otherwise(index_name(F.to_date(ts)))
    )
    return parse_index_name(derive.table(spark, sf, "events").select(name.alias("name"))).select("name", day("day"))


@query("is_error", with_tables(CLASSIFIED, "SELECT level, level IN ('ERROR', 'FATAL') AS error, count(*) AS n FROM accepted GROUP BY ALL"))
def is_error_(spark, sf):
    return zones.messages(spark, sf).groupBy("level", is_error(F.col("level")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


@query("dlq_envelope", with_tables(CLASSIFIED, """
SELECT key, original_message, error, failed_at, processor_id FROM dlq WHERE reason = 'parse_error'"""))
def dlq_envelope(spark, sf):
    rejects = I.classify(zones.raw_zone(spark, sf)).where(F.col("reject_reason") == I.REASON_PARSE)
    return I.dlq_envelope(rejects, processor_id="").drop("topic", "reason", "partition", "offset", "arrived_at")


@query("split_valid_invalid", with_tables(CLASSIFIED, """
SELECT CASE WHEN reject_reason IS NULL THEN 'valid' ELSE 'invalid' END AS side, "partition", "offset", doc_id FROM classified"""))
def split_valid_invalid(spark, sf):
    valid, invalid = I.split_valid_invalid(zones.raw_zone(spark, sf))
    columns = ["partition", "offset", "doc_id"]
    return valid.select(F.lit("valid").alias("side"), *columns).unionByName(invalid.select(F.lit("invalid").alias("side"), *columns))


@query("item_outcomes", with_tables(CLASSIFIED, """
SELECT "partition", "offset", CASE WHEN reject_reason IS NULL THEN 201 ELSE 400 END AS status, error AS item_error
FROM classified WHERE parse_error IS NULL"""))
def item_outcomes(spark, sf):
    parsed = I.parse_log(zones.raw_zone(spark, sf)).where("parse_error IS NULL")
    outcomes = I.item_outcomes(I.to_document(parsed, F.col("arrived_at")))
    return outcomes.select("partition", "offset", "status", "item_error")


# Results an external store reports: some refused with details, some missing.
@query("item_results_joined", with_tables(CLASSIFIED, """
SELECT "offset" AS position, CASE WHEN "offset" % 7 = 0 THEN NULL WHEN "offset" % 5 = 0 THEN 429 ELSE 200 END AS status,
  CASE WHEN "offset" % 7 = 0 THEN 'ES bulk error 400 (item_error): indexing rejected'
       WHEN "offset" % 5 = 0 THEN 'ES bulk error 429 (rejected_execution): queue full' END AS item_error,
  "offset" % 7 <> 0 AND "offset" % 5 <> 0 AS stored
FROM accepted"""))
def item_results_joined(spark, sf):
    documents = zones.messages(spark, sf).select(F.col("offset").alias("position"))
    late = F.col("position") % 5 == 0
    results = documents.select(
        # A result without a position belongs to no document.
        F.when(F.col("position") % 7 != 0, F.col("position")).alias("position"),
        F.when(late, 429).otherwise(200).alias("status"),
        F.when(late, "rejected_execution").alias("type"), F.when(late, "queue full").alias("reason"),
    )
    return I.join_item_results(documents, results)


@query("dlq_union", with_tables(CLASSIFIED, "SELECT original_message, error, topic, reason FROM dlq"))
def dlq_union(spark, sf):
    rows = I.classify(zones.raw_zone(spark, sf))
    parse = I.dlq_envelope(rows.where(F.col("reject_reason") == I.REASON_PARSE))
    item = I.dlq_envelope(rows.where(F.col("reject_reason") == I.REASON_ITEM))
    return I.dlq_union(parse, item).select("original_message", "error", "topic", "reason")


@query("dlq_inspect", with_tables(CLASSIFIED, "SELECT error, count(*) AS messages FROM dlq GROUP BY ALL"))
def dlq_inspect(spark, sf):
    return I.dlq_inspect(log_store.read_dlq(spark, zones.store_root(spark, sf)))


# Trailing text is cut off, which repairs those rejects only.
@query("dlq_replay", with_tables(CLASSIFIED, """
SELECT regexp_replace(original_message, ' trailing$', '') AS value,
  original_message LIKE '% trailing' AND NOT original_message LIKE '%"level":5%' AND original_message LIKE '%"service"%'
  AND NOT original_message LIKE '%"999.1.1.1"%' AND original_message LIKE '%"timestamp":"____-__-__T%' AS accepted FROM dlq"""))
def dlq_replay(spark, sf):
    dlq = log_store.read_dlq(spark, zones.store_root(spark, sf))
    replayed = I.dlq_replay(dlq, F.regexp_replace("original_message", " trailing$", ""))
    return replayed.select("value", F.col("reject_reason").isNull().alias("accepted"))


@query("bulk_result", with_tables(CLASSIFIED, """
SELECT strftime(ingested_at, '%Y-%m-%dT%H') AS batch, count(*) AS total_docs, count(*) FILTER (reject_reason IS NULL) AS success_docs,
  count(*) FILTER (reject_reason IS NOT NULL) AS failed_docs,
  CASE WHEN count(*) FILTER (reject_reason IS NOT NULL) = 0 THEN 'success'
       WHEN count(*) FILTER (reject_reason IS NULL) > 0 THEN 'partial_failure' ELSE 'failure' END AS status
FROM classified WHERE parse_error IS NULL GROUP BY ALL"""))
def bulk_result(spark, sf):
    rows = I.classify(zones.raw_zone(spark, sf))
    return RU.bulk_result(rows, F.date_format("ingested_at", "yyyy-MM-dd'T'HH"))


@query("failures_by_reason", with_tables(CLASSIFIED, "SELECT topic, reason, count(*) AS failures FROM dlq GROUP BY ALL"))
def failures_by_reason(spark, sf):
    return RU.failures_by_reason(log_store.read_dlq(spark, zones.store_root(spark, sf)))


