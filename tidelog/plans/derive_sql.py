"""The derived tables of ``derive`` as DuckDB common table expressions."""

LOG_ROWS = """
ev AS (
  SELECT event_id, ts, user_id, event_type,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         unnest(CASE WHEN event_id % 89 = 0 THEN [0, 1] ELSE [0] END) AS copy
  FROM events
),
log_rows AS (
  SELECT event_id, copy, ts,
    CASE user_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'tenant-a' ELSE 'tenant-b' END AS tenant_id,
    CASE WHEN event_id % 113 = 0 THEN strftime(ts, '%Y-%m-%d')
         ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') END AS "timestamp",
    CASE WHEN event_id % 127 = 0 THEN ' Warn '
         WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'FATAL'
         WHEN event_type = 'error' THEN 'ERROR'
         WHEN event_type = 'view' THEN 'DEBUG'
         WHEN event_type = 'signup' THEN 'WARN'
         ELSE 'INFO' END AS level,
    'svc-' || (user_id % 7) AS service,
    CASE WHEN event_id % 131 = 0 THEN repeat('é', 501)
         WHEN event_type = 'error' THEN 'DB connection timeout after ' || k || 's'
         WHEN event_type = 'view' THEN 'Cache miss for key ' || k
         WHEN event_type = 'signup' THEN 'Slow signup for account ' || k
         WHEN event_type = 'purchase' THEN 'Payment processed for order ' || k
         WHEN event_type = 'click' THEN 'Request completed in ' || k || 'ms' END AS message,
    CASE WHEN event_id % 11 = 0 THEN '' ELSE 'trace-' || user_id END AS trace_id,
    CASE WHEN event_id % 13 = 0 THEN ''
         WHEN event_id % 103 = 0 THEN '999.1.1.1'
         WHEN copy = 1 THEN '10.0.0.' || (k % 254 + 1)
         ELSE '192.168.' || (user_id % 256) || '.' || (k % 254 + 1) END AS ip,
    ts + (copy + 1) * INTERVAL 1 SECOND AS arrived
  FROM ev
)"""

RAW_EVENTS = (
    LOG_ROWS
    + """,
bodies AS (
  SELECT *, '{"tenant_id":"' || tenant_id || '","timestamp":"' || "timestamp" || '",'
    || CASE WHEN event_id % 109 = 0 THEN '"level":5' ELSE '"level":"' || level || '"' END || ','
    || CASE WHEN event_id % 101 = 0 THEN '' ELSE '"service":"' || service || '",' END
    || '"message":"' || message || '","trace_id":"' || trace_id || '","ip":"' || ip || '"}' AS body
  FROM log_rows
),
raw_events AS (
  SELECT coalesce(nullif(trace_id, ''), service) AS key,
    CASE WHEN event_id % 97 = 0 THEN '{malformed'
         WHEN event_id % 107 = 0 THEN body || ' trailing' ELSE body END AS value,
    'app-logs' AS topic, CAST(event_id % 3 AS INTEGER) AS "partition",
    event_id * 2 + copy AS "offset", arrived AS "timestamp"
  FROM bodies
)"""
)

# Decoding: whole-text JSON check, type check, required fields.
PARSED = (
    RAW_EVENTS
    + """,
decoded AS (
  SELECT key, value, topic, "partition", "offset", "timestamp" AS arrived_at,
    json_valid(value) AND CASE WHEN json_valid(value) THEN json_type(value) = 'OBJECT'
      AND coalesce(json_type(value, '$.level'), 'VARCHAR') = 'VARCHAR' ELSE false END AS readable,
    CASE WHEN json_valid(value) THEN value END AS doc
  FROM raw_events
),
parsed AS (
  SELECT key, value, topic, "partition", "offset", arrived_at, readable,
    nullif(json_extract_string(doc, '$.tenant_id'), '') AS tenant_id,
    nullif(json_extract_string(doc, '$.timestamp'), '') AS "timestamp",
    nullif(json_extract_string(doc, '$.level'), '') AS level,
    nullif(json_extract_string(doc, '$.service'), '') AS service,
    nullif(json_extract_string(doc, '$.message'), '') AS message,
    nullif(json_extract_string(doc, '$.trace_id'), '') AS trace_id,
    nullif(json_extract_string(doc, '$.ip'), '') AS ip
  FROM decoded
),
parse_checked AS (
  SELECT *, CASE WHEN NOT readable THEN 'failed to unmarshal log message'
    WHEN "timestamp" IS NULL OR level IS NULL OR service IS NULL OR message IS NULL
    THEN 'log message missing required fields' END AS parse_error
  FROM parsed
)"""
)

V4 = r"^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"
RFC3339 = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{6}Z$"

CLASSIFIED = (
    PARSED
    + f""",
stamped AS (
  SELECT key, value, topic, "partition", "offset", parse_error,
    coalesce(nullif(trim(tenant_id), ''), 'default') AS tenant_id,
    "timestamp", level, service, message, trace_id, ip, arrived_at AS ingested_at,
    CASE WHEN regexp_matches("timestamp", '{RFC3339}')
         THEN strptime("timestamp", '%Y-%m-%dT%H:%M:%S.%fZ') END AS event_ts
  FROM parse_checked
),
classified AS (
  SELECT *,
    substr(sha256(tenant_id || '|' || coalesce(service, '') || '|' || coalesce(level, '') || '|'
      || coalesce("timestamp", '') || '|' || coalesce(trace_id, '') || '|' || coalesce(message, '')), 1, 32) AS doc_id,
    CAST(coalesce(event_ts, ingested_at) AS DATE) AS event_date,
    CASE WHEN parse_error IS NOT NULL THEN 'parse_error'
         WHEN event_ts IS NULL OR (ip IS NOT NULL AND NOT regexp_matches(ip, '{V4}'))
         THEN 'es_item_error' END AS reject_reason,
    CASE WHEN parse_error IS NOT NULL THEN parse_error
         WHEN event_ts IS NULL THEN 'ES bulk error 400 (document_parsing_exception): failed to parse field [timestamp]'
         WHEN ip IS NOT NULL AND NOT regexp_matches(ip, '{V4}')
         THEN 'ES bulk error 400 (document_parsing_exception): failed to parse field [ip]' END AS error
  FROM stamped
),
accepted AS (SELECT * FROM classified WHERE reject_reason IS NULL),
dlq AS (
  SELECT key, value AS original_message, error, strftime(ingested_at, '%Y-%m-%dT%H:%M:%SZ') AS failed_at,
    'processor-1' AS processor_id, topic, reject_reason AS reason, "partition", "offset", ingested_at AS arrived_at
  FROM classified WHERE reject_reason IS NOT NULL
)"""
)

# The store: the last arrival of each document id.
DOCUMENTS = (
    CLASSIFIED
    + """,
documents_now AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ingested_at DESC, "partition" DESC, "offset" DESC) AS rn
    FROM accepted)
  WHERE rn = 1
),
clock AS (SELECT max("timestamp") AS as_of FROM raw_events)"""
)


def with_tables(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body.strip()}"


def rfc3339(col: str) -> str:
    """A timestamp column as text, the way both sides print it."""
    return f"strftime({col}, '%Y-%m-%dT%H:%M:%S.%fZ')"
