"""From raw stream records to accepted documents and rejects.

Everything is a narrow projection: no operator here shuffles.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import jsonio
from tidelog.functions.net import valid_ip
from tidelog.functions.text import empty_to_null, is_error, tenant_or_default, ws_trim
from tidelog.functions.times import as_timestamp, format_rfc3339_seconds, index_name, parse_rfc3339, utc_day
from tidelog.schemas import EVENT_FIELDS, REQUIRED_FIELDS

# Texts and codes a caller sees (fixed values).
LEVELS = ["DEBUG", "INFO", "WARN", "ERROR", "FATAL"]
MIN_MESSAGE_BYTES = 1
MAX_MESSAGE_BYTES = 1000
MSG_TIMESTAMP_MISSING = "timestamp is required"
MSG_TIMESTAMP_FORMAT = "timestamp must be valid RFC3339 format"
MSG_LEVEL = "must be one of: DEBUG, INFO, WARN, ERROR, FATAL"
MSG_SERVICE = "service is required"
MSG_MESSAGE = "message must be between 1 and 1000 characters"
MSG_IP = "must be a valid IPv4 or IPv6 address"
MALFORMED_JSON = "MALFORMED_JSON"
VALIDATION_ERROR = "VALIDATION_ERROR"
QUEUED = "queued"
ERR_JSON = "failed to unmarshal log message"
ERR_REQUIRED = "log message missing required fields"
DEFAULT_PROCESSOR = "processor-1"
REASON_PARSE = "parse_error"
REASON_ITEM = "es_item_error"
ITEM_ERROR_FORMAT = "ES bulk error %d (%s): %s"
DEFAULT_ITEM_STATUS = 400
DEFAULT_ITEM_TYPE = "item_error"
DEFAULT_ITEM_REASON = "indexing rejected"
TOPIC = "app-logs"
DLQ_TOPIC = "app-logs-dlq"

_MAPPING_ERROR = "document_parsing_exception"


# --------------------------------------------------------------- parsing


def parse_log(raw: DataFrame, value: str = "value") -> DataFrame:
    """Decode ``value`` into the seven event columns and ``parse_error``.

    ``parse_error`` is NULL for a good event.  Optional fields that are absent
    or empty become NULL.  The envelope's own ``timestamp`` is the arrival time
    and is renamed to ``arrived_at``.
    """
    envelope = [c for c in raw.columns if c not in EVENT_FIELDS or c == "timestamp"]
    kept = [F.col(c).alias("arrived_at") if c == "timestamp" else F.col(c) for c in envelope]
    decoded = jsonio.decode_whole(raw.select(*kept), value)
    broken = F.col("_at").isNull() | F.col("_wrong")
    texts = [empty_to_null(F.col("_event")[f]).alias(f) for f in EVENT_FIELDS]
    names = [c for c in decoded.columns if c not in ("_at", "_event", "_wrong")]
    fields = decoded.select(*names, broken.alias("_broken"), *texts)
    error = F.when(F.col("_broken"), ERR_JSON).when(~has_required_fields(), ERR_REQUIRED)
    return fields.withColumn("parse_error", error).drop("_broken")


def has_required_fields() -> Column:
    """Timestamp, level, service and message are all there and not empty."""
    ok = F.lit(True)
    for name in REQUIRED_FIELDS:
        ok = ok & (F.coalesce(F.col(name), F.lit("")) != "")
    return ok


def require_fields(events: DataFrame) -> DataFrame:
    return events.where(has_required_fields())


# ------------------------------------------------------------ validation


def normalize_level(level: Column) -> Column:
    """Trimmed upper-case level when that is a known one, else unchanged."""
    upper = F.upper(ws_trim(level))
    return F.when(upper.isin(LEVELS), upper).otherwise(level)


def validation_details() -> Column:
    """Array of ``{field, message}`` with every failure of one event."""

    def finding(condition: Column, field: str, message: str) -> Column:
        return F.when(condition, F.struct(F.lit(field).alias("field"), F.lit(message).alias("message")))

    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    no_time = ws_trim(text("timestamp")) == ""
    size = F.octet_length(ws_trim(text("message")))
    return F.array_compact(
        F.array(
            finding(no_time, "timestamp", MSG_TIMESTAMP_MISSING),
            finding(~no_time & parse_rfc3339(F.col("timestamp")).isNull(), "timestamp", MSG_TIMESTAMP_FORMAT),
            finding(~F.upper(ws_trim(text("level"))).isin(LEVELS), "level", MSG_LEVEL),
            finding(ws_trim(text("service")) == "", "service", MSG_SERVICE),
            finding(~size.between(MIN_MESSAGE_BYTES, MAX_MESSAGE_BYTES), "message", MSG_MESSAGE),
            finding((text("ip") != "") & ~valid_ip(text("ip")), "ip", MSG_IP),
        )
    )


def validate_log(events: DataFrame) -> DataFrame:
    """Add ``details`` (all failures) and the normalised ``level``."""
    return events.withColumn("details", validation_details()).withColumn("level", normalize_level(F.col("level")))


def ingest_verdict(raw: DataFrame, value: str = "value") -> DataFrame:
    """What the ingest endpoint answers for each body.

    Only the first JSON value counts, so text behind it is ignored here
    (``parse_log`` rejects it later).  A bare ``null`` is an empty event.
    """
    rest = [c for c in raw.columns if c not in EVENT_FIELDS]
    decoded = jsonio.decode_first(raw.select(*rest), value)
    bare_null = F.coalesce(F.col(value), F.lit("")).rlike(r"^\s*null(\s|$)")
    malformed = (jsonio.is_unreadable(F.col("_event")) & ~bare_null) | F.col("_wrong")
    texts = [F.coalesce(F.col("_event")[f], F.lit("")).alias(f) for f in EVENT_FIELDS]
    checked = validate_log(decoded.select(*rest, malformed.alias("_malformed"), *texts))
    verdict = (
        F.when(F.col("_malformed"), MALFORMED_JSON)
        .when(F.size("details") > 0, VALIDATION_ERROR)
        .otherwise(QUEUED)
    )
    details = F.when(verdict == VALIDATION_ERROR, F.col("details"))
    return checked.withColumn("verdict", verdict).withColumn("details", details).drop("_malformed")


# ------------------------------------------------------------- documents


def doc_id() -> Column:
    """Deterministic id; ``ip`` and the arrival time are not part of it."""
    parts = ["tenant_id", "service", "level", "timestamp", "trace_id", "message"]
    text = F.concat_ws("|", *[F.coalesce(F.col(p), F.lit("")) for p in parts])
    return F.substring(F.sha2(text, 256), 1, 32)


def to_document(events: DataFrame, ingested_at: Column | str | dt.datetime) -> DataFrame:
    """Stamp tenant, arrival, event time, id and day on parsed events."""
    stamped = (
        events.withColumn("tenant_id", tenant_or_default(F.col("tenant_id")))
        .withColumn("ingested_at", as_timestamp(ingested_at))
        .withColumn("event_ts", parse_rfc3339(F.col("timestamp")))
    )
    return stamped.withColumn("doc_id", doc_id()).withColumn(
        "event_date", utc_day(F.col("event_ts"), F.col("ingested_at"))
    )


def route_daily(documents: DataFrame) -> DataFrame:
    return documents.withColumn("index_name", index_name(F.col("event_date")))


def store_check() -> Column:
    """The field the strict store mapping refuses, or NULL."""
    bad_ip = F.col("ip").isNotNull() & ~valid_ip(F.col("ip"))
    return F.when(F.col("event_ts").isNull(), "timestamp").when(bad_ip, "ip")


def item_error_text(status: Column, kind: Column, reason: Column) -> Column:
    """Error text of one refused document; missing parts get the defaults."""
    return F.format_string(
        ITEM_ERROR_FORMAT,
        F.coalesce(status, F.lit(DEFAULT_ITEM_STATUS)),
        F.coalesce(kind, F.lit(DEFAULT_ITEM_TYPE)),
        F.coalesce(reason, F.lit(DEFAULT_ITEM_REASON)),
    )


def item_outcomes(documents: DataFrame) -> DataFrame:
    """Add ``status`` (201 or 400) and ``item_error`` of storing each document."""
    refused = store_check()
    reason = F.concat(F.lit("failed to parse field ["), refused, F.lit("]"))
    return documents.withColumn("status", F.when(refused.isNull(), 201).otherwise(400)).withColumn(
        "item_error",
        F.when(refused.isNotNull(), item_error_text(F.lit(400), F.lit(_MAPPING_ERROR), reason)),
    )


def join_item_results(documents: DataFrame, results: DataFrame, position: str = "position") -> DataFrame:
    """Outcomes reported by an external store, matched on the row position.

    A document is stored when its result has a 2xx status; a position without
    a result is refused with the default text.
    """
    joined = documents.join(results.select(position, "status", "type", "reason"), position, "left")
    stored = F.coalesce(F.col("status").between(200, 299), F.lit(False))
    error = item_error_text(F.col("status"), F.col("type"), F.col("reason"))
    return joined.withColumn("stored", stored).withColumn("item_error", F.when(~stored, error)).drop("type", "reason")


def classify(raw: DataFrame, ingested_at: Column | str | dt.datetime | None = None) -> DataFrame:
    """One pass over raw records: parse, stamp, store check.

    ``reject_reason`` is NULL for accepted rows, else ``parse_error`` or
    ``es_item_error``, with the text in ``error``.
    """
    documents = to_document(parse_log(raw), F.col("arrived_at") if ingested_at is None else ingested_at)
    checked = item_outcomes(documents)
    parsed = F.col("parse_error").isNull()
    return (
        checked.withColumn(
            "reject_reason",
            F.when(~parsed, REASON_PARSE).when(F.col("item_error").isNotNull(), REASON_ITEM),
        )
        .withColumn("error", F.coalesce("parse_error", "item_error"))
        .drop("parse_error", "item_error", "status")
    )


def split_valid_invalid(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted documents, rejects); both read the same classified frame."""
    rows = classify(raw)
    return rows.where(F.col("reject_reason").isNull()), rows.where(F.col("reject_reason").isNotNull())


def accepted(raw: DataFrame) -> DataFrame:
    return split_valid_invalid(raw)[0].drop("reject_reason", "error")


# ------------------------------------------------------------------- DLQ


def dlq_envelope(
    rejects: DataFrame,
    failed_at: Column | str | dt.datetime | None = None,
    processor_id: str | None = None,
) -> DataFrame:
    """Reject rows in dead-letter form; key, place in the stream and arrival are kept for a replay."""
    moment = F.col("ingested_at") if failed_at is None else as_timestamp(failed_at)
    return rejects.select(
        "key",
        F.col("value").alias("original_message"),
        "error",
        format_rfc3339_seconds(moment).alias("failed_at"),
        F.lit(processor_id or DEFAULT_PROCESSOR).alias("processor_id"),
        F.col("topic"),
        F.col("reject_reason").alias("reason"),
        "partition",
        "offset",
        F.col("ingested_at").alias("arrived_at"),
    )


def dlq_union(parse_rejects: DataFrame, item_rejects: DataFrame) -> DataFrame:
    return parse_rejects.unionByName(item_rejects)


def dlq_inspect(dlq: DataFrame) -> DataFrame:
    """Rejects per error text, most frequent first."""
    return dlq.groupBy("error").agg(F.count(F.lit(1)).alias("messages")).orderBy(F.desc("messages"), "error")


def dlq_replay(dlq: DataFrame, repair: Column | None = None) -> DataFrame:
    """Feed originals back through ``classify``, optionally repaired first.

    They keep their partition, offset and arrival, so what is last and what is
    recent comes out as if they had been accepted at once.
    """
    original = F.col("original_message") if repair is None else repair
    raw = dlq.select(
        "key",
        original.alias("value"),
        F.lit(TOPIC).alias("topic"),
        "partition",
        "offset",
        F.col("arrived_at").alias("timestamp"),
    )
    return classify(raw)


# --------------------------------------------------------------- publish


def publish_records(events: DataFrame, topic: str = TOPIC) -> DataFrame:
    """Stream records of validated events, keyed by trace or else service."""
    fields = [
        jsonio.blank_out(f) if f not in REQUIRED_FIELDS else F.coalesce(F.col(f), F.lit("")).alias(f)
        for f in EVENT_FIELDS
    ]
    return events.select(
        F.coalesce(empty_to_null(F.col("trace_id")), F.col("service")).alias("key"),
        jsonio.encode(*fields).alias("value"),
        F.lit(topic).alias("topic"),
    )


def error_documents(documents: DataFrame) -> DataFrame:
    return documents.where(is_error(F.col("level")))
