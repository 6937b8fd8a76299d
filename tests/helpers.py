import datetime as dt
import json

RAW = "key string, value string, topic string, partition int, offset long, timestamp timestamp"
UTC = dt.timezone.utc


def at(text):
    return dt.datetime.fromisoformat(text).replace(tzinfo=UTC)


def event(**fields):
    base = {"timestamp": "2026-08-28T10:00:00Z", "level": "INFO", "service": "svc-1", "message": "ok"}
    base.update(fields)
    return json.dumps({k: v for k, v in base.items() if v is not None}, ensure_ascii=False)


def raw_frame(spark, values, arrived="2026-08-28T10:00:01"):
    rows = []
    for i, value in enumerate(values):
        when = arrived if isinstance(arrived, str) else arrived[i]
        rows.append((f"k{i}", value, "app-logs", 0, i, at(when)))
    return spark.createDataFrame(rows, RAW)


MESSAGE = (
    "tenant_id string, service string, level string, message string, ip string, ingested_at timestamp,"
    " partition int, offset long, payload string"
)


def message_frame(spark, rows):
    """Rows of dicts over the defaults of one accepted message."""
    base = {
        "tenant_id": "default", "service": "svc-1", "level": "ERROR", "message": "boom", "ip": None,
        "ingested_at": at("2026-08-28T10:00:00"), "partition": 0, "offset": 0, "payload": "{}",
    }
    names = list(base)
    data = [tuple({**base, "offset": i, **row}[n] for n in names) for i, row in enumerate(rows)]
    return spark.createDataFrame(data, MESSAGE)


def column(df, name):
    return [r[name] for r in df.select(name).collect()]
