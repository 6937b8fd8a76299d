import hashlib
import ipaddress

import pytest
from pyspark.sql import functions as F

from tidelog.functions.net import valid_ip
from tidelog.functions.text import human_bytes, metric_key, preview, ws_trim
from tidelog.functions.times import index_day, parse_rfc3339
from tidelog.operators import ingest as I
from tidelog.operators import retention as R
from tidelog.sources import ndjson, synthetic

from helpers import at, column, event, raw_frame


def parsed(spark, values):
    return I.parse_log(raw_frame(spark, values)).orderBy("offset").collect()


def test_good_event_is_parsed(spark):
    value = (
        '{"timestamp":"2026-08-06T10:00:00Z","level":"ERROR","service":"payment-api",'
        '"message":"DB connection timeout after 30s","trace_id":"abc-123-def-456","ip":"192.168.1.5"}'
    )
    row = parsed(spark, [value])[0]
    assert row["parse_error"] is None
    assert (row["level"], row["service"], row["trace_id"], row["ip"]) == ("ERROR", "payment-api", "abc-123-def-456", "192.168.1.5")
    assert row["tenant_id"] is None


@pytest.mark.parametrize(
    "value,error",
    [
        ('{"message": "missing timestamp and level"}', I.ERR_REQUIRED),
        ("{invalid-json}", I.ERR_JSON),
        ("", I.ERR_JSON),
        ("   ", I.ERR_JSON),
        ("null", I.ERR_REQUIRED),
        ("[1]", I.ERR_JSON),
        ("12", I.ERR_JSON),
        (event(level=5), I.ERR_JSON),
        (event(ip={"a": 1}), I.ERR_JSON),
        (event(tenant_id=True), I.ERR_JSON),
        (event() + " tail", I.ERR_JSON),
        (event() + "]", I.ERR_JSON),
        (event() + "],[{}", I.ERR_JSON),
        (event() + "}", I.ERR_JSON),
        (event() + event(), I.ERR_JSON),
        (event() + "," + event(), I.ERR_JSON),
        (event().replace('"', "'"), I.ERR_JSON),
        (event(message=""), I.ERR_REQUIRED),
        ('{"timestamp":"x","level":"y","service":null,"message":"z"}', I.ERR_REQUIRED),
        (event() + "  \n", None),
        (event(extra={"deep": [{"x": 1}]}), None),
        (event(message='brackets }] and "quotes"'), None),
        (event(level="not-a-level", timestamp="not-a-time"), None),
        (event(trace_id=""), None),
        (event().replace('"message": "ok"', '"message": "ok", "x": NaN'), I.ERR_JSON),
        (event().replace('"level"', '"Level"').replace('"service"', '"SERVICE"'), None),
        (event(Level=7, level=None), I.ERR_JSON),
        (event(LEVELS="x"), None),
    ],
)
def test_parse_errors(spark, value, error):
    assert parsed(spark, [value])[0]["parse_error"] == error


def test_field_names_match_in_any_case(spark):
    value = '{"Timestamp":"2026-08-28T10:00:00Z","LEVEL" : "INFO","service":"s","message":"the \\"Level\\": x","IP":"1.1.1.1"}'
    row = parsed(spark, [value])[0]
    assert (row["timestamp"], row["level"], row["ip"]) == ("2026-08-28T10:00:00Z", "INFO", "1.1.1.1")
    assert row["message"] == 'the "Level": x'


def details(spark, **fields):
    rows = I.ingest_verdict(raw_frame(spark, [event(**fields)])).collect()[0]
    return rows["verdict"], [d["field"] for d in rows["details"] or []]


def test_all_five_failures_are_reported(spark):
    assert details(spark, timestamp="not-a-timestamp", level="CRITICAL", service="", message="", ip="invalid-ip") == (
        I.VALIDATION_ERROR, ["timestamp", "level", "service", "message", "ip"],
    )


@pytest.mark.parametrize(
    "fields,bad",
    [
        ({"timestamp": "2026-08-06"}, ["timestamp"]),
        ({"timestamp": "2026-08-06T10:00:00"}, ["timestamp"]),
        ({"timestamp": "2026-02-30T10:00:00Z"}, ["timestamp"]),
        ({"timestamp": "2026-08-06T10:00:00.123456789+02:00"}, []),
        ({"level": " warn\t"}, []),
        ({"service": "   "}, ["service"]),
        ({"message": "é" * 500}, []),
        ({"message": "é" * 500 + "x"}, ["message"]),
        ({"message": "  " + "x" * 1000 + "\n"}, []),
        ({"message": "x" * 1001}, ["message"]),
        ({"ip": ""}, []),
        ({"ip": "2001:db8::1"}, []),
        ({"ip": "1.2.3"}, ["ip"]),
    ],
)
def test_validation_edges(spark, fields, bad):
    assert details(spark, **fields) == (I.VALIDATION_ERROR if bad else I.QUEUED, bad)


def test_verdict_reads_only_the_first_value(spark):
    values = [event() + " tail", "{oops", "", "null", event(level=5)]
    rows = I.ingest_verdict(raw_frame(spark, values)).orderBy("offset")
    assert column(rows, "verdict") == [I.QUEUED, I.MALFORMED_JSON, I.MALFORMED_JSON, I.VALIDATION_ERROR, I.MALFORMED_JSON]


def test_level_is_normalised_only_when_known(spark):
    rows = spark.createDataFrame([(" warn\n",), ("Critical",), ("INFO",)], "level string")
    assert [r[0] for r in rows.select(I.normalize_level(F.col("level"))).collect()] == ["WARN", "Critical", "INFO"]


def test_document_id(spark):
    fields = dict(
        tenant_id="tenant-a", service="order-svc", level="INFO", timestamp="2026-08-28T10:00:00Z",
        trace_id="trace-xyz", message="Order #123 created",
    )
    values = [event(**fields), event(**fields, ip="1.1.1.1"), event(**{**fields, "tenant_id": "tenant-b"})]
    ids = column(I.accepted(raw_frame(spark, values)).orderBy("offset"), "doc_id")
    text = "tenant-a|order-svc|INFO|2026-08-28T10:00:00Z|trace-xyz|Order #123 created"
    assert ids[0] == hashlib.sha256(text.encode()).hexdigest()[:32] == "7705fb52cb3161407a85b03b93e08335"
    assert ids[1] == ids[0] and ids[2] != ids[0]


def test_absent_fields_count_as_empty_in_the_id(spark):
    row = I.accepted(raw_frame(spark, [event()])).collect()[0]
    text = "default|svc-1|INFO|2026-08-28T10:00:00Z||ok"
    assert row["doc_id"] == hashlib.sha256(text.encode()).hexdigest()[:32]
    assert row["tenant_id"] == "default"


def test_two_days_go_to_two_indices(spark):
    values = [event(), event(timestamp="2026-08-29T12:00:00Z"), event(timestamp="2026-08-29T01:00:00+02:00"), event(timestamp="soon")]
    rows = I.route_daily(I.to_document(I.parse_log(raw_frame(spark, values)), F.col("arrived_at"))).orderBy("offset")
    assert column(rows, "index_name") == ["logs-v1-2026.08.28", "logs-v1-2026.08.29", "logs-v1-2026.08.28", "logs-v1-2026.08.28"]


def test_rejects_do_not_block_the_batch(spark):
    raw = raw_frame(spark, [event(), event(ip="999.1.1.1"), "{malformed-json-payload}"])
    accepted, rejects = I.split_valid_invalid(raw)
    assert accepted.count() == 1
    dlq = I.dlq_envelope(rejects, "2026-08-28T11:00:00.5Z", "").orderBy("reason").collect()
    assert [r["reason"] for r in dlq] == ["es_item_error", "parse_error"]
    assert dlq[0]["error"].startswith("ES bulk error 400 (")
    assert {(r["failed_at"], r["processor_id"]) for r in dlq} == {("2026-08-28T11:00:00Z", "processor-1")}


def test_reported_item_results(spark):
    docs = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "position int, doc_id string")
    results = spark.createDataFrame(
        [(0, 201, None, None), (1, 429, "busy", "queue full")], "position int, status int, type string, reason string"
    )
    rows = I.join_item_results(docs, results).orderBy("position").collect()
    assert [r["stored"] for r in rows] == [True, False, False]
    assert rows[1]["item_error"] == "ES bulk error 429 (busy): queue full"
    assert rows[2]["item_error"] == "ES bulk error 400 (item_error): indexing rejected"


def test_replay_after_a_fix(spark):
    _, rejects = I.split_valid_invalid(raw_frame(spark, [event() + " tail", "{bad"]))
    again = I.dlq_replay(I.dlq_envelope(rejects), F.regexp_replace("original_message", " tail$", ""))
    assert again.where("reject_reason IS NULL").count() == 1


def test_replay_keeps_the_envelope(spark):
    raw = raw_frame(spark, [event() + " tail", event(message="b") + " tail"], ["2026-08-28T10:00:01.5", "2026-08-28T10:00:02.25"])
    _, rejects = I.split_valid_invalid(raw)
    again = I.dlq_replay(I.dlq_envelope(rejects), F.regexp_replace("original_message", " tail$", "")).orderBy("offset").collect()
    was = raw.orderBy("offset").collect()
    assert [(r["partition"], r["offset"], r["ingested_at"]) for r in again] == [(r["partition"], r["offset"], r["timestamp"]) for r in was]


def test_published_records(spark):
    rows = I.parse_log(raw_frame(spark, [event(trace_id="t-1", ip="1.1.1.1"), event()])).orderBy("offset")
    records = I.publish_records(rows).collect()
    assert [r["key"] for r in records] == ["t-1", "svc-1"]
    assert records[1]["value"] == '{"timestamp":"2026-08-28T10:00:00Z","level":"INFO","service":"svc-1","message":"ok"}'


def test_bulk_export_leaves_out_blanks(spark):
    docs = I.accepted(raw_frame(spark, [event()]))
    lines = ndjson.bulk_lines(docs).orderBy("line_no")
    action, body = column(lines, "line")
    assert action.startswith('{"index":{"_index":"logs-v1-2026.08.28","_id":"')
    assert "trace_id" not in body and '"ingested_at":"2026-08-28T10:00:01Z"' in body


IPS = [
    "1.2.3.4", "255.255.255.255", "999.1.1.1", "01.2.3.4", "1.2.3", "1.2.3.4.5", "::", "::1", "1::", "2001:db8::1",
    "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7::8", "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4",
    "1::2::3", "1:2:3:4:5:6:7", "12345::", ":1", "1:", "1:2:3:4:5::1.2.3.4", "::1.2.3.256", "g::", "", " 1.2.3.4",
]


def test_ip_forms_agree_with_the_standard_library(spark):
    def known(text):
        try:
            ipaddress.ip_address(text)
        except ValueError:
            return False
        return True

    rows = spark.createDataFrame([(i, ip) for i, ip in enumerate(IPS)], "i int, ip string")
    got = rows.orderBy("i").select(valid_ip(F.col("ip"))).collect()
    assert [r[0] for r in got] == [known(ip) for ip in IPS]


def test_zone_addresses_are_refused(spark):
    assert not spark.range(1).select(valid_ip(F.lit("fe80::1%eth0"))).first()[0]


def test_rfc3339(spark):
    texts = ["2026-08-06T10:00:00.123456789Z", "2026-08-06T12:00:00+02:00", "2026-08-06", "2026-08-06T10:00:00", "2026-08-06 10:00:00Z", ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    got = [r[0] for r in rows.select(F.unix_micros(parse_rfc3339(F.col("t")))).collect()]
    base = int(at("2026-08-06T10:00:00").timestamp()) * 1_000_000
    assert got == [base + 123456, base, None, None, None, None]


@pytest.mark.parametrize(
    "name,day",
    [
        ("logs-v1-2026.08.28", "2026-08-28"), ("logs-v1-2025.01.15", "2025-01-15"), ("other-index-2026.08.28", None),
        ("logs-v1-2026-08-28", None), ("logs-v1-*", None), (".kibana_8.11.4_001", None), ("logs-v1-2026.02.30", None),
        ("logs-v1-2026.08.28x", None),
    ],
)
def test_index_names(spark, name, day):
    row = spark.range(1).select(index_day(F.lit(name)).cast("string")).first()
    assert row[0] == day
    frame = R.parse_index_name(spark.createDataFrame([(name,)], "name string"))
    assert (frame.first()["day"] is None) == (day is None)


def test_small_text_functions(spark):
    one = spark.range(1)
    assert one.select(ws_trim(F.lit("\t  x y \n "))).first()[0] == "x y"
    sizes = {0: "0 B", 1023: "1023 B", 1024: "1.0 KB", 1280: "1.2 KB", 1536: "1.5 KB", 123456789: "117.7 MB"}
    for n, text in sizes.items():
        assert one.select(human_bytes(F.lit(n).cast("long"))).first()[0] == text
    cuts = {"a" * 60: "a" * 60, "a" * 61: "a" * 57 + "...", "é" * 31: "é" * 28 + "...", "日" * 30: "日" * 19 + "..."}
    for text, short in cuts.items():
        assert one.select(preview(F.lit(text))).first()[0] == short


@pytest.mark.parametrize(
    "tenant,metric,dim,key",
    [
        ("default", "logs_total", "", "stats:logs:total"),
        ("tenant-a", "logs_total", "", "tenant:tenant-a:stats:logs:total"),
        ("", "logs_service", "api", "stats:logs:api"),
        ("tenant-a", "logs_level", "INFO", "tenant:tenant-a:stats:logs:level:info"),
        ("default", "errors_last_5m", "api", "stats:errors:last_5m:api"),
        ("default", "recent_errors", "api", "recent:errors:api"),
        ("default", "unique_ips", "2026-08-28", "unique:ips:2026-08-28"),
        ("tenant-a", "leaderboard_errors", "x", "tenant:tenant-a:leaderboard:errors"),
    ],
)
def test_metric_keys(spark, tenant, metric, dim, key):
    assert spark.range(1).select(metric_key(F.lit(tenant), F.lit(metric), F.lit(dim))).first()[0] == key


def test_synthetic_logs(spark):
    cfg = synthetic.SyntheticConfig(services=("a", "b"), seed=7)
    make = lambda c, n=4000: synthetic.synthetic_range(spark, n, "2026-08-28T10:00:00Z", 1000, c)
    logs = make(cfg)
    assert logs.collect() == make(cfg).repartition(3).orderBy("id").collect()
    shares = {r["level"]: r["count"] / 4000 for r in logs.groupBy("level").count().collect()}
    assert abs(shares["INFO"] - 0.70) < 0.04 and abs(shares["DEBUG"] - 0.15) < 0.03 and abs(shares["WARN"] - 0.10) < 0.03
    assert logs.where(~valid_ip(F.col("ip")) | F.col("message").contains("%d") | F.col("message").contains("%%")).count() == 0
    errors = make(synthetic.SyntheticConfig(error_rate=1.0))
    assert set(column(errors, "level")) == {"ERROR", "FATAL"}
    assert set(column(make(synthetic.SyntheticConfig(error_rate=0.0)), "level")) == {"INFO"}
    plain = make(synthetic.SyntheticConfig(level="WARN", include_ip=False, include_trace_id=False), 10)
    assert {(r["level"], r["trace_id"], r["ip"]) for r in plain.collect()} == {("WARN", None, None)}


def test_generated_logs_pass_their_own_validation(spark):
    logs = synthetic.synthetic_range(spark, 200, "2026-08-28T10:00:00Z", 50, synthetic.SyntheticConfig())
    checked = I.validate_log(logs.withColumn("tenant_id", F.lit(None).cast("string")))
    assert checked.where(F.size("details") > 0).count() == 0
