import datetime as dt
import os
import random

from pyspark.sql import functions as F

from tidelog.operators import ingest
from tidelog.operators import windows as WI
from tidelog.sources import log_store, raw_events, synthetic
from tidelog.streaming import ingest_stream as ST

from helpers import at, column, event, raw_frame


def lay(spark, path, batches):
    """One file per batch of values, oldest first."""
    for i, (values, arrived) in enumerate(batches):
        raw = raw_frame(spark, values, arrived).withColumn("offset", F.col("offset") + 100 * i)
        raw.coalesce(1).write.mode("append").parquet(path)


VALUES = [
    event(tenant_id="a", service="svc-1", ip="1.1.1.1"),
    event(tenant_id="b", service="svc-2", level="ERROR", message="boom", ip="1.1.1.1"),
    event(service="svc-2", level="FATAL", message="boom"),
    event(ip="999.1.1.1"),
    "{malformed-json-payload}",
    event(timestamp="2020-01-01T00:00:00Z"),
]


def tables(spark, root):
    docs = log_store.read_documents(spark, root).drop("event_ts")
    return {
        "docs": sorted(map(str, docs.collect())),
        "counters": sorted(map(str, log_store.read_counters(spark, root).collect())),
        "ips": sorted(map(str, log_store.read_ip_members(spark, root).collect())),
        "ticks": sorted(map(str, log_store.read_ticks(spark, root).collect())),
        "recent": sorted(map(str, log_store.read_recent(spark, root).collect())),
        "dlq": sorted(map(str, log_store.read_dlq(spark, root).collect())),
    }


def drained(spark, path, root, files=1):
    raw = raw_events.stream_raw_files(spark, path, max_files_per_trigger=files)
    return ST.drain(ST.start_ingest(raw, root, root + "-checkpoint", flush_interval=None))


def test_stream_and_batch_agree(spark, tmp_path):
    path = str(tmp_path / "raw")
    lay(spark, path, [(VALUES[:2], "2026-08-28T10:00:01"), (VALUES[2:5], "2026-08-28T10:00:05"), (VALUES[5:] + VALUES[:2], "2026-08-28T11:00:00")])
    streamed, rebuilt = str(tmp_path / "streamed"), str(tmp_path / "rebuilt")
    drained(spark, path, streamed)
    assert log_store.read_messages(spark, streamed).select("batch_id").distinct().count() == 3
    ST.rebuild_views(raw_events.read_raw_files(spark, path), rebuilt, rebuilt + "-staging")
    assert tables(spark, streamed) == tables(spark, rebuilt)


def test_mixed_batch(spark, root):
    log_store.process_batch(raw_frame(spark, VALUES), root, 0)
    assert log_store.read_documents(spark, root).count() == 4
    assert log_store.read_dlq(spark, root).count() == 2
    total = log_store.read_counters(spark, root).where("metric = 'logs_total'").agg(F.sum("value")).first()[0]
    assert total + log_store.read_dlq(spark, root).count() == len(VALUES)


def test_the_same_batch_twice_changes_nothing(spark, root):
    raw = raw_frame(spark, VALUES)
    log_store.process_batch(raw, root, 3)
    once = tables(spark, root)
    log_store.process_batch(raw, root, 3, staging=root + "-staging")
    assert tables(spark, root) == once


def test_events_sent_again_count_twice_but_are_stored_once(spark, root):
    raw = raw_frame(spark, VALUES)
    log_store.process_batch(raw, root, 0)
    once = log_store.read_documents(spark, root).count()
    log_store.process_batch(raw, root, 1)
    assert log_store.read_documents(spark, root).count() == once
    values = {r["value"] for r in log_store.read_counters(spark, root).where("metric = 'errors_service'").collect()}
    assert values == {2}


def test_a_batch_without_good_events(spark, root):
    log_store.process_batch(raw_frame(spark, VALUES[:1]), root, 0)
    log_store.process_batch(raw_frame(spark, ["{bad"]), root, 1)
    assert log_store.read_documents(spark, root).count() == 1
    assert log_store.read_dlq(spark, root).count() == 1


def test_old_events_go_to_their_own_day(spark, root):
    log_store.process_batch(raw_frame(spark, VALUES), root, 0)
    days = {str(d) for d in column(log_store.read_messages(spark, root), "event_date")}
    assert days == {"2020-01-01", "2026-08-28"}


def test_restart_goes_on_behind_the_last_batch(spark, tmp_path):
    path, root = str(tmp_path / "raw"), str(tmp_path / "out")
    lay(spark, path, [(VALUES, "2026-08-28T10:00:01")])
    drained(spark, path, root)
    lay(spark, path, [([event(message="later")], "2026-08-28T10:10:00")])
    drained(spark, path, root)
    total = log_store.read_counters(spark, root).where("metric = 'logs_total'").agg(F.sum("value")).first()[0]
    assert total == 5


def test_interval_trigger(spark, tmp_path):
    path, root = str(tmp_path / "raw"), str(tmp_path / "out")
    lay(spark, path, [(VALUES, "2026-08-28T10:00:01")])
    query = ST.start_ingest(raw_events.stream_raw_files(spark, path), root, root + "-checkpoint")
    try:
        query.processAllAvailable()
        assert ST.stream_lag(query)
    finally:
        query.stop()
    assert log_store.read_documents(spark, root).count() == 4


def test_idle_counter_from_streamed_parts(spark, root):
    for i, second in enumerate((0, 200, 501, 600)):
        when = (at("2026-08-28T10:00:00") + dt.timedelta(seconds=second)).strftime("%Y-%m-%dT%H:%M:%S")
        log_store.process_batch(raw_frame(spark, [event(level="ERROR", message=str(i))], when), root, i)
    ticks = log_store.read_ticks(spark, root)
    assert column(WI.errors_idle_5m(ticks, "2026-08-28T10:12:00Z"), "errors") == [2]


def test_compaction_keeps_what_readers_see(spark, tmp_path):
    root, target = str(tmp_path / "store"), str(tmp_path / "compacted")
    for i in range(3):
        log_store.process_batch(raw_frame(spark, VALUES, f"2026-08-28T1{i}:00:00"), root, i)
    log_store.compact_days(spark, root, ["2026-08-28", "2020-01-01"], target)
    assert log_store.read_messages(spark, target).count() == 4
    same = [sorted(map(str, log_store.read_documents(spark, r).collect())) for r in (root, target)]
    assert same[0] == same[1]


def test_merged_store_reads_the_same_and_goes_on(spark, tmp_path):
    root, target = str(tmp_path / "store"), str(tmp_path / "merged")
    for i in range(3):
        log_store.process_batch(raw_frame(spark, VALUES, f"2026-08-28T1{i}:00:00"), root, i)
    log_store.compact_store(spark, root, target, last_batch=2)
    assert tables(spark, target) == tables(spark, root)
    for r in (root, target):
        log_store.process_batch(raw_frame(spark, VALUES, "2026-08-28T15:00:00"), r, 3)
    assert tables(spark, target) == tables(spark, root)


def test_published_stream_feeds_the_ingest_stream(spark, tmp_path):
    path, out = str(tmp_path / "raw"), str(tmp_path / "published")
    lay(spark, path, [(VALUES[:3], "2026-08-28T10:00:01"), (VALUES[3:], "2026-08-28T10:00:02")])
    verdicts = ingest.ingest_verdict(raw_events.stream_raw_files(spark, path, 1))
    records = ingest.publish_records(verdicts.where(F.col("verdict") == ingest.QUEUED))
    ST.drain(raw_events.start_publish_files(records, out, out + "-checkpoint"))
    published = spark.read.parquet(out)
    assert published.count() == 4
    assert sorted(column(published, "key")) == ["svc-1", "svc-1", "svc-2", "svc-2"]


def test_synthetic_stream_is_a_stream(spark):
    logs = synthetic.synthetic_stream(spark, 5, synthetic.SyntheticConfig())
    assert logs.isStreaming and logs.columns == ["id", "timestamp", "level", "service", "message", "trace_id", "ip"]


def test_large_batch_is_read_in_more_tasks(spark, root, monkeypatch):
    """One raw file: the tables are not made from one task that holds all of it, and nothing staged stays behind."""
    rng, seen, write = random.Random(3), [], log_store._write_batch
    raw = raw_frame(spark, [event(message=f"{i} {rng.random()}", trace_id=str(rng.random())) for i in range(6000)]).coalesce(1)

    def watched(rows, *others):
        parts = rows.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
        seen.append(max(parts))
        write(rows, *others)

    monkeypatch.setattr(log_store, "_write_batch", watched)
    monkeypatch.setattr(log_store, "ROW_GROUP", 64 << 10, raising=False)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(64 << 10))
    try:
        log_store.process_batch(raw, root, batch_id=0)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0] < 3000
    assert log_store.read_messages(spark, root).count() == 6000
    assert not os.path.exists(f"{root}/staging/batch_id=0")
