import time

from tidelog.operators import telemetry as T
from tidelog.sources import raw_events
from tidelog.streaming import ingest_stream as ST
from tidelog.streaming import lag as L

from test_streaming import VALUES, lay


def report(end, latest, at="2026-08-28T10:00:00.000Z", name="ingest"):
    return {"id": "q-1", "name": name, "timestamp": at, "sources": [{"description": "KafkaV2[Subscribe[app-logs]]", "endOffset": end, "latestOffset": latest}]}


def lags(df):
    return {(r.topic, r.partition): r.lag for r in df.collect()}


def test_offsets_by_partition(spark):
    first = L.observations(report({"app-logs": {"0": 5, "1": 7}}, {"app-logs": {"0": 9, "1": 7, "2": 4}}))
    later = L.observations(report('{"app-logs": {"0": 9, "1": 7, "2": 1}}', '{"app-logs": {"0": 12, "1": 7, "2": 4}}', "2026-08-28T10:00:09.000Z"))
    assert [(o["partition"], o["latest"], o["committed"]) for o in first] == [(0, 9, 5), (1, 7, 7), (2, 4, 0)]
    rows = [(None, o["query"], o["topic"], o["partition"], o["latest"], o["committed"]) for o in later]
    assert lags(L.running_lag(spark.createDataFrame(rows, L.OBSERVATIONS))) == {("app-logs", 0): 3, ("app-logs", 1): 0, ("app-logs", 2): 3, ("app-logs", None): 6}


def test_sources_with_one_log_and_without_offsets():
    files = L.observations(report({"logOffset": 3}, None))
    assert [(o["partition"], o["latest"], o["committed"]) for o in files] == [(0, 4, 4)]
    assert L.observations(report(7, 9))[0]["latest"] == 10 and L.observations(report(None, None)) == []


def test_a_drained_query_has_no_lag(spark, tmp_path):
    path, root, seen = str(tmp_path / "raw"), str(tmp_path / "store"), str(tmp_path / "lag")
    lay(spark, path, [(VALUES[:3], "2026-08-28T10:00:01"), (VALUES[3:], "2026-08-28T10:00:05")])
    assert L.running_lag(L.read_observations(spark, seen)).count() == 0
    observer = L.LagObserver(spark, seen)
    spark.streams.addListener(observer)
    try:
        ST.drain(ST.start_ingest(raw_events.stream_raw_files(spark, path, max_files_per_trigger=1), root, root + "-checkpoint", flush_interval=None))
        for _ in range(60):
            if L.read_observations(spark, seen).where("committed = 2").count():
                break
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(observer)
    got = lags(L.running_lag(L.read_observations(spark, seen)))
    assert set(got.values()) == {0} and {p for _, p in got} == {0, None}
    assert L.read_observations(spark, seen).count() >= 2


def test_total_of_all_partitions(spark):
    df = spark.createDataFrame([("t", 0, 3), ("t", 1, 0), ("u", 0, 5)], "topic string, partition int, lag long")
    assert lags(T.lag_with_total(df)) == {("t", 0): 3, ("t", 1): 0, ("t", None): 3, ("u", 0): 5, ("u", None): 5}


def test_quantiles_of_one_service(spark):
    rows = [(f"2026-08-28T10:0{m}:00", s, le, float(v * m)) for m in (0, 1) for s, at in (("a", 0.1), ("b", 0.5)) for le, v in ((0.1, 10 * (at == 0.1)), (0.5, 10))]
    df = spark.createDataFrame(rows, "at string, service string, le double, value double")
    samples = df.selectExpr("cast(at as timestamp) as ts", "'m' as metric", "map('service', service) as labels", "le", "cast(value as double) as value")
    got = {(r.service, r.minute.minute): r.p50 for r in T.ops_quantiles(samples).collect()}
    assert got == {("a", 1): 0.05, ("b", 1): 0.1 + 0.4 * 0.5}
    assert [r.service for r in T.ops_quantiles(samples, service="b").collect()] == ["b"]
