import random

from pyspark.sql import functions as F

from tidelog.operators import ingest
from tidelog.operators import windows as WI
from tidelog.sources import raw_events
from tidelog.streaming import ingest_stream as ST
from tidelog.streaming import live_errors as L

from helpers import at, event, raw_frame

MIN = 60_000_000


def test_runs_go_on_end_and_begin_anew():
    assert L.prolonged(None, [(0, 0, 1), (5 * MIN, 5 * MIN, 2)]) == (3, 0, 5 * MIN)
    assert L.prolonged((3, 0, 5 * MIN), [(10 * MIN, 10 * MIN, 1)]) == (4, 0, 10 * MIN)
    assert L.prolonged((3, 0, 5 * MIN), [(10 * MIN + 1, 10 * MIN + 1, 1)]) == (1, 10 * MIN + 1, 10 * MIN + 1)
    # Late arrivals: inside the run, just before it, and long before it.
    assert L.prolonged((3, 20 * MIN, 25 * MIN), [(22 * MIN, 23 * MIN, 2)]) == (5, 20 * MIN, 25 * MIN)
    assert L.prolonged((3, 20 * MIN, 25 * MIN), [(15 * MIN, 15 * MIN, 1)]) == (4, 15 * MIN, 25 * MIN)
    assert L.prolonged((3, 20 * MIN, 25 * MIN), [(2 * MIN, 2 * MIN, 7)]) == (3, 20 * MIN, 25 * MIN)


def test_equal_to_the_batch_counter_after_a_restart(spark, tmp_path):
    rng = random.Random(4)
    path, root = str(tmp_path / "raw"), str(tmp_path / "live")
    minute = 0.0
    for batch in range(3):
        values, arrived = [], []
        for _ in range(60):
            minute += rng.choice([0.01, 0.5, 2, 6])
            values.append(event(service=f"svc-{rng.randrange(3)}", level=rng.choice(["ERROR", "FATAL", "INFO"]), tenant_id=rng.choice(["a", "b"]), timestamp="2020-01-01T00:00:00Z"))
            arrived.append(f"2026-08-28T{int(minute // 60):02d}:{int(minute % 60):02d}:{int(minute * 60 % 60):02d}")
        frame = raw_frame(spark, values, arrived).withColumn("offset", F.col("offset") + 1000 * batch)
        frame.coalesce(1).write.mode("append").parquet(path)
        # Each round is a query of its own that goes on from the checkpoint.
        ST.drain(L.start_live_errors(raw_events.stream_raw_files(spark, path, max_files_per_trigger=1), root, root + "-checkpoint", interval=None))
    accepted = ingest.accepted(raw_events.read_raw_files(spark, path))
    last = accepted.agg(F.max("ingested_at")).first()[0]
    for as_of in (last, at("2026-08-29T12:00:00")):
        got = {(r.tenant_id, r.service): r.errors for r in L.read_live_errors(spark, root, F.lit(as_of)).collect()}
        want = {(r.tenant_id, r.service): r.errors for r in WI.errors_idle_5m(WI.error_ticks(accepted), F.lit(as_of)).collect()}
        assert got == want and len(want) == 6
        assert any(want.values()) == (as_of == last)


def test_timer_reports_zero(spark, tmp_path):
    """With an idle time of two seconds, the update that ends the run comes by itself."""
    path, root = str(tmp_path / "raw"), str(tmp_path / "live")
    raw_frame(spark, [event(level="ERROR")]).coalesce(1).write.parquet(path)
    query = L.start_live_errors(raw_events.stream_raw_files(spark, path), root, root + "-checkpoint", interval="500 milliseconds", idle_seconds=2)
    try:
        for _ in range(120):
            query.awaitTermination(0.5)
            if query.lastProgress and spark.read.schema(L.OUTPUT).parquet(root).where("errors = 0").count():
                break
        updates = spark.read.schema(L.OUTPUT).parquet(root).collect()
    finally:
        query.stop()
    assert sorted(r.errors for r in updates) == [0, 1]
