import os

import pytest
from pyspark.sql import functions as F

from tidelog.operators import retention as R
from tidelog.sources import log_store, merges, raw_events, retention_runs
from tidelog.streaming import ingest_stream as ST

from helpers import event, raw_frame
from test_streaming import VALUES, lay, tables


def fill(spark, root, batches=range(4)):
    for k in batches:
        values = [*VALUES, event(service=f"svc-{k}", message=f"only {k}", timestamp=f"2026-08-{20 + k}T08:00:00Z")]
        log_store.process_batch(raw_frame(spark, values, f"2026-08-28T10:0{k}:01").withColumn("offset", F.col("offset") + 100 * k), root, k)


def day_files(spark, root):
    return {r.event_date: r.n for r in log_store.store_files(spark, root).groupBy("event_date").agg(F.count("*").alias("n")).collect()}


def test_answers_stay_and_files_become_few(spark, root):
    fill(spark, root)
    before, files = tables(spark, root), day_files(spark, root)
    merge = log_store.merge_batches(spark, root, 3)
    assert tables(spark, root) == before and merges.read_log(spark, root) == [merge]
    after = day_files(spark, root)
    assert set(after) == set(files) and sum(after.values()) == len(after) < sum(files.values())
    gone = log_store.remove_merged(spark, root)
    assert gone and tables(spark, root) == before and log_store.remove_merged(spark, root) == []
    assert not [d for d in os.listdir(f"{root}/counters") if d.startswith("batch_id=")]


def test_later_batches_and_merges_of_merges(spark, root, tmp_path):
    plain = str(tmp_path / "plain")
    fill(spark, plain, range(6))
    fill(spark, root, range(3))
    log_store.merge_batches(spark, root, 1)
    fill(spark, root, [3, 4])
    log_store.merge_batches(spark, root, 3)
    fill(spark, root, [5])
    log_store.remove_merged(spark, root)
    got, want = tables(spark, root), tables(spark, plain)
    assert got == want
    assert [(m.first, m.last) for m in merges.read_log(spark, root)] == [(0, 3)]
    # A batch below the merge that is run again changes nothing that readers see.
    fill(spark, root, [2])
    assert tables(spark, root) == want


def test_interrupted_merge_leaves_the_old_answer(spark, root, monkeypatch):
    fill(spark, root, range(3))
    before = tables(spark, root)

    def stopped(*_):
        raise OSError("no such node")

    monkeypatch.setattr(merges, "commit", stopped)
    with pytest.raises(OSError):
        log_store.merge_batches(spark, root, 2)
    assert tables(spark, root) == before and merges.read_log(spark, root) == [] and log_store.remove_merged(spark, root) == []
    monkeypatch.undo()
    write = log_store._write_part
    calls = []

    def half(rows, target, table, batch):
        calls.append(table)
        if len(calls) == 3:
            raise OSError("disk gone")
        write(rows, target, table, batch)

    monkeypatch.setattr(log_store, "_write_part", half)
    with pytest.raises(OSError):
        log_store.merge_batches(spark, root, 2)
    assert tables(spark, root) == before
    monkeypatch.undo()
    log_store.merge_batches(spark, root, 2)
    assert tables(spark, root) == before


def test_overlapping_merges_are_refused(spark, root):
    fill(spark, root, range(2))
    log_store.merge_batches(spark, root, 1)
    with pytest.raises(ValueError, match="overlap"):
        merges.commit(spark, root, 1, 5, merges.new_folder(1, 5))


def test_merge_while_the_query_runs(spark, tmp_path):
    path, root = str(tmp_path / "raw"), str(tmp_path / "store")
    lay(spark, path, [(VALUES[:3], "2026-08-28T10:00:01"), (VALUES[3:], "2026-08-28T10:00:05")])
    query = ST.start_ingest(raw_events.stream_raw_files(spark, path, max_files_per_trigger=1), root, root + "-checkpoint")
    try:
        query.processAllAvailable()
        closed = log_store.closed_batch(spark, root + "-checkpoint")
        assert closed == 1
        log_store.merge_batches(spark, root, closed)
        assert query.isActive
        lay(spark, path, [(VALUES[:2], "2026-08-28T11:00:00")])
        query.processAllAvailable()
    finally:
        query.stop()
    whole = str(tmp_path / "whole")
    ST.rebuild_views(raw_events.read_raw_files(spark, path), whole, whole + "-staging")
    assert tables(spark, root) == tables(spark, whole)
    assert log_store.closed_batch(spark, str(tmp_path / "nowhere")) is None


def test_retention_reaches_merged_days(spark, root):
    fill(spark, root)
    log_store.merge_batches(spark, root, 2)
    counted = tables(spark, root)["counters"]
    result = retention_runs.run_retention(spark, root, 7, "2026-08-28T00:00:00Z")
    assert result.deleted == 2 and tables(spark, root)["counters"] == counted
    days = {str(r.event_date) for r in log_store.read_messages(spark, root).select("event_date").distinct().collect()}
    assert days == {"2026-08-21", "2026-08-22", "2026-08-23", "2026-08-28"}


def test_days_dropped_before_a_failure_are_told(spark, root, monkeypatch):
    fill(spark, root)
    real = log_store.drop_days

    def failing(spark, root, days, dropped=None):
        real(spark, root, days[:2], dropped)
        raise OSError("delete refused")

    monkeypatch.setattr(log_store, "drop_days", failing)
    with pytest.raises(retention_runs.RetentionFailed) as stopped:
        retention_runs.run_retention(spark, root, 5, "2026-08-28T00:00:00Z")
    assert stopped.value.result.deleted == 2 and len(stopped.value.result.deleted_indices) == 2
    assert isinstance(stopped.value.__cause__, OSError) and R.DROP
