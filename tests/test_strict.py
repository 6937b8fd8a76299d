"""Patterns match whole texts, and stores may be empty."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import event, raw_frame
from tidelog.functions.net import valid_ip
from tidelog.functions.times import index_day, parse_moment, parse_rfc3339
from tidelog.operators import ingest
from tidelog.operators import readers as RE
from tidelog.plans import catalog
from tidelog.sources import log_store, retention_runs

SF = "/root/testdata/sf0.001"


def test_a_line_break_behind_is_no_match(spark):
    rows = [("10.0.0.1", "2024-01-01T00:00:00Z", "logs-v1-2024.01.01"), ("10.0.0.1\n", "2024-01-01T00:00:00Z\n", "logs-v1-2024.01.01\n")]
    df = spark.createDataFrame(rows, "ip string, time string, name string")
    good, bad = df.select(valid_ip(F.col("ip")).alias("ip"), parse_rfc3339(F.col("time")).alias("time"), index_day(F.col("name")).alias("day")).collect()
    assert good.ip and good.time is not None and good.day == dt.date(2024, 1, 1)
    assert not bad.ip and bad.time is None and bad.day is None
    with pytest.raises(ValueError):
        parse_moment("2024-01-01T00:00:00Z\n")


@pytest.mark.parametrize(
    "text, want",
    [
        ("2024-01-02T00:30:00+23:00", "2024-01-01 01:30:00"),
        ("2024-01-01T23:00:00.25-18:30", "2024-01-02 17:30:00.25"),
        ("2024-01-01T12:00:00+18:00", "2023-12-31 18:00:00"),
        ("2024-01-01T12:00:00+24:00", None),
        ("2024-01-01T12:00:00+05:60", None),
        ("2024-02-30T12:00:00+20:00", None),
    ],
)
def test_wide_offsets(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(parse_rfc3339(F.col("t")).cast("string").alias("t")).first().t
    assert got == want


def test_store_that_was_never_written(spark, tmp_path):
    root = str(tmp_path / "nothing")
    assert log_store.read_documents(spark, root).count() == 0
    assert retention_runs.store_indices(spark, root).count() == 0
    assert RE.logs_total(log_store.read_counters(spark, root)).count() == 0
    assert retention_runs.run_retention(spark, root, 30, "2024-02-01T00:00:00Z").evaluated == 0


def test_store_emptied_by_retention(spark, root):
    log_store.process_batch(raw_frame(spark, [event(), event(message="other")]), root, 0)
    assert retention_runs.delete_before(spark, root, "2026-09-01T00:00:00Z", "2026-09-02T00:00:00Z").deleted == 1
    again = retention_runs.run_retention(spark, root, 1, "2026-09-10T00:00:00Z")
    assert (again.evaluated, again.deleted) == (0, 0)
    assert RE.logs_total(log_store.read_counters(spark, root)).first().logs == 2


def test_batch_of_rejects_only(spark, root):
    log_store.process_batch(raw_frame(spark, ["{broken"]), root, 0)
    assert retention_runs.store_indices(spark, root).count() == 0
    assert log_store.read_dlq(spark, root).count() == 1


@pytest.mark.parametrize("name", ["live_metrics", "logs_total", "top_services", "top_errors", "unique_ips_daily", "errors_idle_5m"])
def test_metrics_do_not_read_the_documents(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "/docs" not in plan and "message:string" not in plan


def test_the_last_of_names_that_differ_in_case_counts(spark):
    text = '{"timestamp":"2026-08-28T10:00:00Z","level":"INFO","service":"s","message":"x","MESSAGE":"late"}'
    other = '{"Message":"early","timestamp":"2026-08-28T10:00:00Z","level":"INFO","service":"s","message":"\\"Level\\": y"}'
    rows = ingest.parse_log(raw_frame(spark, [text, other])).orderBy("offset").collect()
    assert [(r.message, r.level, r.parse_error) for r in rows] == [("late", "INFO", None), ('"Level": y', "INFO", None)]
