import datetime as dt

import pytest

from tidelog.operators import retention as R
from tidelog.sources import log_store, retention_runs

from helpers import column, event, raw_frame

NOW = "2026-08-28T15:00:00Z"


def days_ago(*days):
    base = dt.date(2026, 8, 28)
    return [f"logs-v1-{base - dt.timedelta(days=d):%Y.%m.%d}" for d in days]


def frame(spark, names, docs=None, size=None):
    rows = [(n, (docs or [1] * len(names))[i], (size or [1] * len(names))[i]) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "name string, doc_count long, store_size_bytes long")


def actions(plan):
    return {r["name"]: r["action"] for r in plan.collect()}


def test_two_of_four_days_expire(spark):
    names = days_ago(0, 10, 45, 60)
    plan = R.retention_plan(frame(spark, names), 30, NOW)
    assert actions(plan) == dict(zip(names, ["keep", "keep", "delete", "delete"], strict=True))
    assert tuple(R.plan_summary(plan).first()) == (4, 2)


def test_the_cutoff_day_itself_stays(spark):
    names = days_ago(30, 31)
    assert list(actions(R.retention_plan(frame(spark, names), 30, NOW)).values()) == ["keep", "delete"]


def test_odd_names_are_skipped_but_counted(spark):
    names = ["other-2020.01.01", "logs-v1-2020.02.30", *days_ago(90)]
    plan = R.retention_plan(frame(spark, names), 30, NOW)
    assert list(actions(plan).values()) == ["skip", "skip", "delete"]
    assert tuple(R.plan_summary(plan).first()) == (3, 1)


@pytest.mark.parametrize("days", [0, -5])
def test_retention_days_must_be_positive(spark, days):
    with pytest.raises(ValueError):
        R.retention_plan(frame(spark, days_ago(1)), days, NOW)


def test_delete_before(spark):
    names = days_ago(0, 5, 20)
    plan = R.delete_before_plan(frame(spark, names), "2026-08-18T15:00:00Z", NOW)
    assert list(actions(plan).values()) == ["keep", "keep", "delete"]
    noon = R.delete_before_plan(frame(spark, names), "2026-08-23T12:00:00Z", NOW)
    assert list(actions(noon).values()) == ["keep", "delete", "delete"]
    with pytest.raises(ValueError, match="future"):
        R.delete_before_plan(frame(spark, names), "2026-08-28T15:00:01Z", NOW)
    today = R.delete_before_plan(frame(spark, days_ago(0)), NOW, NOW)
    assert today.first()["reason"] == "active_write_index"


def test_stats(spark):
    names = days_ago(0, 3)
    stats = R.index_stats(frame(spark, [*names, "odd"], [200, 300, 7], [1000, 1500, 5])).first()
    assert (stats["total_logs"], stats["total_indices"], stats["total_size_bytes"]) == (507, 3, 2505)
    assert (stats["oldest_index"], stats["newest_index"]) == (names[1], names[0])
    empty = R.index_stats(frame(spark, names).limit(0)).first()
    assert (empty["total_logs"], empty["total_indices"], empty["oldest_index"]) == (0, 0, None)


def test_policies(spark):
    docs = spark.createDataFrame(
        [("a", dt.date(2026, 8, 20), "1"), ("a", dt.date(2026, 8, 20), "1"), ("b", dt.date(2026, 8, 20), "2"), ("c", dt.date(2026, 7, 1), "3")],
        "tenant_id string, event_date date, doc_id string",
    )
    policies = spark.createDataFrame([("a", 7, True), ("b", 7, False)], "tenant_id string, retention_days int, enabled boolean")
    rows = R.retention_by_policy(docs, policies, NOW).orderBy("tenant_id").collect()
    assert [(r["doc_count"], r["retention_days"], r["expired"]) for r in rows] == [(1, 7, True), (1, 30, False), (1, 30, True)]


@pytest.fixture
def store(spark, root):
    values = [event(timestamp=f"2026-08-{d:02d}T10:00:00Z", message=f"m{d}") for d in (28, 20, 10, 5)]
    log_store.process_batch(raw_frame(spark, values), root, 0)
    log_store.process_batch(raw_frame(spark, [event(timestamp="2026-08-05T11:00:00Z")]), root, 1)
    return root


def stored_days(spark, store):
    return sorted({str(d) for d in column(log_store.read_messages(spark, store), "event_date")})


def test_run_retention_drops_days_and_keeps_metrics(spark, store):
    before = sorted(map(tuple, log_store.read_counters(spark, store).collect()))
    result = retention_runs.run_retention(spark, store, 10, NOW)
    assert (result.evaluated, result.deleted) == (4, 2)
    assert result.deleted_indices == ["logs-v1-2026.08.05", "logs-v1-2026.08.10"]
    assert result.cutoff == dt.datetime(2026, 8, 18, tzinfo=dt.timezone.utc)
    assert stored_days(spark, store) == ["2026-08-20", "2026-08-28"]
    assert sorted(map(tuple, log_store.read_counters(spark, store).collect())) == before


def test_delete_one_day(spark, store):
    with pytest.raises(R.InvalidIndexName):
        retention_runs.delete_index(spark, store, "logs-v1-*", NOW)
    with pytest.raises(R.InvalidIndexName):
        retention_runs.delete_index(spark, store, "logs-v1-2026.8.5", NOW)
    with pytest.raises(R.ProtectedIndex):
        retention_runs.delete_index(spark, store, "logs-v1-2026.08.28", NOW)
    with pytest.raises(R.IndexNotFound):
        retention_runs.delete_index(spark, store, "logs-v1-2026.08.27", NOW)
    retention_runs.delete_index(spark, store, "logs-v1-2026.08.05", NOW)
    assert stored_days(spark, store) == ["2026-08-10", "2026-08-20", "2026-08-28"]


def test_inventory_counts_ids_once(spark, store):
    log_store.process_batch(raw_frame(spark, [event(timestamp="2026-08-05T11:00:00Z")]), store, 2)
    rows = {r["name"]: r for r in retention_runs.store_indices(spark, store).collect()}
    assert rows["logs-v1-2026.08.05"]["doc_count"] == 2
    assert all(r["store_size_bytes"] > 0 and r["creation_date"] and r["status"] == "open" for r in rows.values())
