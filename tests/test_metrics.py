import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import rollups as RU
from tidelog.operators import windows as WI
from tidelog.operators.ranking import first_per_group

from helpers import at, column, message_frame


def shift(seconds, base="2026-08-28T10:00:00"):
    import datetime as dt

    return at(base) + dt.timedelta(seconds=seconds)


def test_one_error_shows_up_everywhere(spark):
    m = message_frame(spark, [{"service": "payment-api", "message": "Gateway timeout", "ip": "1.1.1.1"}])
    got = {(r["metric"], r["dim"]): r["value"] for r in RU.counters(m).collect()}
    assert got == {
        ("logs_total", ""): 1, ("logs_service", "payment-api"): 1, ("logs_level", "error"): 1,
        ("errors_service", "payment-api"): 1, ("leaderboard_errors", "Gateway timeout"): 1,
    }
    assert [tuple(r) for r in RU.top_services(m).collect()] == [("payment-api", 1)]
    assert [tuple(r) for r in RU.top_errors(m).collect()] == [("Gateway timeout", 1)]


def test_tenants_are_apart(spark):
    m = message_frame(spark, [{"tenant_id": "alpha", "level": "INFO"}, {"tenant_id": "beta"}, {"level": "WARN"}])
    assert {r["tenant_id"]: r["logs"] for r in RU.logs_total(m).collect()} == {"alpha": 1, "beta": 1, "default": 1}
    assert {r["tenant_id"] for r in RU.errors_by_service(m).collect()} == {"beta"}


def test_a_service_named_total_does_not_clash(spark):
    m = message_frame(spark, [{"service": "total"}, {"service": "level:error"}])
    got = {(r["metric"], r["dim"]): r["value"] for r in RU.counters(m).collect()}
    assert got[("logs_total", "")] == 2 and got[("logs_service", "total")] == 1


def test_only_exact_upper_case_levels_are_errors(spark):
    m = message_frame(spark, [{"level": v} for v in ("ERROR", "FATAL", "error", " ERROR", "WARN")])
    assert column(RU.errors_by_service(m), "errors") == [2]


def test_ties_are_in_reverse_order(spark):
    m = message_frame(spark, [{"service": s} for s in ("a", "b", "c", "b", "a", "d")])
    assert column(RU.top_services(m, 3), "service") == ["b", "a", "d"]


def test_board_sizes():
    assert (RU.board_size(None), RU.board_size(7), RU.board_size(500)) == (10, 7, 100)
    for bad in (0, -3):
        with pytest.raises(ValueError):
            RU.board_size(bad)


@pytest.mark.parametrize("gap,count", [(299, 2), (300, 2), (301, 1)])
def test_idle_counter_gap(spark, gap, count):
    m = message_frame(spark, [{"ingested_at": shift(0)}, {"ingested_at": shift(gap)}])
    rows = WI.errors_idle_5m(WI.error_ticks(m), "2026-08-28T10:05:02Z").collect()
    assert [r["errors"] for r in rows] == [count]


@pytest.mark.parametrize("now,count", [("10:05:00", 1), ("10:05:01", 0)])
def test_idle_counter_expires(spark, now, count):
    m = message_frame(spark, [{"ingested_at": shift(0)}])
    assert column(WI.errors_idle_5m(WI.error_ticks(m), f"2026-08-28T{now}Z"), "errors") == [count]


def test_idle_counter_of_an_earlier_moment(spark):
    m = message_frame(spark, [{"ingested_at": shift(s)} for s in (0, 10, 20, 30)])
    now = "2026-08-28T10:00:15Z"
    assert column(WI.errors_idle_5m(WI.error_ticks(m, until=now), now), "errors") == [2]


def brute_idle(times, now):
    run, last = 0, None
    for t in sorted(times):
        run = run + 1 if last is not None and t - last <= 300 else 1
        last = t
    return run if last is not None and now - last <= 300 else 0


def test_idle_counter_against_brute_force(spark):
    rng = random.Random(1)
    rows, expect = [], {}
    for s in range(12):
        times, t = [], 0.0
        for _ in range(rng.randint(1, 40)):
            t += rng.choice([1, 120, 299, 300, 301, 400, 0])
            times.append(t)
        now = 4000
        times = [x for x in times if x <= now]
        if not times:
            continue
        expect[f"s{s}"] = brute_idle(times, now)
        rows += [{"service": f"s{s}", "ingested_at": shift(x)} for x in times]
    m = message_frame(spark, rows)
    # Parts of arbitrary batches merge to the same ticks.
    parts = [WI.error_ticks(m.where(F.col("offset") % 3 == i)) for i in range(3)]
    merged = WI.merge_ticks(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    now = shift(4000)
    for ticks in (WI.error_ticks(m), merged):
        assert {r["service"]: r["errors"] for r in WI.errors_idle_5m(ticks, now).collect()} == expect


def test_sliding_series_against_brute_force(spark):
    rng = random.Random(2)
    times = sorted(rng.choice([0, 1, 150, 299, 300, 301, 599, 600, 601, 900, 1200, 1201]) for _ in range(60))
    m = message_frame(spark, [{"ingested_at": shift(t, "2026-08-28T10:02:30")} for t in times])
    rows = WI.errors_sliding_series(m).orderBy("at").collect()
    expect = [sum(1 for x in times if t - 300 <= x <= t) for t in sorted(set(times))]
    assert [r["errors_5m"] for r in rows] == expect


def test_sliding_counter_includes_both_ends(spark):
    m = message_frame(spark, [{"ingested_at": shift(s)} for s in (-301, -300, -1, 0, 1)])
    assert column(WI.errors_sliding_5m(m, "2026-08-28T10:00:00Z"), "errors") == [3]


def test_recent_errors_keeps_the_newest_hundred(spark):
    rows = [{"ingested_at": shift(i), "payload": f"p{i}"} for i in range(130)] + [{"service": "svc-2", "payload": "q"}]
    kept = WI.recent_errors(message_frame(spark, rows))
    mine = column(kept.where("service = 'svc-1'").orderBy("position"), "payload")
    assert mine == [f"p{i}" for i in range(129, 29, -1)]
    assert column(WI.read_recent_errors(kept, "svc-1"), "payload") == mine[:10]
    assert len(column(WI.read_recent_errors(kept, "svc-1", 500), "payload")) == 100
    with pytest.raises(ValueError):
        WI.read_recent_errors(kept, "svc-1", 0)


def test_equal_arrivals_are_ordered_by_offset(spark):
    kept = WI.recent_errors(message_frame(spark, [{"payload": "a"}, {"payload": "b"}]))
    assert column(kept.orderBy("position"), "payload") == ["b", "a"]


def test_first_per_group_with_a_hot_group(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 != 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("g"), "id"
    )
    got = first_per_group(df, ["g"], [F.desc("id")], 3, spread=["id"])
    rows = {(r["g"], r["rank"]): r["id"] for r in got.collect()}
    groups = {}
    for i in range(5000):
        groups.setdefault("hot" if i % 3 else f"k{i % 50}", []).append(i)
    expect = {(g, n + 1): v for g, ids in groups.items() for n, v in enumerate(sorted(ids, reverse=True)[:3])}
    assert rows == expect


def test_live_metrics(spark):
    m = message_frame(spark, [{"service": "a"}, {"service": "a", "level": "INFO"}, {"service": "b", "level": "INFO"}, {"tenant_id": "x"}])
    idle = WI.errors_idle_5m(WI.error_ticks(m), "2026-08-28T10:01:00Z")
    every = {r["service"]: tuple(r)[1:] for r in RU.live_metrics(m, idle).collect()}
    assert every == {"a": (3, 2, 1, 1), "b": (3, 1, 0, 0)}
    some = {r["service"]: tuple(r)[1:] for r in RU.live_metrics(m, idle, " b ,, nope").collect()}
    assert some == {"b": (3, 1, 0, 0), "nope": (3, 0, 0, 0)}
    assert RU.wanted_services("all") is None and RU.wanted_services("") is None and RU.wanted_services([" "]) is None
    assert RU.wanted_services(["a", "all"]) == ["a", "all"]


def test_unique_ips(spark):
    rows = [{"ip": "1.1.1.1"}, {"ip": "1.1.1.1"}, {"ip": "2.2.2.2"}, {"ip": None}, {"ip": "1.1.1.1", "ingested_at": shift(86400)}]
    m = message_frame(spark, rows)
    assert sorted((str(r["day"]), r["unique_ips"]) for r in RU.unique_ips_daily(m).collect()) == [("2026-08-28", 2), ("2026-08-29", 1)]
    assert sorted(column(RU.unique_ips_daily(m, approximate=True), "unique_ips")) == [1, 2]
    members = RU.unique_ips(m)
    assert members.count() == 3
    live = RU.unique_ips_live(members, "2026-08-29T10:00:01Z")
    assert [str(d) for d in column(live, "day")] == ["2026-08-29"]
    assert RU.unique_ips_live(members, "2026-08-29T10:00:00Z").count() == 2


def test_batch_status(spark):
    rows = spark.createDataFrame(
        [(1, None), (1, None), (2, None), (2, "es_item_error"), (3, "es_item_error"), (3, "parse_error")], "b int, reject_reason string"
    )
    got = {r["batch"]: (r["total_docs"], r["success_docs"], r["failed_docs"], r["status"]) for r in RU.bulk_result(rows, "b").collect()}
    assert got == {1: (2, 2, 0, "success"), 2: (2, 1, 1, "partial_failure"), 3: (1, 0, 1, "failure")}


def test_rate_limit(spark):
    rows = [{"ip": "1.1.1.1", "ingested_at": shift(i / 10)} for i in range(101)] + [{"ip": "2.2.2.2", "ingested_at": shift(i / 10)} for i in range(100)]
    report = RU.rate_limit_report(message_frame(spark, rows)).collect()
    assert [(r["ip"], r["requests"]) for r in report] == [("1.1.1.1", 101)]
