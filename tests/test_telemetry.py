import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import telemetry as T

from helpers import at, column

REQ = "run int, ts timestamp, latency_ns long, status_code int, failed boolean"
MS = 1_000_000


def test_hundred_requests(spark):
    t0 = at("2026-08-28T10:00:00")
    rows = [(1, t0 + dt.timedelta(seconds=i), (i + 1) * MS, 500 if i == 99 else 202, False) for i in range(100)]
    got = T.latency_summary(spark.createDataFrame(rows, REQ), ["run"]).first()
    assert (got["total"], got["success"], got["failed"]) == (100, 99, 1)
    assert [got[p] // MS for p in ("p50", "p90", "p95", "p99")] == [50, 90, 95, 99]
    assert (got["min_ns"], got["avg_ns"], got["max_ns"]) == (MS, 50_500_000, 100 * MS)
    assert (got["duration_ns"], got["rate"]) == (99 * 10**9, 100 / 99)


def test_a_run_without_duration(spark):
    got = T.latency_summary(spark.createDataFrame([(1, at("2026-08-28T10:00:00"), 5, 202, True)], REQ), ["run"]).first()
    assert (got["duration_ns"], got["rate"], got["success"], got["p99"]) == (MS, 1000.0, 0, 5)


def nearest(values, p):
    return sorted(values)[max(math.ceil(len(values) * p / 100), 1) - 1]


@pytest.mark.parametrize("seed", range(3))
def test_nearest_rank_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pick = [lambda: rng.randint(0, 20), lambda: rng.randint(0, 10**6), lambda: int(10 ** rng.uniform(0, 18)), lambda: 2 ** rng.randint(0, 60)]
    groups = {g: [rng.choice(pick)() for _ in range(rng.choice([1, 2, 3, 99, 100, 101, 500]))] for g in range(8)}
    groups[0] = [7] * 300  # one value
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g int, v long")
    percents = [1, 50, 90, 95, 99, 100]
    got = {r["g"]: [r[f"p{p}"] for p in percents] for r in T.nearest_rank(df, ["g"], "v", percents).collect()}
    assert got == {g: [nearest(vs, p) for p in percents] for g, vs in groups.items()}


def test_status_codes(spark):
    t0 = at("2026-08-28T10:00:00")
    df = spark.createDataFrame([(1, t0, 1, c, False) for c in (202, 202, 0, 503)], REQ)
    assert {r["status_code"]: r["requests"] for r in T.status_code_counts(df, ["run"]).collect()} == {202: 2, 503: 1}


def test_buckets_are_cumulative_and_complete(spark):
    df = spark.createDataFrame([("a", v) for v in (0.0, 0.001, 0.0011, 5.0, 7.5)] + [("b", 9.0)], "s string, v double")
    rows = T.histogram_buckets(df, ["s"], "v", T.HTTP_SECONDS).orderBy("s", "le").collect()
    a = {r["le"]: r["bucket_count"] for r in rows if r["s"] == "a"}
    assert (a[0.001], a[0.005], a[2.5], a[5.0], a[math.inf]) == (2, 3, 3, 4, 5)
    assert [r["bucket_count"] for r in rows if r["s"] == "b"] == [0] * 11 + [1]


SAMPLE = "ts timestamp, metric string, labels map<string,string>, value double"


def samples(spark, rows):
    return spark.createDataFrame([(at(f"2026-08-28T{t}"), m, lab, float(v)) for t, m, lab, v in rows], SAMPLE)


def test_rate_counts_resets_in_full(spark):
    s = samples(spark, [("10:00:00", "m", {"a": "1"}, 100), ("10:00:30", "m", {"a": "1"}, 160), ("10:01:00", "m", {"a": "1"}, 30),
                        ("10:01:10", "m", {"a": "1"}, 90), ("10:00:10", "m", {"a": "2"}, 5), ("10:00:20", "m", {"a": "2"}, 11)])
    rows = {str(r["minute"])[11:16]: r["rate"] for r in T.counter_rate_1m(s, []).collect()}
    assert rows == {"10:00": (60 + 6) / 60, "10:01": (30 + 60) / 60}
    by = {(r["a"], str(r["minute"])[11:16]): r["rate"] for r in T.counter_rate_1m(s, ["a"]).collect()}
    assert by == {("1", "10:00"): 1.0, ("1", "10:01"): 1.5, ("2", "10:00"): 0.1}


def test_increase_against_brute_force(spark):
    rng = random.Random(3)
    rows, value = [], 0
    for i in range(400):
        value = 0 if rng.random() < 0.05 else value + rng.randint(0, 9)
        rows.append((i, i * rng.choice([1, 7]) % 5000, value))
    rows = sorted({t: (t, float(v)) for _, t, v in rows}.values())
    base = at("2026-08-28T10:00:00")
    df = spark.createDataFrame([("s", base + dt.timedelta(seconds=t), v) for t, v in rows], "series string, ts timestamp, value double")
    expect, before = {}, None
    for t, v in rows:
        step = 0.0 if before is None else (v if v < before else v - before)
        expect[t // 60] = expect.get(t // 60, 0.0) + step
        before = v
    got = {int((r["minute"] - base.replace(tzinfo=None)).total_seconds()) // 60: r["increase"] for r in T.counter_increase(df, ["series"]).collect()}
    assert got == expect


def test_label_order_does_not_make_a_series(spark):
    df = spark.range(1).select(F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2")).alias("labels"))
    assert [tuple(e) for e in df.select(T.series_key()).first()[0]] == [("a", "2"), ("b", "1")]


def test_latest_values(spark):
    s = samples(spark, [("10:00:00", "kafka_consumer_lag", {"p": "0"}, 9), ("10:01:00", "kafka_consumer_lag", {"p": "0"}, 2),
                        ("10:00:00", "kafka_consumer_lag", {"p": "1"}, 3), ("10:00:00", "x", {"p": "1"}, 3)])
    assert T.ops_lag(s).first()["total"] == 5.0


def test_error_ratio_without_requests(spark):
    s = samples(spark, [("10:00:00", "http_errors_total", {}, 0), ("10:00:30", "http_errors_total", {}, 30)])
    assert column(T.ops_error_ratio(s), "error_ratio") == [0.5]


def test_bucket_quantiles(spark):
    rows = [("m", le, w) for le, w in [(0.1, 0.0), (0.2, 10.0), (0.5, 10.0), (1.0, 19.0), (math.inf, 20.0)]]
    got = T.bucket_quantiles(spark.createDataFrame(rows, "m string, le double, w double"), ["m"], "w", [0.25, 0.5, 0.725, 0.99]).first()
    assert got["p25"] == pytest.approx(0.15) and got["p50"] == pytest.approx(0.2)
    assert got["p72"] == pytest.approx(0.75) and got["p99"] == 1.0


def test_lag(spark):
    df = spark.createDataFrame([("t", 0, 10, 4), ("t", 0, 12, 9), ("t", 1, 5, 5)], "topic string, partition int, latest long, committed long")
    assert {r["partition"]: r["lag"] for r in T.consumer_lag(df).collect()} == {0: 3, 1: 0}


def persistent(spark):
    return set(spark.sparkContext._jsc.getPersistentRDDs().keySet())


def test_null_run_is_a_run(spark):
    before = persistent(spark)
    rows = [(at("2026-08-28T10:00:00"), None, n, 200, False) for n in (5, 7, 9)]
    df = spark.createDataFrame(rows, "ts timestamp, run string, latency_ns long, status_code int, failed boolean")
    got = T.latency_summary(df, ["run"]).first()
    assert (got["total"], got["p50"], got["p99"]) == (3, 7, 9)
    assert persistent(spark) <= before
