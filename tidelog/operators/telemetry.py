"""Latency summaries, histograms, counter rates and quantiles over samples.

Exact quantiles never gather a group: rows are counted by the leading bits of
their value first (``nearest_rank``), so windows run over counts and not rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Histogram bounds by metric, in the unit of the metric (fixed values).
HTTP_SECONDS = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0]
INDEXING_SECONDS = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5]
BULK_DOCUMENTS = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 150.0, 200.0, 250.0, 500.0]
BULK_SECONDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5]
COUNTER_STORE_SECONDS = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0]
PROCESSING_SECONDS = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5]
RETENTION_SECONDS = [0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]

SUMMARY_PERCENTS = [50, 90, 95, 99]
EMPTY_RUN_NS = 1_000_000
INFINITY = float("inf")

_RANGE_BITS = 12


# ------------------------------------------------------------ request runs


def _rank_of(n: Column, percent: int) -> Column:
    """Nearest rank ``ceil(n * p)``, at least 1."""
    return F.greatest(F.floor((n * percent + 99) / 100), F.lit(1)).cast("long")


def nearest_rank(samples: DataFrame, by: list[str], value: str, percents: list[int]) -> DataFrame:
    """Exact nearest-rank percentiles of a non-negative integer column.

    1. Count rows per range of values that share their 13 leading bits: at most
       some 200,000 counts per group, combined on the map side.  A running sum
       over them finds the range each rank falls into.
    2. Read the values again, keep those inside the found ranges only, count
       equal ones, and find each rank by a running sum over its range.

    Result: ``by`` and one column ``p50`` ... per percent.
    """
    values = samples.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("long").alias("_v"))
    shift = F.greatest(F.length(F.bin("_v")) - (_RANGE_BITS + 1), F.lit(0))
    # Integer powers of two below 2^63 are exact as doubles.
    values = values.withColumn("_range", F.col("_v") - F.pmod("_v", F.pow(F.lit(2.0), shift).cast("long")))

    ranges = values.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    up_to = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = ranges.withColumn("_end", F.sum("_n").over(up_to)).withColumn(
        "_total", F.sum("_n").over(Window.partitionBy(*by))
    )
    start = F.col("_end") - F.col("_n")
    wanted = F.filter(
        F.array(*[F.struct(F.lit(p).alias("p"), _rank_of(F.col("_total"), p).alias("rank")) for p in percents]),
        lambda w: (w["rank"] > start) & (w["rank"] <= F.col("_end")),
    )
    hit = ranges.select(*by, "_range", start.alias("_start"), wanted.alias("_wanted")).where(F.size("_wanted") > 0)

    # One row per group and percent at most; adaptive execution measures it.  A null is a group like any other.
    marked = hit.select(*[F.col(c).alias(f"_hit_{c}") for c in [*by, "_range"]], "_start", "_wanted")
    same = [F.col(c).eqNullSafe(F.col(f"_hit_{c}")) for c in [*by, "_range"]]
    inside = values.join(marked, same)
    counted = inside.groupBy(*by, "_range", "_start", "_wanted", "_v").agg(F.count(F.lit(1)).alias("_n"))
    in_order = Window.partitionBy(*by, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("_end", F.col("_start") + F.sum("_n").over(in_order))
    found = ranked.select(*by, "_v", "_n", "_end", F.explode("_wanted").alias("_w")).where(
        (F.col("_w.rank") <= F.col("_end")) & (F.col("_w.rank") > F.col("_end") - F.col("_n"))
    )
    return found.groupBy(*by).agg(
        *[F.max(F.when(F.col("_w.p") == p, F.col("_v"))).alias(f"p{p}") for p in percents]
    )


def latency_summary(samples: DataFrame, by: list[str], approximate: bool = False) -> DataFrame:
    """Totals, rate and latency distribution of each run; ``by`` names the run columns.

    ``samples`` has ``ts, latency_ns, status_code, failed``.  A request is ok
    with a 2xx code and no transport error.  The mean is cut to whole
    nanoseconds and a run without duration counts as one millisecond.
    """
    ok = F.col("status_code").between(200, 299) & ~F.col("failed")
    span = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) * 1000
    totals = samples.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok).alias("success"),
        F.count_if(~ok).alias("failed"),
        F.when(span <= 0, F.lit(EMPTY_RUN_NS)).otherwise(span).cast("long").alias("duration_ns"),
        F.min("latency_ns").alias("min_ns"),
        F.floor(F.sum(F.col("latency_ns").cast("decimal(38,0)")) / F.count("latency_ns")).cast("long").alias("avg_ns"),
        F.max("latency_ns").alias("max_ns"),
    )
    totals = totals.withColumn("rate", F.col("total") / (F.col("duration_ns") / F.lit(1e9)))
    if approximate:
        marks = samples.groupBy(*by).agg(
            *[F.percentile_approx("latency_ns", p / 100).alias(f"p{p}") for p in SUMMARY_PERCENTS]
        )
    else:
        marks = nearest_rank(samples, by, "latency_ns", SUMMARY_PERCENTS)
    marks = marks.withColumnsRenamed({c: f"_mark_{c}" for c in by})
    joined = totals.join(marks, [F.col(c).eqNullSafe(F.col(f"_mark_{c}")) for c in by], "left")
    return joined.drop(*[f"_mark_{c}" for c in by])


def status_code_counts(samples: DataFrame, by: list[str]) -> DataFrame:
    """Requests per status code; requests without an answer (code 0) are left out."""
    return samples.where(F.col("status_code") > 0).groupBy(*by, "status_code").agg(F.count(F.lit(1)).alias("requests"))


# --------------------------------------------------------------- histograms


def _bound_of(value: Column, bounds: list[float]) -> Column:
    """The smallest bound that is not below ``value``."""
    bound = F.lit(INFINITY)
    for le in sorted(bounds, reverse=True):
        bound = F.when(value <= F.lit(le), F.lit(le)).otherwise(bound)
    return bound


def histogram_buckets(observations: DataFrame, by: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Cumulative ``le`` buckets of each series, empty buckets included.

    Each observation is counted once under its own bound; the running sum then
    runs over the few bounds of a series.
    """
    counted = observations.where(F.col(value).isNotNull()).groupBy(*by, _bound_of(F.col(value), bounds).alias("le")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return cumulate_buckets(counted, by, bounds)


def cumulate_buckets(counted: DataFrame, by: list[str], bounds: list[float]) -> DataFrame:
    """Per-bound counts ``n`` to cumulative ``bucket_count`` for every bound."""
    every = [*sorted(bounds), INFINITY]
    wide = counted.groupBy(*by).agg(
        *[F.coalesce(F.sum(F.when(F.col("le") == F.lit(le), F.col("n"))), F.lit(0)).alias(f"_b{i}") for i, le in enumerate(every)]
    )
    rows, running = [], F.lit(0).cast("long")
    for i, le in enumerate(every):
        running = running + F.col(f"_b{i}")
        rows.append(F.struct(F.lit(le).alias("le"), running.alias("bucket_count")))
    return wide.select(*by, F.inline(F.array(*rows)))


# ----------------------------------------------------------- counter samples


def series_key(labels: str = "labels") -> Column:
    """A map as its entries in key order, usable as a grouping key."""
    return F.sort_array(F.map_entries(labels))


def counter_increase(samples: DataFrame, series: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """Reset-aware increase of each series per minute.

    A value below the one before it is a restart and counts in full.  The first
    sample of a series has no increase.  Minutes are reduced on their own first;
    a second, small window then adds the step between neighbouring minutes, so a
    busy series is never sorted as a whole.
    """
    minute = F.date_trunc("minute", F.col(ts))

    def step(now: Column, before: Column) -> Column:
        return F.when(before.isNull(), F.lit(0.0)).when(now < before, now).otherwise(now - before)

    in_minute = Window.partitionBy(*series, "minute").orderBy(ts, value)
    rows = samples.withColumn("minute", minute)
    rows = rows.withColumn("_step", step(F.col(value), F.lag(value).over(in_minute)))
    place = F.struct(F.col(ts).alias("t"), F.col(value).alias("v"))
    per_minute = rows.groupBy(*series, "minute").agg(
        F.sum("_step").alias("_inner"), F.min(place).alias("_first"), F.max(place).alias("_last")
    )
    by_minute = Window.partitionBy(*series).orderBy("minute")
    joint = step(F.col("_first.v"), F.lag("_last.v").over(by_minute))
    return per_minute.select(*series, "minute", (F.col("_inner") + joint).alias("increase"))


def counter_rate_1m(samples: DataFrame, by: list[str], labels: str = "labels") -> DataFrame:
    """Per-second increase per minute, summed over the series of each ``by`` group.

    ``by`` holds label names; ``[]`` sums everything.
    """
    keyed = samples.select("metric", series_key(labels).alias("series"), "ts", "value",
                           *[F.col(labels)[name].alias(name) for name in by])
    increase = counter_increase(keyed, ["metric", "series", *by])
    return increase.groupBy("metric", *by, "minute").agg((F.sum("increase") / 60).alias("rate"))


def latest_sum(samples: DataFrame, labels: str = "labels") -> DataFrame:
    """Sum over the latest value of every series of each metric."""
    latest = samples.groupBy("metric", series_key(labels).alias("series")).agg(
        F.max(F.struct("ts", "value")).alias("_last")
    )
    return latest.groupBy("metric").agg(F.sum("_last.value").alias("total"))


def metric_samples(samples: DataFrame, metric: str, **labels: str) -> DataFrame:
    chosen = samples.where(F.col("metric") == metric)
    for name, wanted in labels.items():
        chosen = chosen.where(F.col("labels")[name] == wanted)
    return chosen


# ---------------------------------------------------------- dashboard panels


def ops_throughput(samples: DataFrame) -> DataFrame:
    """Ingest requests and consumed messages per second, by minute."""
    requests = metric_samples(samples, "http_requests_total", service="ingestor")
    consumed = metric_samples(samples, "kafka_messages_consumed_total")
    return counter_rate_1m(requests.unionByName(consumed), [])


def ops_lag(samples: DataFrame) -> DataFrame:
    return latest_sum(metric_samples(samples, "kafka_consumer_lag"))


def ops_dlq(samples: DataFrame) -> DataFrame:
    return latest_sum(metric_samples(samples, "kafka_dlq_messages_total"))


def ops_error_ratio(samples: DataFrame) -> DataFrame:
    """Errors per request and minute; without requests the divisor is 1."""
    rates = counter_rate_1m(
        samples.where(F.col("metric").isin("http_errors_total", "http_requests_total")), []
    )
    per_minute = rates.groupBy("minute").agg(
        F.max(F.when(F.col("metric") == "http_errors_total", F.col("rate"))).alias("errors"),
        F.max(F.when(F.col("metric") == "http_requests_total", F.col("rate"))).alias("requests"),
    )
    divisor = F.when(F.col("requests") > 0, F.col("requests")).otherwise(F.lit(1.0))
    return per_minute.where(F.col("errors").isNotNull()).select("minute", (F.col("errors") / divisor).alias("error_ratio"))


STATUS_METRICS = ["bulk_batches_total", "bulk_documents_total", "elasticsearch_indexing_total", "redis_operations_total"]


def ops_by_status(samples: DataFrame) -> DataFrame:
    """Per-second rate of each status of the four write-side counters."""
    return counter_rate_1m(samples.where(F.col("metric").isin(STATUS_METRICS)), ["status"])


def bucket_quantiles(buckets: DataFrame, by: list[str], weight: str, quantiles: list[float]) -> DataFrame:
    """Quantiles from cumulative ``le`` buckets by linear interpolation.

    The first bucket that reaches ``q * total`` is interpolated from its lower
    bound (0 for the first); a rank in the open bucket gives the last finite bound.
    """
    in_order = Window.partitionBy(*by).orderBy("le")
    rows = (
        buckets.withColumn("_below", F.coalesce(F.lag(weight).over(in_order), F.lit(0.0)))
        .withColumn("_floor", F.coalesce(F.lag("le").over(in_order), F.lit(0.0)))
        .withColumn("_total", F.max(weight).over(Window.partitionBy(*by)))
        .where(F.col("_total") > 0)
    )
    marks = []
    for q in quantiles:
        rank = F.lit(q) * F.col("_total")
        part = (rank - F.col("_below")) / (F.col(weight) - F.col("_below"))
        at = F.when(F.col("le") == F.lit(INFINITY), F.col("_floor")).otherwise(
            F.col("_floor") + (F.col("le") - F.col("_floor")) * part
        )
        here = (F.col(weight) >= rank) & (F.col("_below") < rank)
        marks.append(F.max(F.when(here, at)).alias(f"p{round(q * 100)}"))
    return rows.groupBy(*by).agg(*marks)


def ops_quantiles(samples: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.95, 0.99), service: str | None = None) -> DataFrame:
    """Latency quantiles per bucket metric, service and minute, or of one ``service`` only.

    ``samples`` are cumulative bucket counters; rates are summed over the series of a
    service by bound before interpolating.  Series without a service label are a service named null.
    """
    named = F.col("labels").getItem("service")
    if service is not None:
        samples = samples.where(named == service)
    keyed = samples.select("metric", named.alias("service"), series_key().alias("series"), "le", "ts", "value")
    increase = counter_increase(keyed, ["metric", "service", "series", "le"])
    rates = increase.groupBy("metric", "service", "minute", "le").agg((F.sum("increase") / 60).alias("rate"))
    return bucket_quantiles(rates, ["metric", "service", "minute"], "rate", list(quantiles))


def consumer_lag(offsets: DataFrame) -> DataFrame:
    """Unprocessed messages per topic partition.

    ``offsets`` has ``topic, partition, latest, committed`` observations.
    """
    return offsets.groupBy("topic", "partition").agg(
        F.greatest(F.max("latest") - F.max("committed"), F.lit(0)).alias("lag")
    )


def lag_with_total(lags: DataFrame) -> DataFrame:
    """The lag of each partition, and of each topic with a null partition."""
    totals = lags.groupBy("topic").agg(F.sum("lag").alias("lag"))
    return lags.select("topic", "partition", "lag").unionByName(totals.select("topic", F.lit(None).cast("int").alias("partition"), "lag"))
