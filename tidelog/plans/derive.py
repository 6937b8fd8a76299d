"""Log, request and metadata tables derived from the star-schema test tables.

The test data holds no logs, so every table the operators need is derived from
whole given tables, row by row, by the same rule here and in ``derive_sql``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.session import pin_utc

# Messages by event type; {k} is the number inside ``props``.
MESSAGES = {
    "error": "DB connection timeout after {k}s",
    "view": "Cache miss for key {k}",
    "signup": "Slow signup for account {k}",
    "purchase": "Payment processed for order {k}",
    "click": "Request completed in {k}ms",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    pin_utc(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _every(n: int):
    return F.col("event_id") % n == 0


def log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event fields per message; some events are sent twice."""
    ev = table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "event_type",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    ev = ev.withColumn("copy", F.explode(F.when(_every(89), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))

    tenant = F.element_at(F.array(F.lit(""), F.lit("tenant-a"), F.lit("tenant-b")), (F.col("user_id") % 3 + 1).cast("int"))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    level = (
        F.when(_every(127), " Warn ")
        .when((F.col("event_type") == "error") & _every(5), "FATAL")
        .when(F.col("event_type") == "error", "ERROR")
        .when(F.col("event_type") == "view", "DEBUG")
        .when(F.col("event_type") == "signup", "WARN")
        .otherwise("INFO")
    )
    message = F.lit(None).cast("string")
    for kind, pattern in MESSAGES.items():
        head, tail = pattern.split("{k}")
        message = F.when(F.col("event_type") == kind, F.concat(F.lit(head), F.col("k").cast("string"), F.lit(tail))).otherwise(message)
    message = F.when(_every(131), F.repeat(F.lit("é"), 501)).otherwise(message)
    trace = F.when(_every(11), "").otherwise(F.concat(F.lit("trace-"), F.col("user_id").cast("string")))
    last = (F.col("k") % 254 + 1).cast("string")
    ip = (
        F.when(_every(13), "")
        .when(_every(103), "999.1.1.1")
        .when(F.col("copy") == 1, F.concat(F.lit("10.0.0."), last))
        .otherwise(F.concat(F.lit("192.168."), (F.col("user_id") % 256).cast("string"), F.lit("."), last))
    )
    return ev.select(
        "event_id",
        "copy",
        "ts",
        tenant.alias("tenant_id"),
        F.when(_every(113), F.date_format("ts", "yyyy-MM-dd")).otherwise(stamp).alias("timestamp"),
        level.alias("level"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 7).cast("string")).alias("service"),
        message.alias("message"),
        trace.alias("trace_id"),
        ip.alias("ip"),
        F.timestamp_add("SECOND", F.col("copy") + 1, F.col("ts")).alias("arrived"),
    )


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream: JSON bodies in a Kafka-like envelope, with bad ones."""
    rows = log_rows(spark, sf_dir)

    def pair(name: str):
        return F.concat(F.lit(f'"{name}":"'), F.col(name), F.lit('"'))

    level = F.when(_every(109), F.lit('"level":5')).otherwise(pair("level"))
    service = F.when(_every(101), F.lit("")).otherwise(F.concat(pair("service"), F.lit(",")))
    body = F.concat(
        F.lit("{"), pair("tenant_id"), F.lit(","), pair("timestamp"), F.lit(","), level, F.lit(","), service,
        pair("message"), F.lit(","), pair("trace_id"), F.lit(","), pair("ip"), F.lit("}"),
    )
    value = F.when(_every(97), "{malformed").when(_every(107), F.concat(body, F.lit(" trailing"))).otherwise(body)
    return rows.select(
        F.coalesce(F.nullif("trace_id", F.lit("")), F.col("service")).alias("key"),
        value.alias("value"),
        F.lit("app-logs").alias("topic"),
        (F.col("event_id") % 3).cast("int").alias("partition"),
        (F.col("event_id") * 2 + F.col("copy")).alias("offset"),
        F.col("arrived").alias("timestamp"),
    )


# ------------------------------------------------------------------ metadata


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenant per customer; some have blank names or share a slug."""
    key = F.col("c_custkey")
    created = F.timestamp_add("MINUTE", (key * 37 % 100000).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return table(spark, sf_dir, "customer").select(
        _text("t-", key).alias("id"),
        F.when(key % 211 == 0, " ").otherwise(F.col("c_name")).alias("name"),
        F.when(key % 97 == 0, "shared").otherwise(F.lower(F.replace("c_name", F.lit("#"), F.lit("-")))).alias("slug"),
        F.when(F.col("c_mktsegment") == "BUILDING", "suspended")
        .when(F.col("c_mktsegment") == "HOUSEHOLD", "disabled").otherwise("active").alias("status"),
        created.alias("created_at"),
        created.alias("updated_at"),
    )


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A service per part; some have no tenant or one that does not exist."""
    key = F.col("p_partkey")
    created = F.timestamp_add("MINUTE", (key % 100000).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return table(spark, sf_dir, "part").select(
        _text("s-", key).alias("id"),
        F.when(F.col("p_size") == 1, "").otherwise(_text("t-", key * 7 % 1600)).alias("tenant_id"),
        F.col("p_name").alias("name"),
        created.alias("created_at"),
        created.alias("updated_at"),
    )


def api_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key per order: pending ones are revoked, urgent ones expire after a year."""
    created = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf_dir, "orders").select(
        _text("k-", F.col("o_orderkey")).alias("id"),
        _text("t-", F.col("o_custkey")).alias("tenant_id"),
        F.sha2(_text("key-", F.col("o_orderkey")), 256).alias("key_hash"),
        F.col("o_orderpriority").alias("name"),
        F.when(F.col("o_orderstatus") == "P", "revoked").otherwise("active").alias("status"),
        created.alias("created_at"),
        F.lit(None).cast("timestamp").alias("last_used_at"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.timestamp_add("DAY", F.lit(365), created)).alias("expires_at"),
    )


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A retention policy per customer; some tenants have a second one."""
    key = F.col("c_custkey")
    created = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return table(spark, sf_dir, "customer").select(
        _text("p-", key).alias("id"),
        F.when(key % 53 == 0, "t-1").otherwise(_text("t-", key)).alias("tenant_id"),
        F.col("c_nationkey").alias("retention_days"),
        (F.col("c_acctbal") > 0).alias("enabled"),
        created.alias("created_at"),
        created.alias("updated_at"),
    )


def key_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request per line item, carrying the key of its order; line 7 carries an unknown one."""
    number = F.col("l_orderkey") + F.when(F.col("l_linenumber") == 7, 100000000).otherwise(0)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", _text(" key-", number, "\t").alias("api_key")
    )


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = table(spark, sf_dir, "part").select("p_brand").distinct()
    return brands.select(_text("app-", F.col("p_brand")).alias("id"), F.col("p_brand").alias("name"))


def environments(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "part").select("p_type").distinct()
    return kinds.select(_text("env-", F.col("p_type")).alias("id"), F.lower("p_type").alias("name"))


def app_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        _text("s-", F.col("p_partkey")).alias("id"),
        _text("app-", F.col("p_brand")).alias("application_id"),
        _text("env-", F.col("p_type")).alias("environment_id"),
        F.col("p_name").alias("name"),
        F.timestamp_add("MINUTE", (F.col("p_partkey") % 100000).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("created_at"),
    )


def alert_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule per part over one of nine services, two of which never log."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        _text("r-", key).alias("id"),
        F.col("p_name").alias("name"),
        _text("svc-", key % 9).alias("service"),
        F.when(key % 2 == 0, "gt").otherwise("gte").alias("condition"),
        (F.col("p_size") % 5).cast("int").alias("threshold"),
        (F.col("p_size") * 30).cast("int").alias("window_minutes"),
        (key % 5 != 0).alias("enabled"),
    )


def saved_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        _text("q-", F.col("s_suppkey")).alias("id"),
        F.col("s_name").alias("name"),
        _text('{"service":"svc-', F.col("s_suppkey") % 7, '","level":"error","q":"timeout","size":50}').alias("query"),
    )


#: Changes fall into this many groups that share no id and no unique value with each other.
CELLS = 199


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with what change batches are made of: ``seq``, ``op``, ``cell`` and the number of a row in that cell."""
    key, cell = F.col("o_orderkey"), F.col("o_custkey") % CELLS
    op = F.when(F.col("o_orderstatus") == "O", "create").when(F.col("o_orderstatus") == "F", "update").otherwise("delete")
    rows = table(spark, sf_dir, "orders").withColumns({"seq": key, "op": op, "cell": cell, "number": cell + CELLS * (key % 9)})
    return rows.withColumns({"created_at": F.lit(None).cast("timestamp"), "updated_at": F.lit(None).cast("timestamp")})


def tenant_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change per order: create, update or delete of a tenant; slugs are few, and some are those of old tenants."""
    key, other = F.col("seq"), F.col("cell") + CELLS * (F.col("seq") % 4)
    old = F.concat(F.lit("customer-"), F.lpad(other.cast("string"), 9, "0"))
    return _orders(spark, sf_dir).select(
        "seq", "op",
        _text("t-", F.col("number")).alias("id"),
        F.when(key % 41 == 0, "").otherwise(_text("Tenant ", key)).alias("name"),
        F.when(key % 11 == 0, old).otherwise(_text("slug-", F.col("cell"), "-", key % 5)).alias("slug"),
        F.when(key % 4 == 0, "suspended").otherwise("").alias("status"),
        "created_at", "updated_at",
    )


def service_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change per order: create, update or delete of a service of one of two tenants."""
    key = F.col("seq")
    return _orders(spark, sf_dir).select(
        "seq", "op",
        _text("s-", F.col("number")).alias("id"),
        F.when(key % 37 == 0, " ").otherwise(_text("t-", F.col("cell") + CELLS * (key % 2))).alias("tenant_id"),
        _text("svc-", key % 3).alias("name"),
        "created_at", "updated_at",
    )


def policy_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change per order: create, update or delete of a tenant's retention policy."""
    key = F.col("seq")
    return _orders(spark, sf_dir).select(
        "seq", "op",
        _text("p-", key).alias("id"),
        _text("t-", F.col("number")).alias("tenant_id"),
        (key % 40).cast("int").alias("retention_days"),
        (key % 3 == 0).alias("enabled"),
        "created_at", "updated_at",
    )


def single_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policies with the tenant that each id names, so none has two."""
    return policies(spark, sf_dir).withColumn("tenant_id", F.concat(F.lit("t-"), F.expr("substr(id, 3)")))


def key_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change per order: create, touch, delete or revoke of a key; hashes are few, and many are those of old keys."""
    key, cell = F.col("seq"), F.col("cell")
    turn = F.floor(key / 3) % 4
    rows = _orders(spark, sf_dir).withColumn("op", F.when(turn == 0, "create").when(turn == 1, "touch").when(turn == 2, "delete").otherwise("revoke"))
    return rows.select(
        "seq", "op",
        _text("k-", F.col("number")).alias("id"),
        _text("t-", cell).alias("tenant_id"),
        F.sha2(_text("key-", cell + CELLS * (key % 11)), 256).alias("key_hash"),
        F.when(key % 43 == 0, "").otherwise(F.col("o_orderpriority")).alias("name"),
        F.lit("").alias("status"),
        "created_at",
        F.col("o_orderdate").cast("timestamp").alias("last_used_at"),
        F.lit(None).cast("timestamp").alias("expires_at"),
    )


# ----------------------------------------------------------------- telemetry


def request_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request per line item; ``run`` is the line number."""
    flag, state = F.col("l_returnflag"), F.col("l_linestatus")
    code = F.when(flag == "A", 202).when(flag == "R", F.when(state == "F", 400).otherwise(503)).otherwise(F.when(state == "F", 202).otherwise(0))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("run"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        (F.round(F.col("l_extendedprice") * 100).cast("long") * 100).alias("latency_ns"),
        code.alias("status_code"),
        ((flag == "N") & (state == "O")).alias("failed"),
    )


def counter_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scrape per event.  Counters rise with the event number and restart every 5000."""
    odd = F.col("user_id") % 2 == 1
    kind = F.col("event_type")
    status = F.when(F.col("user_id") % 5 == 0, "failure").otherwise("success")

    def labels(**pairs):
        return F.create_map(*[c for k, v in pairs.items() for c in (F.lit(k), F.lit(v) if isinstance(v, str) else v)])

    series = [
        ("click", False, "http_requests_total", labels(service="ingestor", code="202")),
        ("click", True, "http_requests_total", labels(service="analytics", code="200")),
        ("error", False, "http_errors_total", labels(service="ingestor", error_code="VALIDATION_ERROR")),
        ("error", True, "kafka_dlq_messages_total", labels(topic="app-logs-dlq")),
        ("view", False, "kafka_messages_consumed_total", labels(topic="app-logs", consumer_group="log-processors")),
        ("view", True, "kafka_consumer_lag", labels(topic="app-logs", partition=(F.col("user_id") % 3).cast("string"))),
        ("purchase", False, "bulk_documents_total", labels(status=status)),
        ("purchase", True, "bulk_batches_total", labels(status=status)),
        ("signup", False, "elasticsearch_indexing_total", labels(mode="bulk", status=status)),
        ("signup", True, "redis_operations_total", labels(operation="record_batch", status=status)),
    ]
    metric, tags = F.lit(None).cast("string"), F.lit(None).cast("map<string,string>")
    for event_type, is_odd, name, value in series:
        here = (kind == event_type) & (odd if is_odd else ~odd)
        metric, tags = F.when(here, name).otherwise(metric), F.when(here, value).otherwise(tags)
    return table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("ts"),
        metric.alias("metric"),
        tags.alias("labels"),
        (F.col("event_id") % 5000).cast("double").alias("value"),
    )


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations in seconds by metric and service, with the hour they fall into."""
    return table(spark, sf_dir, "events").select(
        F.when(F.col("user_id") % 2 == 1, "analytics").otherwise("ingestor").alias("service"),
        F.when(F.col("event_type") == "click", "http_request_duration_seconds").otherwise("bulk_batch_duration_seconds").alias("metric"),
        F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour"),
        (F.col("value") / 100).alias("seconds"),
    )


def bucket_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly scrapes of cumulative duration buckets of two services, with the bounds of the HTTP histogram."""
    from pyspark.sql import Window

    from tidelog.operators import telemetry

    hourly = telemetry.histogram_buckets(durations(spark, sf_dir), ["metric", "service", "hour"], "seconds", telemetry.HTTP_SECONDS)
    # One row per metric, service, bound and hour, so the running sum is small.
    so_far = Window.partitionBy("metric", "service", "le").orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    return hourly.select(
        F.col("hour").alias("ts"),
        "metric",
        F.create_map(F.lit("service"), F.col("service")).alias("labels"),
        "le",
        F.sum("bucket_count").over(so_far).cast("double").alias("value"),
    )


def offset_observations(raw: DataFrame, as_of) -> DataFrame:
    """Latest and committed offset as seen at each record; the last day is not committed yet."""
    done = F.col("timestamp") < as_of - F.expr("INTERVAL 1 DAY")
    return raw.select(
        "topic", "partition", (F.col("offset") + 1).alias("latest"),
        F.when(done, F.col("offset") + 1).otherwise(F.lit(0)).alias("committed"),
    )
