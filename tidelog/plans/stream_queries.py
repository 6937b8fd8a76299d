"""Registered queries: what the streaming side leaves behind.

The stream reads the raw zone a few files at a time until it is drained; its
tables must equal what batch SQL says about all records at once.
"""

from pyspark.sql import functions as F

from tidelog.operators import rollups as RU
from tidelog.operators import windows as WI
from tidelog.plans import zones
from tidelog.plans.derive_sql import CLASSIFIED, DOCUMENTS, rfc3339, with_tables
from tidelog.plans.ingest_queries import COUNTERS_SQL, DLQ_SQL
from tidelog.plans.metric_queries import BUSY_ISLANDS
from tidelog.plans.registry import day, query, stamp
from tidelog.sources import log_store, raw_events
from tidelog.streaming import ingest_stream as ST
from tidelog.streaming import live_errors as LE

_DOCS_SQL = with_tables(DOCUMENTS, f"""
SELECT doc_id, tenant_id, service, level, ip, {rfc3339('ingested_at')} AS ingested_at, strftime(event_date, '%Y-%m-%d') AS event_date
FROM documents_now""")
_COUNTERS = with_tables(CLASSIFIED + f", counters AS ({COUNTERS_SQL})", "SELECT * FROM counters")


def _docs(df):
    return df.select("doc_id", "tenant_id", "service", "level", "ip", stamp("ingested_at"), day("event_date"))


@query("stream_pipeline", _DOCS_SQL)
@query("stream_ingest", _DOCS_SQL)
def stream_ingest(spark, sf):
    return _docs(log_store.read_documents(spark, zones.streamed_root(spark, sf)))


@query("stream_dlq", DLQ_SQL)
def stream_dlq(spark, sf):
    return log_store.read_dlq(spark, zones.streamed_root(spark, sf)).withColumn("arrived_at", stamp("arrived_at"))


@query("stream_counters", _COUNTERS)
def stream_counters(spark, sf):
    return log_store.read_counters(spark, zones.streamed_root(spark, sf))


@query("stream_boards", with_tables(CLASSIFIED, """
SELECT service, count(*) AS count FROM accepted WHERE tenant_id = 'tenant-b' GROUP BY ALL ORDER BY count DESC, service DESC LIMIT 3"""))
def stream_boards(spark, sf):
    counters = log_store.read_counters(spark, zones.streamed_root(spark, sf))
    return log_store.board_services(counters, "tenant-b", 3)


_BUSY_IDLE = with_tables(DOCUMENTS + BUSY_ISLANDS, "SELECT tenant_id, service, errors FROM idle")


@query("stream_idle_errors", _BUSY_IDLE)
def stream_idle_errors(spark, sf):
    ticks = log_store.read_ticks(spark, zones.streamed_root(spark, sf))
    return WI.errors_idle_5m(ticks.where(F.col("last_ts") < zones.busy_clock(spark, sf)), zones.busy_clock(spark, sf))


@query("stream_live_errors", _BUSY_IDLE)
def stream_live_errors(spark, sf):
    # The records that had arrived by then, through the keyed counter, in several batches.
    root, now = zones.scratch(spark, sf, "live-errors"), spark.range(1).select(zones.busy_clock(spark, sf).alias("now")).first()["now"]
    if root not in zones._written:
        ordered = zones.scratch(spark, sf, "raw-by-time")
        zones.raw_zone(spark, sf).repartitionByRange(3, "timestamp").write.mode("overwrite").parquet(ordered)
        raw = raw_events.stream_raw_files(spark, ordered, max_files_per_trigger=1).where(F.col("timestamp") < F.lit(now))
        ST.drain(LE.start_live_errors(raw, root, root + "-checkpoint", interval=None))
        zones._written.add(root)
    return LE.read_live_errors(spark, root, F.lit(now))


@query("stream_unique_ips", with_tables(CLASSIFIED, """
SELECT tenant_id, strftime(ingested_at, '%Y-%m-%d') AS day, count(DISTINCT ip) AS unique_ips FROM accepted WHERE ip IS NOT NULL GROUP BY ALL"""))
def stream_unique_ips(spark, sf):
    members = log_store.read_ip_members(spark, zones.streamed_root(spark, sf))
    return members.groupBy("tenant_id", day("day")).agg(F.count(F.lit(1)).alias("unique_ips"))


@query("stream_recent_errors", with_tables(CLASSIFIED, """
SELECT tenant_id, service, value AS payload, position FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, service ORDER BY ingested_at DESC, "partition" DESC, "offset" DESC) AS position
  FROM accepted WHERE level IN ('ERROR', 'FATAL')) WHERE position <= 100"""))
def stream_recent_errors(spark, sf):
    kept = log_store.read_recent(spark, zones.streamed_root(spark, sf))
    return kept.select("tenant_id", "service", "payload", "position")


@query("stream_late_data", with_tables(CLASSIFIED, """
SELECT strftime(event_date, '%Y-%m-%d') AS event_date, count(*) AS messages FROM accepted GROUP BY ALL"""))
def stream_late_data(spark, sf):
    # The files hold all days in any order, so most batches bring old events.
    stored = log_store.read_messages(spark, zones.streamed_root(spark, sf))
    return stored.groupBy(day("event_date")).agg(F.count(F.lit(1)).alias("messages"))


@query("stream_trigger", with_tables(CLASSIFIED, "SELECT count(*) AS messages, true AS several_batches FROM accepted"))
def stream_trigger(spark, sf):
    root = zones.scratch(spark, sf, "triggered")
    raw = raw_events.stream_raw_files(spark, zones.raw_zone_path(spark, sf), max_files_per_trigger=zones.files_per_batch(spark, sf))
    query_ = ST.start_ingest(raw, root, root + "-checkpoint", flush_interval=ST.FLUSH_INTERVAL)
    try:
        query_.processAllAvailable()
    finally:
        query_.stop()
    stored = log_store.read_messages(spark, root)
    return stored.agg(F.count(F.lit(1)).alias("messages"), (F.count_distinct("batch_id") > 1).alias("several_batches"))


@query("stream_running_counts", with_tables(CLASSIFIED, """
SELECT tenant_id, service, level, count(*) AS logs FROM accepted GROUP BY ALL"""))
def stream_running_counts(spark, sf):
    root = zones.scratch(spark, sf, "running")
    raw = raw_events.stream_raw_files(spark, zones.raw_zone_path(spark, sf), max_files_per_trigger=zones.files_per_batch(spark, sf))

    def replace(batch, _batch_id):
        # Complete mode hands over the whole result, one row per key.
        batch.write.mode("overwrite").parquet(root)

    ST.drain(
        ST.stream_counts(raw).writeStream.outputMode("complete").foreachBatch(replace)
        .option("checkpointLocation", root + "-checkpoint").trigger(availableNow=True).start()
    )
    return spark.read.schema("tenant_id string, service string, level string, logs long").parquet(root)


@query("stream_idempotent_replay", _DOCS_SQL)
def stream_idempotent_replay(spark, sf):
    root = zones.scratch(spark, sf, "replayed")
    raw = zones.raw_zone(spark, sf)
    log_store.process_batch(raw, root, batch_id=0)
    log_store.process_batch(raw, root, batch_id=0)
    return _docs(log_store.read_documents(spark, root))


@query("stream_replay_counters", _COUNTERS)
def stream_replay_counters(spark, sf):
    root = zones.scratch(spark, sf, "replayed-counters")
    raw = zones.raw_zone(spark, sf)
    log_store.process_batch(raw, root, batch_id=5)
    log_store.process_batch(raw, root, batch_id=5)
    return log_store.read_counters(spark, root)


# Every event sent again in a later batch: the same documents, twice the counts.
@query("sink_log_store", with_tables(DOCUMENTS, """
SELECT tenant_id, service, count(*) AS documents,
  (SELECT 2 * count(*) FROM accepted a WHERE a.tenant_id = d.tenant_id AND a.service = d.service) AS counted
FROM documents_now d GROUP BY tenant_id, service"""))
def sink_log_store(spark, sf):
    root = zones.scratch(spark, sf, "sent-twice")
    raw = zones.raw_zone(spark, sf)
    log_store.process_batch(raw, root, batch_id=0)
    log_store.process_batch(raw, root, batch_id=1)
    documents = RU.logs_by_service(log_store.read_documents(spark, root)).withColumnRenamed("logs", "documents")
    counted = log_store.read_counters(spark, root).where(F.col("metric") == "logs_service")
    counted = counted.select("tenant_id", F.col("dim").alias("service"), F.col("value").alias("counted"))
    return documents.join(counted, ["tenant_id", "service"])


@query("rebuild_views", _COUNTERS)
def rebuild_views(spark, sf):
    root = zones.scratch(spark, sf, "rebuilt")
    ST.rebuild_views(zones.raw_zone(spark, sf), root, staging=root + "-staging")
    return log_store.read_counters(spark, root)


# The streamed batches merged into one, plus one more batch behind them.
@query("compact_store", with_tables(CLASSIFIED + f", counters AS ({COUNTERS_SQL})", "SELECT tenant_id, metric, dim, 2 * value AS value FROM counters"))
def compact_store(spark, sf):
    root, target = zones.streamed_root(spark, sf), zones.scratch(spark, sf, "merged")
    last = log_store.read_messages(spark, root).agg(F.max("batch_id")).first()[0]
    log_store.compact_store(spark, root, target, last)
    log_store.process_batch(zones.raw_zone(spark, sf), target, batch_id=last + 1)
    return log_store.read_counters(spark, target)


def _merged_root(spark, sf):
    """A store whose first batches were merged while its ingest query was running."""
    root = zones.scratch(spark, sf, "merged-online")
    if root not in zones._written:
        raw = raw_events.stream_raw_files(spark, zones.raw_zone_path(spark, sf), max_files_per_trigger=zones.files_per_batch(spark, sf))
        running = ST.start_ingest(raw, root, root + "-checkpoint")
        try:
            while (closed := log_store.closed_batch(spark, root + "-checkpoint")) is None:
                running.awaitTermination(0.2)
            log_store.merge_batches(spark, root, closed)
            running.processAllAvailable()
        finally:
            running.stop()
        log_store.merge_batches(spark, root, log_store.closed_batch(spark, root + "-checkpoint"))
        log_store.remove_merged(spark, root)
        zones._written.add(root)
    return root


@query("online_merge", _DOCS_SQL)
def online_merge(spark, sf):
    return _docs(log_store.read_documents(spark, _merged_root(spark, sf)))


@query("online_merge_counters", _COUNTERS)
def online_merge_counters(spark, sf):
    return log_store.read_counters(spark, _merged_root(spark, sf))


@query("online_merge_files", with_tables(CLASSIFIED, """
SELECT strftime(event_date, '%Y-%m-%d') AS event_date, true AS one_batch FROM accepted GROUP BY ALL"""))
def online_merge_files(spark, sf):
    root = _merged_root(spark, sf)
    batches = F.count_distinct(F.regexp_extract("path", r"/batch_id=([0-9]+)/", 1))
    return log_store.store_files(spark, root).groupBy(day("event_date")).agg((batches == 1).alias("one_batch"))
