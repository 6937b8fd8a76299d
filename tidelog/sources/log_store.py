"""The day-partitioned document store, metric parts and dead letters.

Layout under one root::

    docs/event_date=2024-01-01/batch_id=7/   accepted messages
    counters/batch_id=7/                     partial counters
    board/batch_id=7/                        partial error board
    ips/batch_id=7/                          members of the daily address sets
    ticks/batch_id=7/                        errors per five-minute bucket
    recent/batch_id=7/                       newest error payloads of the batch
    dlq/batch_id=7/                          rejects
    staging/batch_id=7/                      parsed records, only while the batch is written
    merged/0-7-.../                          the same tables, batches 0 to 7 as one
    merge_log/                               which merges count, see ``merges``

Every table is addressed by the batch, so writing a batch again replaces its
own files and nothing else.  Readers merge the parts.  Days are the outer
level, so dropping a day is dropping one folder; metric tables are not touched.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.text import is_error
from tidelog.operators import ingest, rollups, windows
from tidelog.operators.windows import keep_last_document
from tidelog.schemas import DLQ, DOCUMENT
from tidelog.sources import merges

DOCS, COUNTERS, BOARD, IPS, TICKS, RECENT, DEAD = "docs", "counters", "board", "ips", "ticks", "recent", "dlq"
STAGING = "staging"
#: Bytes of a staged row group: what a task reads can be cut there, however few the raw files are.
ROW_GROUP = 32 << 20

_BATCH = T.StructField("batch_id", T.LongType())

DOCS_SCHEMA = T.StructType([*DOCUMENT.fields, _BATCH])
COUNTERS_SCHEMA = "tenant_id string, metric string, dim string, value long, batch_id long"
IPS_SCHEMA = "tenant_id string, day date, ip string, last_seen timestamp, batch_id long"
TICKS_SCHEMA = (
    "tenant_id string, service string, bucket long, first_ts timestamp, last_ts timestamp, errors long, batch_id long"
)
RECENT_SCHEMA = (
    "tenant_id string, service string, ingested_at timestamp, partition int, offset long, payload string, batch_id long"
)
DEAD_SCHEMA = T.StructType(
    [
        *DLQ.fields,
        T.StructField("topic", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("arrived_at", T.TimestampType()),
        _BATCH,
    ]
)


# ------------------------------------------------------------------ writing


def write_documents(accepted: DataFrame, root: str, batch_id: int) -> None:
    """Accepted messages into their days.

    ``rebalance`` lets adaptive execution split a hot day and merge small ones,
    so neither one huge file nor many tiny ones come out.
    """
    columns = [f.name for f in DOCUMENT.fields]
    (
        accepted.select(*columns)
        .withColumn("batch_id", F.lit(batch_id).cast("long"))
        .hint("rebalance", F.col("event_date"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("event_date", "batch_id")
        .parquet(f"{root}/{DOCS}")
    )


def _write_part(rows: DataFrame, root: str, table: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{root}/{table}/batch_id={batch_id}")


def _metric_parts(accepted: DataFrame) -> dict[str, DataFrame]:
    """Partial aggregates of one batch; all are combined on the map side."""
    newest = windows.recent_errors(accepted, payload="value").drop("position")
    return {
        COUNTERS: rollups.service_counters(accepted),
        BOARD: rollups.error_board(accepted),
        IPS: rollups.unique_ips(accepted),
        TICKS: windows.error_ticks(accepted),
        RECENT: newest.withColumnRenamed("value", "payload"),
    }


def process_batch(
    raw: DataFrame, root: str, batch_id: int, processor_id: str | None = None, staging: str | None = None
) -> None:
    """One batch: documents first, then metrics and dead letters side by side.

    Records are parsed once, into ``staging``, a folder of the batch below ``root`` unless
    one is named.  There they outlive any executor, each table reads its own columns only, and
    a large batch is read in more tasks instead of larger ones.  An exception leaves the batch to
    be run again as a whole, which replaces whatever it had written.
    """
    rows = ingest.classify(raw)
    # Only rejects and error payloads need the original text any further.
    needed = F.col("reject_reason").isNotNull() | is_error(F.col("level"))
    rows = rows.withColumn("value", F.when(needed, F.col("value")))
    spark, folder = raw.sparkSession, staging or f"{root}/{STAGING}/batch_id={batch_id}"
    rows.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(folder)
    try:
        _write_batch(spark.read.schema(rows.schema).parquet(folder), root, batch_id, processor_id)
    finally:
        if not staging:
            merges.delete(spark, [folder])


def _write_batch(rows: DataFrame, root: str, batch_id: int, processor_id: str | None) -> None:
    accepted = rows.where(F.col("reject_reason").isNull())
    rejects = rows.where(F.col("reject_reason").isNotNull())
    write_documents(accepted, root, batch_id)
    parts = {**_metric_parts(accepted), DEAD: ingest.dlq_envelope(rejects, processor_id=processor_id)}
    # The parts are small, independent jobs; run one after another they would
    # leave most of the cluster idle.
    target = inheritable_thread_target(rows.sparkSession)(_write_part)
    with ThreadPoolExecutor(max_workers=len(parts)) as pool:
        for write in [pool.submit(target, part, root, table, batch_id) for table, part in parts.items()]:
            write.result()


# ------------------------------------------------------------------ reading


def read_messages(spark: SparkSession, root: str) -> DataFrame:
    """Every accepted message as written, repeated ids included."""
    return _read_parts(spark, root, DOCS, DOCS_SCHEMA)


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """The store as a reader sees it: the last arrival of each id."""
    return keep_last_document(read_messages(spark, root))


def _read_parts(spark: SparkSession, root: str, table: str, schema) -> DataFrame:
    """The parts of a table; one that was never written is empty.

    Batches that were merged are read from where the merge put them; their own folders are pruned.
    """
    log = merges.read_log(spark, root)
    empty = spark.createDataFrame([], schema)
    parts = spark.read.schema(schema).parquet(f"{root}/{table}") if _exists(spark, f"{root}/{table}") else empty
    for merge in log:
        parts = parts.where(~F.col("batch_id").between(merge.first, merge.last))
    for merge in log:
        if _exists(spark, f"{merge.folder}/{table}"):
            parts = parts.unionByName(spark.read.schema(schema).parquet(f"{merge.folder}/{table}"))
    return parts


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def read_service_counters(spark: SparkSession, root: str) -> DataFrame:
    """Merged counters without the error board: a few rows per service."""
    return rollups.merge_counters(_read_parts(spark, root, COUNTERS, COUNTERS_SCHEMA))


def read_error_board(spark: SparkSession, root: str) -> DataFrame:
    return rollups.merge_counters(_read_parts(spark, root, BOARD, COUNTERS_SCHEMA))


def read_counters(spark: SparkSession, root: str) -> DataFrame:
    return read_service_counters(spark, root).unionByName(read_error_board(spark, root))


def read_ip_members(spark: SparkSession, root: str) -> DataFrame:
    return rollups.merge_ips(_read_parts(spark, root, IPS, IPS_SCHEMA))


def read_ticks(spark: SparkSession, root: str) -> DataFrame:
    return windows.merge_ticks(_read_parts(spark, root, TICKS, TICKS_SCHEMA))


def read_recent(spark: SparkSession, root: str) -> DataFrame:
    parts = _read_parts(spark, root, RECENT, RECENT_SCHEMA).drop("batch_id")
    return windows.newest_payloads(parts, windows.RECENT_KEPT)


def read_dlq(spark: SparkSession, root: str) -> DataFrame:
    return _read_parts(spark, root, DEAD, DEAD_SCHEMA).drop("batch_id")


def store_files(spark: SparkSession, root: str) -> DataFrame:
    """One row per data file with day, size and time; contents are not read.  Files of merged batches are left out."""
    log = merges.read_log(spark, root)
    found = None
    for docs, merged in [(f"{root}/{DOCS}", False), *[(f"{m.folder}/{DOCS}", True) for m in log]]:
        if not _exists(spark, docs):
            continue
        listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(docs)
        # From the path, because an emptied store has no partitions to find the day in.
        named = F.regexp_extract("path", r"/event_date=([0-9-]+)/", 1).try_cast("date")
        batch = F.regexp_extract("path", r"/batch_id=([0-9]+)/", 1).try_cast("long")
        for m in [] if merged else log:
            listing = listing.where(~F.coalesce(batch.between(m.first, m.last), F.lit(False)))
        listing = listing.select(named.alias("event_date"), "path", "length", "modificationTime")
        found = listing if found is None else found.unionByName(listing)
    return spark.createDataFrame([], "event_date date, path string, length long, modificationTime timestamp") if found is None else found


def board_services(counters: DataFrame, tenant_id: str, n: int) -> DataFrame:
    """The service board from merged counters."""
    mine = counters.where((F.col("tenant_id") == tenant_id) & (F.col("metric") == "logs_service"))
    return (
        mine.select(F.col("dim").alias("service"), F.col("value").alias("count"))
        .orderBy(F.desc("count"), F.desc("service"))
        .limit(n)
    )


# --------------------------------------------------------------- compaction


def compact_days(spark: SparkSession, root: str, days: list[str], target: str, batch_id: int = 0) -> None:
    """Write settled days once more, one row per id, under ``target``.

    The result has the same layout with a single batch, so every reader works
    on it; the source is left alone.
    """
    docs = keep_last_document(read_messages(spark, root).where(F.col("event_date").isin(days)))
    write_documents(docs, target, batch_id)


def compact_store(spark: SparkSession, root: str, target: str, last_batch: int) -> None:
    """All tables up to ``last_batch`` merged into that one batch under ``target``.

    Stop the ingest query, compact, and start it again on ``target`` with its old
    checkpoint: it goes on with higher batch numbers, so nothing is overwritten.
    """
    done = F.col("batch_id") <= last_batch
    write_documents(keep_last_document(read_messages(spark, root).where(done)), target, last_batch)
    merged = {
        COUNTERS: rollups.merge_counters(_read_parts(spark, root, COUNTERS, COUNTERS_SCHEMA).where(done)),
        BOARD: rollups.merge_counters(_read_parts(spark, root, BOARD, COUNTERS_SCHEMA).where(done)),
        IPS: rollups.merge_ips(_read_parts(spark, root, IPS, IPS_SCHEMA).where(done)),
        TICKS: windows.merge_ticks(_read_parts(spark, root, TICKS, TICKS_SCHEMA).where(done)),
        RECENT: windows.newest_payloads(
            _read_parts(spark, root, RECENT, RECENT_SCHEMA).where(done).drop("batch_id"), windows.RECENT_KEPT
        ).drop("position"),
        DEAD: _read_parts(spark, root, DEAD, DEAD_SCHEMA).where(done).drop("batch_id"),
    }
    for table, rows in merged.items():
        _write_part(rows, target, table, last_batch)


# -------------------------------------------------------------- online merge

TABLES = [DOCS, COUNTERS, BOARD, IPS, TICKS, RECENT, DEAD]


def closed_batch(spark: SparkSession, checkpoint: str) -> int | None:
    """The last batch the ingest query has committed; later ones may still be written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return max((int(n) for n in names if n.isdigit()), default=None)


def merge_batches(spark: SparkSession, root: str, last_batch: int) -> merges.Merge:
    """All batches up to ``last_batch`` as one, while the ingest query goes on with later ones.

    ``last_batch`` has to be closed (see ``closed_batch``).  Earlier merges are taken into this one.
    Documents are written once per id and day, metric parts are summed, so the files per day do not
    grow with the number of batches.  Readers change over when the log has its line, at the very end.
    """
    folder = merges.new_folder(0, last_batch)
    target = f"{root}/{merges.MERGED}/{folder}"
    compact_store(spark, root, target, last_batch)
    merges.commit(spark, root, 0, last_batch, folder)
    return merges.Merge(0, last_batch, target)


def remove_merged(spark: SparkSession, root: str) -> list[str]:
    """Delete the folders that a merge has replaced; run it when readers from before the merge are done."""
    return merges.delete(spark, merges.superseded(spark, root, TABLES))


# ----------------------------------------------------------------- dropping


def drop_days(spark: SparkSession, root: str, days: list[str], dropped: list[str] | None = None) -> list[str]:
    """Remove whole day folders, merged ones too, through the Hadoop file system of the store.

    Days are appended to ``dropped`` as they go, so the caller has the list also when a delete fails.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    dropped = [] if dropped is None else dropped
    places = [f"{root}/{DOCS}", *[f"{m.folder}/{DOCS}" for m in merges.read_log(spark, root)]]
    for day in days:
        gone = False
        for place in places:
            path = hadoop(f"{place}/event_date={day}")
            fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
            gone = (fs.exists(path) and fs.delete(path, True)) or gone
        if gone:
            dropped.append(day)
    return dropped
