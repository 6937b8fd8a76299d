"""Written inputs of the registered queries: the raw zone and the log store.

Both are laid down once per application and data folder under the shared
folder, the way a running system has them before anybody asks a question.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import windows
from tidelog.plans import derive
from tidelog.session import pin_utc, shared_dir
from tidelog.sources import log_store, raw_events
from tidelog.streaming import ingest_stream

_written: set[str] = set()


def scratch(spark: SparkSession, sf_dir: str, *parts: str) -> str:
    """A folder of this application for results derived from ``sf_dir``."""
    tag = hashlib.sha256(sf_dir.encode()).hexdigest()[:12]
    return shared_dir(spark, "tidelog", spark.sparkContext.applicationId, tag, *parts)


def raw_zone_path(spark: SparkSession, sf_dir: str) -> str:
    pin_utc(spark)
    path = scratch(spark, sf_dir, "raw")
    if path not in _written:
        raw = derive.raw_events(spark, sf_dir)
        cores = spark.sparkContext.defaultParallelism
        # A small input is one task; split it so that later reads run in parallel.
        small = raw.rdd.getNumPartitions() < cores
        raw_events.write_raw_files(raw, path, files=cores if small else None)
        _written.add(path)
    return path


def raw_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_events.read_raw_files(spark, raw_zone_path(spark, sf_dir))


def load_store(spark: SparkSession, sf_dir: str, root: str) -> None:
    """The whole raw zone into the store at ``root`` as one batch."""
    log_store.process_batch(raw_zone(spark, sf_dir), root, batch_id=0, staging=root + "-staging")


def store_root(spark: SparkSession, sf_dir: str) -> str:
    root = scratch(spark, sf_dir, "store")
    if root not in _written:
        load_store(spark, sf_dir, root)
        _written.add(root)
    return root


def files_per_batch(spark: SparkSession, sf_dir: str) -> int:
    """A third of the raw files, so that draining them takes several batches."""
    return max(1, len(raw_zone(spark, sf_dir).inputFiles()) // 3)


def streamed_root(spark: SparkSession, sf_dir: str) -> str:
    """The tables a drained ingest stream left behind."""
    root = scratch(spark, sf_dir, "streamed")
    if root not in _written:
        raw = raw_events.stream_raw_files(spark, raw_zone_path(spark, sf_dir), files_per_batch(spark, sf_dir))
        ingest_stream.drain(ingest_stream.start_ingest(raw, root, root + "-checkpoint", flush_interval=None))
        _written.add(root)
    return root


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted messages as stored, repeated ids included."""
    return log_store.read_messages(spark, store_root(spark, sf_dir))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_store.read_documents(spark, store_root(spark, sf_dir))


def clock(spark: SparkSession, sf_dir: str) -> Column:
    """The latest arrival, as a scalar subquery that prunes to one column."""
    return raw_zone(spark, sf_dir).agg(F.max("timestamp")).scalar()


def busy_clock(spark: SparkSession, sf_dir: str) -> Column:
    """The end of the five minutes with most errors, the latest of equal ones."""
    ticks = log_store.read_ticks(spark, store_root(spark, sf_dir))
    per = ticks.groupBy("bucket").agg(F.sum("errors").alias("n")).orderBy(F.desc("n"), F.desc("bucket"))
    return per.limit(1).select(F.timestamp_micros((F.col("bucket") + 1) * (windows.IDLE_SECONDS * 1_000_000))).scalar()
