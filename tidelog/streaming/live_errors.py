"""The idle error counter as keyed state of a running query.

Each tenant and service has one small value: the size of its current run of errors
and when that began and last went on.  An error within five minutes of it prolongs
it, a later one begins a new run, whatever the age of the event and without a watermark, so
nothing is dropped.  A timer on processing time reports the counter as zero once five
minutes have gone by without an error; the value itself is kept, as arrivals that
are read late (after a restart) still decide by their own times whether the run went on.
State is one row per key, bounded by the number of services.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.window import Window

from tidelog.functions.text import is_error
from tidelog.functions.times import as_timestamp
from tidelog.operators import ingest
from tidelog.operators.windows import IDLE_SECONDS

STATE = "errors long, first_us long, last_us long"
OUTPUT = "tenant_id string, service string, errors long, last_us long"
_IDLE_US = IDLE_SECONDS * 1_000_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prolonged(run: tuple[int, int, int] | None, ticks: list[tuple[int, int, int]], idle_us: int = _IDLE_US) -> tuple[int, int, int]:
    """``(errors, first, last)`` of the last run after more ``(first, last, errors)`` without a gap inside, in microseconds.

    Ticks are taken in order of time.  One before the run, further off than the idle time, belongs to an older run and is left out.
    """
    for first, last, errors in sorted(ticks):
        if run is None or first - run[2] > idle_us:
            run = (errors, first, last)
        elif run[1] - last <= idle_us:
            run = (run[0] + errors, min(run[1], first), max(run[2], last))
    return run


class IdleCounter(StatefulProcessor):
    def __init__(self, idle_seconds: int = IDLE_SECONDS):
        self.idle_seconds = idle_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ticks = [t for part in rows for t in zip(part["first_us"].tolist(), part["last_us"].tolist(), part["errors"].tolist(), strict=True)]
        held = self.run.get() if self.run.exists() else None
        errors, first, last = prolonged(None if held is None else tuple(held), ticks, self.idle_seconds * 1_000_000)
        self.run.update((errors, first, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(timerValues.getCurrentProcessingTimeInMs(), last // 1000) + self.idle_seconds * 1000)
        yield pd.DataFrame({"tenant_id": [key[0]], "service": [key[1]], "errors": [errors], "last_us": [last]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, _, last = self.run.get()
        yield pd.DataFrame({"tenant_id": [key[0]], "service": [key[1]], "errors": [0], "last_us": [last]})

    def close(self) -> None:
        pass


def live_errors(raw: DataFrame, idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """Updates of the counters ``(tenant_id, service, errors, last_us)`` from raw records; an error is one small row."""
    errors = ingest.accepted(raw).where(is_error(F.col("level")))
    at = F.unix_micros("ingested_at")
    ticks = errors.select("tenant_id", "service", at.alias("first_us"), at.alias("last_us"), F.lit(1).cast("long").alias("errors"))
    return ticks.groupBy("tenant_id", "service").transformWithStateInPandas(IdleCounter(idle_seconds), OUTPUT, "Update", "ProcessingTime")


def start_live_errors(raw: DataFrame, root: str, checkpoint: str, interval: str | None = "1 second", idle_seconds: int = IDLE_SECONDS) -> StreamingQuery:
    """Keep the updates of every batch below ``root``; a batch that is run again replaces its own.

    ``interval=None`` drains what is there and stops; timers then wait for the next start.
    """
    settings = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": str(interval is not None).lower()}
    spark = raw.sparkSession
    before = {name: spark.conf.get(name, None) for name in settings}

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch_id={batch_id}")

    writer = live_errors(raw, idle_seconds).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:  # a query keeps the settings it was started with
        return (writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)).start()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def read_live_errors(spark, root: str, as_of: Column | str | dt.datetime) -> DataFrame:
    """``tenant_id, service, errors``: the counters as they are at ``as_of``, 0 once five minutes have passed."""
    updates = spark.read.schema(OUTPUT + ", batch_id long").parquet(root)
    newest = Window.partitionBy("tenant_id", "service").orderBy(F.desc("batch_id"), F.asc("errors"))
    latest = updates.where("errors > 0").withColumn("_n", F.row_number().over(newest)).where("_n = 1")
    alive = F.unix_micros(as_timestamp(as_of)) - F.col("last_us") <= _IDLE_US
    return latest.select("tenant_id", "service", F.when(alive, F.col("errors")).otherwise(F.lit(0)).alias("errors"))
