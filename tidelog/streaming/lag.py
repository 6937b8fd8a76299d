"""Lag of running queries, written down as they report progress.

A listener turns every progress report into observations ``(observed_at, query, topic,
partition, latest, committed)``: how far the source has got and how far the query.
They are appended as one small JSON file per report below a shared folder, so the lag can
be asked for while the query runs and after it has ended, per partition and in all.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tidelog.operators.telemetry import consumer_lag, lag_with_total

OBSERVATIONS = "observed_at timestamp, query string, topic string, partition int, latest long, committed long"


def observations(progress: dict) -> list[dict]:
    """The observations of one progress report.

    Offsets by topic and partition are taken as they are.  A source with a single log
    of offsets (files, rates) is one partition of the topic its description names; where it
    does not report its latest offset, it has none beyond the one that was read.
    """
    out = []

    def offsets(value) -> dict | None:
        value = json.loads(value) if isinstance(value, str) else value
        return None if value is None else value if isinstance(value, dict) else {"logOffset": value}

    for source in progress["sources"]:
        read, latest = offsets(source.get("endOffset")), offsets(source.get("latestOffset"))
        if read is None:
            continue
        flat = {(source["description"], 0): read["logOffset"] + 1} if "logOffset" in read else {(t, int(p)): n for t, ps in read.items() for p, n in ps.items()}
        ahead = flat if latest is None else {(source["description"], 0): latest["logOffset"] + 1} if "logOffset" in latest else {(t, int(p)): n for t, ps in latest.items() for p, n in ps.items()}
        for topic, partition in sorted(set(flat) | set(ahead)):
            committed = flat.get((topic, partition), 0)
            out.append({
                "observed_at": progress["timestamp"], "query": progress.get("name") or progress["id"], "topic": topic, "partition": partition,
                "latest": max(ahead.get((topic, partition), 0), committed), "committed": committed,
            })
    return out


class LagObserver(StreamingQueryListener):
    """Register with ``spark.streams.addListener``; observations go below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        rows = observations(json.loads(event.progress.json))
        if rows:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{uuid.uuid4().hex}.json")
            out = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, False)
            out.write(bytearray("\n".join(map(json.dumps, rows)).encode()))
            out.close()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def read_observations(spark: SparkSession, root: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], OBSERVATIONS)
    return spark.read.schema(OBSERVATIONS).json(root)


def running_lag(seen: DataFrame, query: str | None = None) -> DataFrame:
    """``topic, partition, lag`` from the newest observation of each partition, and a total per topic with a null partition.

    Queries that read the same topic count as one consumer group; name one to look at it alone.
    """
    if query is not None:
        seen = seen.where(F.col("query") == query)
    newest = seen.groupBy("query", "topic", "partition").agg(F.max_by(F.struct("latest", "committed"), F.struct("observed_at", "committed")).alias("o"))
    return lag_with_total(consumer_lag(newest.select("topic", "partition", "o.latest", "o.committed")))
