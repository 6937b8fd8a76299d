"""The event stream: a Kafka topic, or files that carry the same envelope."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.operators.ingest import TOPIC
from tidelog.schemas import RAW_EVENT

# Group and start position of the processor (fixed values).
CONSUMER_GROUP = "log-processors"
STARTING_OFFSETS = "earliest"


def read_raw_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW_EVENT).parquet(path)


def stream_raw_files(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(RAW_EVENT)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def _kafka_options(brokers: str, topic: str) -> dict[str, str]:
    if not brokers.strip() or not topic.strip():
        raise ValueError("brokers and topic cannot be empty")
    return {
        "kafka.bootstrap.servers": brokers,
        "subscribe": topic,
        "startingOffsets": STARTING_OFFSETS,
        "kafka.group.id": CONSUMER_GROUP,
    }


def _envelope(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("key").cast("string"), F.col("value").cast("string"), "topic", "partition", "offset", "timestamp"
    )


def read_raw_kafka(spark: SparkSession, brokers: str, topic: str = TOPIC) -> DataFrame:
    """Needs the Kafka connector package on the class path."""
    return _envelope(spark.read.format("kafka").options(**_kafka_options(brokers, topic)).load())


def stream_raw_kafka(
    spark: SparkSession, brokers: str, topic: str = TOPIC, max_offsets_per_trigger: int | None = None
) -> DataFrame:
    """Needs the Kafka connector package on the class path.

    ``max_offsets_per_trigger`` caps the records of a micro-batch (200 is the
    classic flush size; a cluster wants far more).  Executors read the topic
    partitions; offsets are kept in the query's
    checkpoint and move only after a micro-batch has been written.
    """
    reader = spark.readStream.format("kafka").options(**_kafka_options(brokers, topic))
    if max_offsets_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets_per_trigger)
    return _envelope(reader.load())


def write_raw_files(raw: DataFrame, path: str, files: int | None = None) -> None:
    """Lay the stream down as files; ``files`` splits a small input for parallel reads."""
    columns = [f.name for f in RAW_EVENT.fields]
    out = raw.select(*columns)
    if files:
        out = out.repartition(files, "partition", "offset")
    out.write.mode("overwrite").parquet(path)


def publish_files(records: DataFrame, path: str) -> None:
    """Append published records; a Kafka write takes the same columns."""
    records.select("key", "value", "topic").write.mode("append").parquet(path)


def start_publish_files(records: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Publish a stream of records as files; without ``interval`` drain it and stop."""
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    writer = records.select("key", "value", "topic").writeStream.format("parquet").option("path", path)
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def publish_kafka(records: DataFrame, brokers: str) -> None:
    """The key decides the topic partition, so a trace stays in order."""
    records.select("key", "value", "topic").write.format("kafka").option("kafka.bootstrap.servers", brokers).save()
