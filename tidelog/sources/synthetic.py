"""Seeded random logs, one per row of an id frame or per tick of a rate stream.

All draws of a row come from one SHA-256 of ``(seed, id)``, so the result does
not depend on partitioning and any engine can reproduce it.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.times import format_rfc3339

# Message templates by level, level cut points, and ranges (fixed values).
TEMPLATES = {
    "INFO": [
        "Request completed in %dms",
        "User session initiated for account_%d",
        "Payment processed successfully for order_%d",
        "Cache hit for key user_profile_%d",
        "Background reconciliation completed for batch_%d",
    ],
    "DEBUG": [
        "Executing query: SELECT * FROM items WHERE id = %d",
        "Cache miss for key session_%d",
        "HTTP 200 GET /api/v2/items/%d from upstream",
        "Parsing payload with size %d bytes",
    ],
    "WARN": [
        "Slow database query executed in %dms",
        "Rate limit threshold at 80%% for tenant_%d",
        "Retry attempt 2 for upstream service_%d",
        "Memory usage elevated at %d%%",
    ],
    "ERROR": [
        "DB connection timeout after %ds",
        "HTTP 500 from upstream payment gateway",
        "JWT validation failed for expired token",
        "Redis connection refused on host_%d",
        "Timeout waiting for lock on resource_%d",
    ],
    "FATAL": [
        "Process panic: unhandled nil pointer in worker_%d",
        "Critical database corruption detected in partition_%d",
        "OOM killed: heap allocation exceeded limit",
    ],
}
LEVEL_CUTS = [("INFO", 0.70), ("DEBUG", 0.85), ("WARN", 0.95), ("ERROR", 0.99), ("FATAL", 1.0)]
FATAL_SHARE = 0.2
MAX_NUMBER = 1000
IP_PREFIX = "192.168."
MAX_OCTET = 254
MIXED = "MIXED"


@dataclasses.dataclass(frozen=True)
class SyntheticConfig:
    services: tuple[str, ...] = ("payment-api", "auth-service", "order-service")
    level: str = MIXED
    error_rate: float = -1.0
    include_trace_id: bool = True
    include_ip: bool = True
    seed: int = 42

    def __post_init__(self):
        if not self.services:
            raise ValueError("at least one service is needed")
        if self.level != MIXED and self.level not in TEMPLATES:
            raise ValueError(f"unknown level {self.level!r}")
        if self.error_rate > 1:
            raise ValueError("error_rate is at most 1")


def _draw(slot: int) -> Column:
    """32 random bits, the ``slot``-th of eight in the row's digest."""
    return F.conv(F.substring("_digest", slot * 8 + 1, 8), 16, 10).cast("long")


def _below(slot: int, n: int) -> Column:
    return _draw(slot) % n


def _chance(slot: int, p: float) -> Column:
    return _draw(slot) < F.lit(int(p * 2**32))


def _pick(values: list[str] | tuple[str, ...], slot: int) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (_below(slot, len(values)) + 1).cast("int"))


def _level(cfg: SyntheticConfig) -> Column:
    if cfg.error_rate >= 0:
        bad = F.when(_chance(1, FATAL_SHARE), "FATAL").otherwise("ERROR")
        return F.when(_chance(0, cfg.error_rate), bad).otherwise("INFO")
    if cfg.level != MIXED:
        return F.lit(cfg.level)
    level = F.lit(LEVEL_CUTS[-1][0])
    for name, cut in reversed(LEVEL_CUTS[:-1]):
        level = F.when(_chance(0, cut), name).otherwise(level)
    return level


def _message() -> Column:
    text = F.lit(None).cast("string")
    for level, templates in TEMPLATES.items():
        text = F.when(F.col("level") == level, _pick(templates, 3)).otherwise(text)
    number = (_below(4, MAX_NUMBER) + 1).cast("string")
    return F.replace(F.replace(text, F.lit("%d"), number), F.lit("%%"), F.lit("%"))


def synthetic_logs(ids: DataFrame, cfg: SyntheticConfig, id_col: str = "id", ts_col: str = "ts") -> DataFrame:
    """A log event for every row of ``ids``, stamped with its ``ts_col``."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(cfg.seed)), F.col(id_col).cast("string")), 256)
    rows = ids.select(F.col(id_col).alias("id"), F.col(ts_col).cast("timestamp").alias("ts"), digest.alias("_digest"))
    rows = rows.withColumn("level", _level(cfg))
    none = F.lit(None).cast("string")
    trace = F.concat(F.lit("trace-"), F.substring("_digest", 49, 16)) if cfg.include_trace_id else none
    octet = [(_below(slot, MAX_OCTET) + 1).cast("string") for slot in (5, 1)]
    ip = F.concat(F.lit(IP_PREFIX), octet[0], F.lit("."), octet[1]) if cfg.include_ip else none
    return rows.select(
        "id",
        format_rfc3339(F.col("ts")).alias("timestamp"),
        "level",
        _pick(cfg.services, 2).alias("service"),
        _message().alias("message"),
        trace.alias("trace_id"),
        ip.alias("ip"),
    )


def synthetic_range(spark: SparkSession, n: int, start: str, rate: float, cfg: SyntheticConfig) -> DataFrame:
    """``n`` logs from ``start`` on at ``rate`` per second, made in parallel."""
    step = int(1_000_000 / rate)
    ids = spark.range(n).withColumn("ts", F.timestamp_micros(F.unix_micros(F.lit(start).cast("timestamp")) + F.col("id") * step))
    return synthetic_logs(ids, cfg)


def synthetic_stream(spark: SparkSession, rows_per_second: int, cfg: SyntheticConfig) -> DataFrame:
    """An endless stream of the same logs from the ``rate`` source."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return synthetic_logs(ticks, cfg, id_col="value", ts_col="timestamp")
