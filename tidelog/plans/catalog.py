"""All registered queries; importing a family registers it."""

from tidelog.plans import (  # noqa: F401
    change_queries,
    ingest_queries,
    metadata_queries,
    metric_queries,
    search_queries,
    stream_queries,
    telemetry_queries,
)
from tidelog.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
