"""Destructive retention: carry out a plan on the store."""

from __future__ import annotations

import dataclasses
import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from tidelog.functions.times import INDEX_PREFIX, parse_moment
from tidelog.operators import retention as R
from tidelog.sources import log_store


@dataclasses.dataclass(frozen=True)
class RetentionResult:
    evaluated: int
    deleted: int
    deleted_indices: list[str]
    cutoff: dt.datetime


def _utc(moment: str | dt.datetime) -> dt.datetime:
    value = parse_moment(moment) if isinstance(moment, str) else moment
    return value.astimezone(dt.timezone.utc)


def _day_of(name: str) -> dt.date:
    """Calendar day of an index name; refuses anything else."""
    digits = name.removeprefix(INDEX_PREFIX)
    try:
        day = dt.datetime.strptime(digits, "%Y.%m.%d").date()
    except ValueError:
        day = None
    if day is None or f"{INDEX_PREFIX}{day:%Y.%m.%d}" != name:
        raise R.InvalidIndexName(f"must be logs-v1-YYYY.MM.DD: {name!r}")
    return day


class RetentionFailed(Exception):
    """A delete went wrong; ``result`` has the days that had been dropped by then."""

    def __init__(self, result: RetentionResult):
        super().__init__(f"retention stopped after {result.deleted} days")
        self.result = result


def store_indices(spark: SparkSession, root: str) -> DataFrame:
    return R.list_indices(log_store.read_messages(spark, root), log_store.store_files(spark, root))


def _carry_out(spark: SparkSession, root: str, plan: DataFrame, cutoff: dt.datetime) -> RetentionResult:
    # One row per stored day: a few thousand at most, whatever the data size.
    rows = plan.select("name", "day", "action").collect()
    days = {str(r["day"]): r["name"] for r in rows if r["action"] == R.DROP}
    dropped: list[str] = []
    try:
        log_store.drop_days(spark, root, sorted(days), dropped)
    except Exception as error:
        raise RetentionFailed(RetentionResult(len(rows), len(dropped), [days[d] for d in dropped], cutoff)) from error
    finally:
        spark.catalog.refreshByPath(f"{root}/{log_store.DOCS}")
    return RetentionResult(len(rows), len(dropped), [days[d] for d in dropped], cutoff)


def run_retention(spark: SparkSession, root: str, retention_days: int, as_of: str | dt.datetime) -> RetentionResult:
    plan = R.retention_plan(store_indices(spark, root), retention_days, as_of)
    midnight = _utc(as_of).replace(hour=0, minute=0, second=0, microsecond=0)
    return _carry_out(spark, root, plan, midnight - dt.timedelta(days=retention_days))


def delete_before(
    spark: SparkSession, root: str, before: str | dt.datetime, as_of: str | dt.datetime
) -> RetentionResult:
    plan = R.delete_before_plan(store_indices(spark, root), before, as_of)
    return _carry_out(spark, root, plan, _utc(before))


def delete_index(spark: SparkSession, root: str, name: str, as_of: str | dt.datetime) -> None:
    """Drop one day.  Checked in order: name, today's index, presence."""
    day = _day_of(name)
    if day == _utc(as_of).date():
        raise R.ProtectedIndex(name)
    if not log_store.drop_days(spark, root, [str(day)]):
        raise R.IndexNotFound(name)
    spark.catalog.refreshByPath(f"{root}/{log_store.DOCS}")
