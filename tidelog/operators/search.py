"""Filtered, paginated full-text search over stored documents."""

from __future__ import annotations

import dataclasses
import datetime as dt
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.text import contains_any_token, preview, query_terms, tenant_or_default
from tidelog.functions.times import as_timestamp, parse_moment
from tidelog.operators.windows import keep_last_document

# Paging limits (fixed values).
DEFAULT_PAGE = 1
DEFAULT_SIZE = 20
MAX_SIZE = 100


@dataclasses.dataclass(frozen=True)
class SearchParams:
    tenant_id: str = ""
    query: str = ""
    service: str = ""
    level: str = ""
    trace_id: str = ""
    time_from: str | dt.datetime | None = None
    time_to: str | dt.datetime | None = None
    page: int = DEFAULT_PAGE
    size: int = DEFAULT_SIZE

    def __post_init__(self):
        if self.page <= 0:
            object.__setattr__(self, "page", DEFAULT_PAGE)
        if self.size <= 0:
            object.__setattr__(self, "size", DEFAULT_SIZE)
        object.__setattr__(self, "size", min(self.size, MAX_SIZE))

    @property
    def offset(self) -> int:
        return (self.page - 1) * self.size


def search_page_params(args: dict[str, str]) -> SearchParams:
    """Request arguments to parameters.

    A bad page or size falls back to the default; a bad time raises ValueError.
    ``query`` is used when ``q`` is empty.
    """
    for name in ("from", "to"):
        if args.get(name):
            try:
                parse_moment(args[name])
            except ValueError:
                raise ValueError(f"{name}: expected RFC3339, received {args[name]!r}") from None
    return SearchParams(
        tenant_id=args.get("tenant_id", ""),
        query=args.get("q") or args.get("query", ""),
        service=args.get("service", ""),
        level=args.get("level", ""),
        trace_id=args.get("trace_id", ""),
        time_from=args.get("from") or None,
        time_to=args.get("to") or None,
        page=_positive(args.get("page"), DEFAULT_PAGE),
        size=_positive(args.get("size"), DEFAULT_SIZE),
    )


def _positive(text: str | None, default: int) -> int:
    try:
        number = int(text or "")
    except ValueError:
        return default
    return number if number > 0 else default


# ------------------------------------------------------------------ filters


def search_match(documents: DataFrame, query: str, text: str = "message") -> DataFrame:
    """Documents whose text holds any token of ``query``; empty or ``*`` is all."""
    if query in ("", "*"):
        return documents
    terms = query_terms(query)
    if not terms:
        return documents.where(F.lit(False))
    return documents.where(contains_any_token(F.col(text), terms))


def search_term(
    documents: DataFrame, tenant_id: str = "", service: str = "", level: str = "", trace_id: str = ""
) -> DataFrame:
    """Exact filters; an empty argument does not filter.  Levels are upper-cased."""
    wanted = {"tenant_id": tenant_id, "service": service, "level": level.upper(), "trace_id": trace_id}
    for name, value in wanted.items():
        if value:
            documents = documents.where(F.col(name) == value)
    return documents


def search_range(
    documents: DataFrame,
    time_from: Column | str | dt.datetime | None = None,
    time_to: Column | str | dt.datetime | None = None,
) -> DataFrame:
    """Event time bounds, both inclusive, repeated on the day so partitions are pruned."""
    if time_from:
        low = as_timestamp(time_from)
        documents = documents.where((F.col("event_ts") >= low) & (F.col("event_date") >= F.to_date(low)))
    if time_to:
        high = as_timestamp(time_to)
        documents = documents.where((F.col("event_ts") <= high) & (F.col("event_date") <= F.to_date(high)))
    return documents


def search_hits(documents: DataFrame, params: SearchParams) -> DataFrame:
    hits = search_match(documents, params.query)
    hits = search_term(hits, params.tenant_id, params.service, params.level, params.trace_id)
    return search_range(hits, params.time_from, params.time_to)


# -------------------------------------------------------------------- pages


def search_logs(documents: DataFrame, params: SearchParams) -> DataFrame:
    """One page of hits, newest event first; equal times are ordered by id."""
    ordered = search_hits(documents, params).orderBy(F.desc("event_ts"), "doc_id")
    return ordered.offset(params.offset).limit(params.size) if params.offset else ordered.limit(params.size)


def search_messages(messages: DataFrame, params: SearchParams) -> DataFrame:
    """The same page straight from stored message rows (keep-last included)."""
    return search_logs(keep_last_document(messages), params)


def search_total_pages(documents: DataFrame, params: SearchParams) -> DataFrame:
    """Exact hit count and the number of pages (at least one)."""
    return search_hits(documents, params).agg(F.count(F.lit(1)).alias("total")).select(
        "total",
        F.lit(params.page).alias("page"),
        F.lit(params.size).alias("size"),
        F.greatest(F.ceil(F.col("total") / params.size), F.lit(1)).cast("long").alias("pages"),
    )


def search_preview(documents: DataFrame) -> DataFrame:
    """Listing columns with the tenant filled in and long messages shortened."""
    return documents.select(
        "timestamp",
        "level",
        "service",
        tenant_or_default(F.col("tenant_id")).alias("tenant"),
        F.coalesce("trace_id", F.lit("")).alias("trace_id"),
        preview(F.col("message")).alias("message"),
    )


# ------------------------------------------------------------ saved searches


def saved_search(saved: DataFrame, name: str) -> SearchParams:
    """Parameters of a stored filter, looked up by its name.

    The filter is a small JSON object with the argument names of a request; an
    arbitrary query language is not accepted.
    """
    rows = saved.where(F.col("name") == name).select("query").limit(1).collect()
    if not rows:
        raise LookupError(f"no saved search {name!r}")
    stored = json.loads(rows[0]["query"])
    known = {"tenant_id", "q", "query", "service", "level", "trace_id", "from", "to", "page", "size"}
    if not isinstance(stored, dict) or set(stored) - known:
        raise ValueError("a saved search holds request arguments only")
    return search_page_params({k: str(v) for k, v in stored.items()})
