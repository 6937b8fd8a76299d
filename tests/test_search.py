import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidelog.operators import ingest as I
from tidelog.operators import search as S
from tidelog.operators.windows import keep_last_document

from helpers import column, event, raw_frame


@pytest.fixture(scope="module")
def docs(spark):
    values = [
        event(service="auth-service", level="ERROR", message="Password mismatch", trace_id="t-1"),
        event(service="auth-service", level="INFO", message="password ok", tenant_id="tenant-a"),
        event(service="pay", level="ERROR", message="Café timeout_7 après 30s", timestamp="2026-08-29T00:00:00Z"),
        event(service="pay", level="WARN", message="mismatched words", timestamp="2026-08-30T23:59:59.999999Z"),
    ]
    frame = I.accepted(raw_frame(spark, values)).cache()
    yield frame
    frame.unpersist()


def offsets(df):
    return sorted(column(df, "offset"))


@pytest.mark.parametrize(
    "query,hits",
    [
        ("mismatch", [0]), ("MISMATCH", [0]), ("mismatch timeout", [0]), ("password", [0, 1]), ("café", [2]), ("caf", []),
        ("timeout_7", [2]), ("timeout", []), ("30s", [2]), ("30", []), ("", [0, 1, 2, 3]), ("*", [0, 1, 2, 3]), ("!?", []),
        ("mismatch, password; après", [0, 1, 2]), (".*", []),
    ],
)
def test_match_is_by_whole_token(docs, query, hits):
    assert offsets(S.search_match(docs, query)) == hits


def test_match_agrees_with_token_sets(spark):
    words = ["alpha", "Beta-gamma", "x_y z", "É é", "a1 1a", "", "tail.", "«quoted» alpha"]
    df = spark.createDataFrame([(w,) for w in words], "message string")
    for query in ["alpha", "beta", "gamma x_y", "é", "1a", "tail quoted"]:
        from tidelog.functions.text import query_terms, tokens

        terms = F.array(*[F.lit(t) for t in query_terms(query)])
        expect = column(df.where(F.arrays_overlap(tokens(F.col("message")), terms)), "message")
        assert column(S.search_match(df, query), "message") == expect


def test_terms(docs):
    assert offsets(S.search_term(docs, service="pay", level="error")) == [2]
    assert offsets(S.search_term(docs, tenant_id="tenant-a")) == [1]
    assert offsets(S.search_term(docs, trace_id="t-1")) == [0]
    assert offsets(S.search_term(docs)) == [0, 1, 2, 3]


def test_range_ends_are_inclusive(docs):
    assert offsets(S.search_range(docs, "2026-08-29T00:00:00Z", "2026-08-30T23:59:59.999999Z")) == [2, 3]
    assert offsets(S.search_range(docs, None, "2026-08-29T02:00:00+02:00")) == [0, 1, 2]
    assert offsets(S.search_range(docs, dt.datetime(2026, 8, 30, tzinfo=dt.timezone.utc))) == [3]


def test_pages_of_equal_times_do_not_overlap(spark):
    values = [event(message=f"m{i}") for i in range(45)]
    docs = I.accepted(raw_frame(spark, values))
    pages = [column(S.search_logs(docs, S.SearchParams(page=p)), "doc_id") for p in (1, 2, 3, 4)]
    assert [len(p) for p in pages] == [20, 20, 5, 0]
    assert len(set(sum(pages, []))) == 45
    total = S.search_total_pages(docs, S.SearchParams()).first()
    assert (total["total"], total["pages"]) == (45, 3)
    none = S.search_total_pages(docs, S.SearchParams(service="nobody")).first()
    assert (none["total"], none["pages"]) == (0, 1)


def test_page_arguments():
    p = S.search_page_params({"page": "-1", "size": "1000", "query": "a"})
    assert (p.page, p.size, p.query, p.offset) == (1, 100, "a", 0)
    p = S.search_page_params({"page": "x", "size": "0", "q": "b", "query": "a"})
    assert (p.page, p.size, p.query) == (1, 20, "b")
    for bad in ("2026-08-01", "yesterday", "2026-08-01T00:00:00"):
        with pytest.raises(ValueError, match="RFC3339"):
            S.search_page_params({"from": bad})
    assert S.search_page_params({"to": "2026-08-01T00:00:00.5+01:00"}).time_to


def test_saved_search(spark, docs):
    saved = spark.createDataFrame(
        [("errors", '{"service":"pay","level":"error"}'), ("raw", '{"bool":{"must":[]}}')], "name string, query string"
    )
    assert offsets(S.search_hits(docs, S.saved_search(saved, "errors"))) == [2]
    with pytest.raises(ValueError):
        S.saved_search(saved, "raw")
    with pytest.raises(LookupError):
        S.saved_search(saved, "nothing")


def test_later_copy_replaces_address_and_arrival(spark):
    values = [event(ip="1.1.1.1"), event(ip="2.2.2.2"), event(message="other")]
    raw = raw_frame(spark, values, ["2026-08-28T10:00:05", "2026-08-28T10:00:09", "2026-08-28T10:00:01"])
    rows = keep_last_document(I.accepted(raw))
    assert rows.count() == 2
    assert column(rows.where("message = 'ok'"), "ip") == ["2.2.2.2"]


def test_listing(docs):
    rows = S.search_preview(docs.where("offset = 1")).collect()
    assert [(r["tenant"], r["trace_id"], r["message"]) for r in rows] == [("tenant-a", "", "password ok")]
