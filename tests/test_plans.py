"""Physical plans: what reaches the scan and what must not appear."""

import pytest

from tidelog.operators import rollups as RU
from tidelog.operators import search as S
from tidelog.operators import windows as WI
from tidelog.plans import catalog, zones

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_search_filters_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    params = S.SearchParams(service="svc-1", level="error", time_from="2024-01-10T00:00:00Z", time_to="2024-01-11T00:00:00Z")
    text = plan(S.search_logs(zones.documents(spark, SF), params))
    assert "EqualTo(service,svc-1)" in text and "EqualTo(level,ERROR)" in text
    assert "event_date" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert "TakeOrderedAndProject" in text


def test_counts_read_one_column(spark):
    text = plan(RU.logs_total(zones.messages(spark, SF)))
    assert "ReadSchema: struct<tenant_id:string>" in text


def test_recent_errors_limit_before_the_shuffle(spark):
    text = plan(WI.recent_errors(zones.messages(spark, SF), payload="doc_id"))
    assert "WindowGroupLimit" in text


STREAMED = {n for n in catalog.QUERIES if n.startswith(("stream_", "sink_", "run_", "delete_index", "rebuild", "compact"))}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - STREAMED - {"retention_metrics_unchanged"}))
def test_no_cross_join_and_no_python(spark, name):
    text = plan(catalog.QUERIES[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert bad not in text, bad
