"""Registered queries: search, paging, inventory and retention plans."""

from pyspark.sql import functions as F

from tidelog.functions.text import human_bytes
from tidelog.operators import retention as R
from tidelog.operators import rollups as RU
from tidelog.operators import search as S
from tidelog.plans import derive, zones
from tidelog.plans.derive_sql import DOCUMENTS, rfc3339, with_tables
from tidelog.plans.metric_queries import BUSY
from tidelog.plans.registry import day, query, stamp
from tidelog.sources import log_store, retention_runs

_TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"


def _tokens(col: str) -> str:
    return _TOKENS.format(col)


@query("search_match", with_tables(DOCUMENTS, f"""
SELECT doc_id, message FROM documents_now WHERE list_has_any({_tokens('message')}, ['cache', 'timeout', 'slow'])"""))
def search_match(spark, sf):
    return S.search_match(zones.documents(spark, sf), "Cache TIMEOUT, slow!").select("doc_id", "message")


# The larger corpus: whole document texts.
@query("search_match_documents", f"""
SELECT doc_id, lang, source FROM documents WHERE list_has_any({_tokens('text')}, ['the', 'être', 'license', 'und'])""")
def search_match_documents(spark, sf):
    texts = derive.table(spark, sf, "documents")
    return S.search_match(texts, "The être LICENSE und", text="text").select("doc_id", "lang", "source")


@query("search_term", with_tables(DOCUMENTS, """
SELECT doc_id, tenant_id, service, level, trace_id FROM documents_now
WHERE tenant_id = 'tenant-a' AND service = 'svc-1' AND level = 'ERROR'"""))
def search_term(spark, sf):
    hits = S.search_term(zones.documents(spark, sf), tenant_id="tenant-a", service="svc-1", level="error")
    return hits.select("doc_id", "tenant_id", "service", "level", "trace_id")


@query("search_range", with_tables(DOCUMENTS, f"""
SELECT doc_id, {rfc3339('event_ts')} AS event_ts FROM documents_now
WHERE event_ts BETWEEN TIMESTAMP '2024-01-10 06:30:00' AND TIMESTAMP '2024-01-12 18:00:00'"""))
def search_range(spark, sf):
    hits = S.search_range(zones.documents(spark, sf), "2024-01-10T06:30:00Z", "2024-01-12T19:00:00+01:00")
    return hits.select("doc_id", stamp("event_ts"))


_PARAMS = S.search_page_params({
    "q": "timeout", "level": "error", "from": "2024-01-05T00:00:00Z", "to": "2024-01-25T00:00:00Z", "page": "2", "size": "20",
})
_HITS = """
hits AS (
  SELECT * FROM documents_now WHERE level = 'ERROR' AND list_has_any(regexp_extract_all(lower(message), '[\\p{L}\\p{N}_]+'), ['timeout'])
    AND event_ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'
)"""


@query("search_logs", with_tables(DOCUMENTS + "," + _HITS, f"""
SELECT doc_id, tenant_id, "timestamp", level, service, message, trace_id, ip, {rfc3339('ingested_at')} AS ingested_at
FROM hits ORDER BY event_ts DESC, doc_id LIMIT 20 OFFSET 20"""))
def search_logs(spark, sf):
    page = S.search_logs(zones.documents(spark, sf), _PARAMS)
    return page.select("doc_id", "tenant_id", "timestamp", "level", "service", "message", "trace_id", "ip", stamp("ingested_at"))


@query("search_total_pages", with_tables(DOCUMENTS + "," + _HITS, """
SELECT count(*) AS total, 2 AS page, 20 AS size, greatest(CAST(ceil(count(*) / 20.0) AS BIGINT), 1) AS pages FROM hits"""))
def search_total_pages(spark, sf):
    return S.search_total_pages(zones.documents(spark, sf), _PARAMS)


# Out-of-range arguments: page 0 is page 1, size 500 is 100, `query` stands in for `q`.
@query("search_page_params", with_tables(DOCUMENTS, """
SELECT doc_id, "timestamp" FROM documents_now
WHERE list_has_any(regexp_extract_all(lower(message), '[\\p{L}\\p{N}_]+'), ['payment'])
ORDER BY event_ts DESC, doc_id LIMIT 100"""))
def search_page_params(spark, sf):
    params = S.search_page_params({"query": "payment", "page": "0", "size": "500"})
    return S.search_logs(zones.documents(spark, sf), params).select("doc_id", "timestamp")


@query("search_preview", with_tables(DOCUMENTS, """
SELECT "timestamp", level, service, tenant_id AS tenant, coalesce(trace_id, '') AS trace_id,
  CASE WHEN strlen(message) > 60 THEN left(message, list_max(list_filter(range(1, 58), lambda x: strlen(left(message, x)) <= 57))) || '...'
       ELSE message END AS message FROM documents_now"""))
def search_preview(spark, sf):
    return S.search_preview(zones.documents(spark, sf))


@query("search_preview_documents", """
SELECT doc_id, CASE WHEN strlen(text) > 60
  THEN left(text, list_max(list_filter(range(1, 58), lambda x: strlen(left(text, x)) <= 57))) || '...' ELSE text END AS preview FROM documents""")
def search_preview_documents(spark, sf):
    return derive.table(spark, sf, "documents").select("doc_id", S.preview(F.col("text")).alias("preview"))


@query("saved_search", with_tables(DOCUMENTS, """
SELECT doc_id, service, level, message FROM documents_now
WHERE service = (SELECT 'svc-' || (s_suppkey % 7) FROM supplier WHERE s_name = 'Supplier#000000003')
  AND level = 'ERROR' AND list_has_any(regexp_extract_all(lower(message), '[\\p{L}\\p{N}_]+'), ['timeout'])
ORDER BY event_ts DESC, doc_id LIMIT 50"""))
def saved_search(spark, sf):
    params = S.saved_search(derive.saved_searches(spark, sf), "Supplier#000000003")
    return S.search_logs(zones.documents(spark, sf), params).select("doc_id", "service", "level", "message")


@query("terms_by_service", with_tables(DOCUMENTS + BUSY, """
SELECT service, count(*) AS doc_count FROM documents_now, busy WHERE event_ts >= as_of - INTERVAL 1 HOUR GROUP BY ALL"""))
def terms_by_service(spark, sf):
    return RU.terms_by_service(zones.documents(spark, sf), zones.busy_clock(spark, sf))


@query("keep_last_document", with_tables(DOCUMENTS, f"""
SELECT doc_id, ip, "partition", "offset", {rfc3339('ingested_at')} AS ingested_at FROM documents_now"""))
def keep_last_document(spark, sf):
    return zones.documents(spark, sf).select("doc_id", "ip", "partition", "offset", stamp("ingested_at"))


# ---------------------------------------------------------------- inventory

_INDICES = """,
indices AS (
  SELECT 'logs-v1-' || strftime(event_date, '%Y.%m.%d') AS name, event_date AS day, count(*) AS doc_count FROM documents_now GROUP BY ALL
)"""


def _indices(spark, sf):
    root = zones.store_root(spark, sf)
    return R.list_indices(log_store.read_messages(spark, root), log_store.store_files(spark, root))


@query("list_indices", with_tables(DOCUMENTS + _INDICES, """
SELECT name, doc_count, true AS has_bytes, true AS has_date, 'open' AS status FROM indices"""))
def list_indices(spark, sf):
    return _indices(spark, sf).select(
        "name", "doc_count", (F.col("store_size_bytes") > 0).alias("has_bytes"),
        F.col("creation_date").isNotNull().alias("has_date"), "status",
    )


@query("index_stats", with_tables(DOCUMENTS + _INDICES, """
SELECT CAST(sum(doc_count) AS BIGINT) AS total_logs, count(*) AS total_indices, true AS has_bytes, min(name) AS oldest_index,
  strftime(min(day), '%Y-%m-%d') AS oldest_log_date, max(name) AS newest_index, strftime(max(day), '%Y-%m-%d') AS newest_log_date
FROM indices"""))
def index_stats(spark, sf):
    stats = R.index_stats(_indices(spark, sf))
    return stats.select(
        "total_logs", "total_indices", (F.col("total_size_bytes") > 0).alias("has_bytes"),
        "oldest_index", day("oldest_log_date"), "newest_index", day("newest_log_date"),
    )


# Document sizes per source, printed the way the listing prints store sizes.
@query("human_bytes", """
SELECT source, n, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0)
  WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0) ELSE printf('%.1f GB', n / 1073741824.0) END AS size
FROM (SELECT source, CAST(sum(strlen(text)) AS BIGINT) AS n FROM documents GROUP BY source
      UNION ALL SELECT 'document ' || doc_id, strlen(text) FROM documents)""")
def human_bytes_(spark, sf):
    docs = derive.table(spark, sf, "documents")
    size = F.octet_length("text").cast("long")
    each = docs.select(F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("source"), size.alias("n"))
    rows = docs.groupBy("source").agg(F.sum(size).alias("n")).unionByName(each)
    return rows.select("source", "n", human_bytes(F.col("n")).alias("size"))


# ---------------------------------------------------------------- retention

_NOW = "2024-01-30T15:00:00Z"


def _plan_rows(plan):
    return plan.select("name", "action", "reason")


@query("retention_plan", with_tables(DOCUMENTS + _INDICES, """
SELECT name, CASE WHEN day < DATE '2024-01-30' - 10 THEN 'delete' ELSE 'keep' END AS action,
  CASE WHEN day = DATE '2024-01-30' THEN 'active_write_index' WHEN day < DATE '2024-01-30' - 10 THEN 'expired' ELSE 'within_retention' END AS reason
FROM indices"""))
def retention_plan(spark, sf):
    return _plan_rows(R.retention_plan(_indices(spark, sf), 10, _NOW))


@query("retention_plan_summary", with_tables(DOCUMENTS + _INDICES, """
SELECT count(*) AS evaluated, count(*) FILTER (day < DATE '2024-01-30' - 10) AS deleted FROM indices"""))
def retention_plan_summary(spark, sf):
    return R.plan_summary(R.retention_plan(_indices(spark, sf), 10, _NOW))


@query("delete_before_plan", with_tables(DOCUMENTS + _INDICES, """
SELECT name, CASE WHEN CAST(day AS TIMESTAMP) < TIMESTAMP '2024-01-08 12:00:00' THEN 'delete' ELSE 'keep' END AS action,
  CASE WHEN day = DATE '2024-01-30' THEN 'active_write_index'
       WHEN CAST(day AS TIMESTAMP) < TIMESTAMP '2024-01-08 12:00:00' THEN 'expired' ELSE 'within_retention' END AS reason
FROM indices"""))
def delete_before_plan(spark, sf):
    return _plan_rows(R.delete_before_plan(_indices(spark, sf), "2024-01-08T12:00:00Z", _NOW))


_POLICY_SQL = """,
log_policies AS (
  SELECT DISTINCT tenant_id, CASE tenant_id WHEN 'tenant-a' THEN 7 ELSE 20 END AS retention_days, tenant_id <> 'tenant-b' AS enabled FROM accepted
)"""


@query("retention_by_policy", with_tables(DOCUMENTS + _POLICY_SQL, """
SELECT tenant_id, strftime(event_date, '%Y-%m-%d') AS event_date, count(*) AS doc_count, days AS retention_days,
  event_date < DATE '2024-01-30' - CAST(days AS INTEGER) AS expired
FROM (SELECT d.tenant_id, event_date, coalesce(retention_days, 15) AS days FROM documents_now d
      LEFT JOIN log_policies p ON p.tenant_id = d.tenant_id AND enabled) GROUP BY ALL"""))
def retention_by_policy(spark, sf):
    messages = zones.messages(spark, sf)
    policies = messages.select("tenant_id").distinct().select(
        "tenant_id", F.when(F.col("tenant_id") == "tenant-a", 7).otherwise(20).alias("retention_days"),
        (F.col("tenant_id") != "tenant-b").alias("enabled"),
    )
    report = R.retention_by_policy(messages, policies, _NOW, default_days=15)
    return report.withColumn("event_date", day("event_date"))


def _own_store(spark, sf, name):
    """A store of its own for a destructive run, made from the raw zone."""
    root = zones.scratch(spark, sf, name)
    zones.load_store(spark, sf, root)
    return root


@query("run_retention", with_tables(DOCUMENTS + _INDICES, """
SELECT name, doc_count FROM indices WHERE day >= DATE '2024-01-30' - 10"""))
def run_retention(spark, sf):
    root = _own_store(spark, sf, "retention")
    retention_runs.run_retention(spark, root, 10, _NOW)
    return R.list_indices(log_store.read_messages(spark, root)).select("name", "doc_count")


@query("delete_index", with_tables(DOCUMENTS + _INDICES, """
SELECT name, doc_count FROM indices WHERE name <> 'logs-v1-2024.01.15'"""))
def delete_index(spark, sf):
    root = _own_store(spark, sf, "delete-one")
    retention_runs.delete_index(spark, root, "logs-v1-2024.01.15", _NOW)
    return R.list_indices(log_store.read_messages(spark, root)).select("name", "doc_count")


@query("retention_metrics_unchanged", with_tables(DOCUMENTS, """
SELECT tenant_id, service, count(*) AS value FROM accepted GROUP BY ALL"""))
def retention_metrics_unchanged(spark, sf):
    root = _own_store(spark, sf, "metrics-kept")
    retention_runs.delete_before(spark, root, "2024-01-20T00:00:00Z", _NOW)
    rows = log_store.read_counters(spark, root).where(F.col("metric") == "logs_service")
    return rows.select("tenant_id", F.col("dim").alias("service"), "value")


@query("compact_days", with_tables(DOCUMENTS, "SELECT doc_id, ip FROM documents_now"))
def compact_days(spark, sf):
    root, target = zones.store_root(spark, sf), zones.scratch(spark, sf, "compacted")
    days = log_store.store_files(spark, root).select(F.col("event_date").cast("string")).distinct()
    log_store.compact_days(spark, root, sorted(r[0] for r in days.collect()), target)
    return log_store.read_messages(spark, target).select("doc_id", "ip")
