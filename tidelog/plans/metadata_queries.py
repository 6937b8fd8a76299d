"""Registered queries: lookups, joins, audits, changes, reconciliation."""

from pyspark.sql import functions as F

from tidelog.operators import ingest as I
from tidelog.operators import metadata as M
from tidelog.plans import derive, zones
from tidelog.plans.derive_sql import CLASSIFIED, DOCUMENTS, rfc3339, with_tables
from tidelog.plans.registry import query, stamp
from tidelog.sources import metadata as source

_AS_OF = "2000-01-01T00:00:00Z"

TENANTS = """
tenants AS (
  SELECT 't-' || c_custkey AS id, CASE WHEN c_custkey % 211 = 0 THEN ' ' ELSE c_name END AS name,
    CASE WHEN c_custkey % 97 = 0 THEN 'shared' ELSE lower(replace(c_name, '#', '-')) END AS slug,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'suspended' WHEN 'HOUSEHOLD' THEN 'disabled' ELSE 'active' END AS status,
    TIMESTAMP '2024-01-01' + CAST(c_custkey * 37 % 100000 AS INTEGER) * INTERVAL 1 MINUTE AS created_at
  FROM customer
)"""
SERVICES = """
services AS (
  SELECT 's-' || p_partkey AS id, CASE WHEN p_size = 1 THEN '' ELSE 't-' || (p_partkey * 7 % 1600) END AS tenant_id, p_name AS name,
    TIMESTAMP '2024-01-01' + CAST(p_partkey % 100000 AS INTEGER) * INTERVAL 1 MINUTE AS created_at FROM part
)"""
API_KEYS = """
api_keys AS (
  SELECT 'k-' || o_orderkey AS id, 't-' || o_custkey AS tenant_id, sha256('key-' || o_orderkey) AS key_hash, o_orderpriority AS name,
    CASE o_orderstatus WHEN 'P' THEN 'revoked' ELSE 'active' END AS status, o_orderdate AS created_at,
    CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderdate + INTERVAL 365 DAYS END AS expires_at FROM orders
)"""
POLICIES = """
policies AS (
  SELECT 'p-' || c_custkey AS id, CASE WHEN c_custkey % 53 = 0 THEN 't-1' ELSE 't-' || c_custkey END AS tenant_id,
    c_nationkey AS retention_days, c_acctbal > 0 AS enabled FROM customer
)"""


@query("src_metadata", with_tables(TENANTS, f"SELECT id, name, slug, status, {rfc3339('created_at')} AS created_at FROM tenants"))
def src_metadata(spark, sf):
    root = zones.scratch(spark, sf, "metadata")
    source.write_metadata_files(derive.tenants(spark, sf), root, "tenants")
    return source.read_metadata_files(spark, root, "tenants").select("id", "name", "slug", "status", stamp("created_at"))


@query("src_metadata_relations", with_tables(",".join([TENANTS, SERVICES, API_KEYS, POLICIES]), """
SELECT 'tenants' AS "table", count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM tenants
UNION ALL SELECT 'services', count(*), min(id), max(id) FROM services
UNION ALL SELECT 'api_keys', count(*), min(id), max(id) FROM api_keys
UNION ALL SELECT 'retention_policies', count(*), min(id), max(id) FROM policies"""))
def src_metadata_relations(spark, sf):
    root, out = zones.scratch(spark, sf, "metadata-relations"), None
    made = {"tenants": derive.tenants, "services": derive.services, "api_keys": derive.api_keys, "retention_policies": derive.policies}
    for name, make in made.items():
        source.write_metadata_files(make(spark, sf), root, name)
        read = source.read_metadata_files(spark, root, name)
        row = read.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
        row = row.select(F.lit(name).alias("table"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@query("list_tenants", with_tables(TENANTS, f"SELECT id, name, slug, status, {rfc3339('created_at')} AS created_at FROM tenants"))
def list_tenants(spark, sf):
    return M.list_tenants(derive.tenants(spark, sf)).select("id", "name", "slug", "status", stamp("created_at"))


@query("list_services", with_tables(SERVICES, "SELECT id, tenant_id, name FROM services WHERE tenant_id = 't-7'"))
def list_services(spark, sf):
    return M.list_services(derive.services(spark, sf), "t-7").select("id", "tenant_id", "name")


@query("list_keys", with_tables(API_KEYS, "SELECT id, tenant_id, key_hash, status FROM api_keys WHERE tenant_id = 't-7'"))
def list_keys(spark, sf):
    return M.list_keys(derive.api_keys(spark, sf), "t-7").select("id", "tenant_id", "key_hash", "status")


@query("tenant_by_id", with_tables(TENANTS, "SELECT id, slug FROM tenants WHERE id = 't-42'"))
def tenant_by_id(spark, sf):
    return M.tenant_by_id(derive.tenants(spark, sf), "t-42").select("id", "slug")


@query("tenant_by_slug", with_tables(TENANTS, "SELECT id, slug FROM tenants WHERE slug = 'customer-000000012'"))
def tenant_by_slug(spark, sf):
    return M.tenant_by_slug(derive.tenants(spark, sf), "customer-000000012").select("id", "slug")


@query("service_by_name", with_tables(SERVICES, """
SELECT id, name FROM services WHERE tenant_id = 't-14' AND name = (SELECT name FROM services WHERE id = 's-2')"""))
def service_by_name(spark, sf):
    services = derive.services(spark, sf)
    name = services.where("id = 's-2'").select("name").scalar()
    return M.service_by_name(services, "t-14", name).select("id", "name")


@query("key_by_hash", with_tables(API_KEYS, "SELECT id, tenant_id FROM api_keys WHERE key_hash = sha256('key-99')"))
def key_by_hash(spark, sf):
    return M.key_by_hash(derive.api_keys(spark, sf), M.hash_key(F.lit(" key-99\n"))).select("id", "tenant_id")


@query("policy_by_tenant", with_tables(POLICIES, "SELECT id, retention_days, enabled FROM policies WHERE tenant_id = 't-10'"))
def policy_by_tenant(spark, sf):
    return M.policy_by_tenant(derive.policies(spark, sf), "t-10").select("id", "retention_days", "enabled")


@query("valid_keys", with_tables(API_KEYS, """
SELECT id, tenant_id FROM api_keys WHERE status = 'active' AND (expires_at IS NULL OR expires_at >= TIMESTAMP '2000-01-01')"""))
def valid_keys(spark, sf):
    return M.valid_keys(derive.api_keys(spark, sf), _AS_OF).select("id", "tenant_id")


@query("resolve_api_key", with_tables(API_KEYS, """
SELECT l_orderkey, l_linenumber, CASE WHEN k.id IS NULL THEN 'unknown' WHEN status <> 'active' THEN 'revoked'
    WHEN expires_at < TIMESTAMP '2000-01-01' THEN 'expired' ELSE 'ok' END AS key_state,
  CASE WHEN status = 'active' AND (expires_at IS NULL OR expires_at >= TIMESTAMP '2000-01-01') THEN k.tenant_id END AS tenant_id
FROM lineitem LEFT JOIN api_keys k ON k.key_hash = sha256('key-' || (l_orderkey + CASE WHEN l_linenumber = 7 THEN 100000000 ELSE 0 END))"""))
def resolve_api_key(spark, sf):
    resolved = M.resolve_api_key(derive.key_requests(spark, sf), derive.api_keys(spark, sf), _AS_OF)
    return resolved.select("l_orderkey", "l_linenumber", "key_state", "tenant_id")


_REGISTERED = """,
registered AS (SELECT DISTINCT tenant_id, service FROM accepted WHERE service <> 'svc-6' OR tenant_id = 'tenant-b')"""


def _registered(spark, sf):
    seen = zones.messages(spark, sf).select("tenant_id", F.col("service").alias("name")).distinct()
    return seen.where((F.col("name") != "svc-6") | (F.col("tenant_id") == "tenant-b"))


@query("unknown_services", with_tables(CLASSIFIED + _REGISTERED, """
SELECT tenant_id, service, doc_id, "offset" FROM accepted a
WHERE NOT EXISTS (SELECT 1 FROM registered r WHERE r.tenant_id = a.tenant_id AND r.service = a.service)"""))
def unknown_services(spark, sf):
    found = M.unknown_services(zones.messages(spark, sf), _registered(spark, sf))
    return found.select("tenant_id", "service", "doc_id", "offset")


@query("known_services", with_tables(CLASSIFIED + _REGISTERED, """
SELECT tenant_id, service, count(*) AS logs FROM accepted a
WHERE EXISTS (SELECT 1 FROM registered r WHERE r.tenant_id = a.tenant_id AND r.service = a.service) GROUP BY ALL"""))
def known_services(spark, sf):
    found = M.known_services(zones.messages(spark, sf), _registered(spark, sf))
    return found.groupBy("tenant_id", "service").agg(F.count(F.lit(1)).alias("logs"))


@query("services_with_app_env", "SELECT 's-' || p_partkey AS id, p_name AS name, p_brand AS app_name, lower(p_type) AS env_name FROM part")
def services_with_app_env(spark, sf):
    joined = M.services_with_app_env(derive.app_services(spark, sf), derive.applications(spark, sf), derive.environments(spark, sf))
    return joined.select("id", "name", "app_name", "env_name")


@query("alert_evaluation", with_tables(DOCUMENTS, """
SELECT id, name, service, condition, threshold, window_minutes, errors,
  CASE condition WHEN 'gt' THEN errors > threshold ELSE errors >= threshold END AS fires
FROM (
  SELECT r.*, (SELECT count(*) FROM accepted a, clock WHERE a.service = r.service AND a.level IN ('ERROR', 'FATAL')
    AND a.ingested_at > as_of - r.window_minutes * INTERVAL 1 MINUTE) AS errors
  FROM (SELECT 'r-' || p_partkey AS id, p_name AS name, 'svc-' || (p_partkey % 9) AS service,
          CASE WHEN p_partkey % 2 = 0 THEN 'gt' ELSE 'gte' END AS condition, p_size % 5 AS threshold,
          p_size * 30 AS window_minutes FROM part WHERE p_partkey % 5 <> 0) r)"""))
def alert_evaluation(spark, sf):
    return M.alert_evaluation(zones.messages(spark, sf), derive.alert_rules(spark, sf), zones.clock(spark, sf))


_GONE = "gone AS (SELECT DISTINCT 't-' || o_custkey AS id FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')"


@query("cascade_delete", with_tables(",".join([TENANTS, SERVICES, API_KEYS, POLICIES, "\n" + _GONE]), """
SELECT 'tenants' AS "table", id FROM tenants WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'services', id FROM services WHERE tenant_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'api_keys', id FROM api_keys WHERE tenant_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'retention_policies', id FROM policies WHERE tenant_id NOT IN (SELECT id FROM gone)"""))
def cascade_delete(spark, sf):
    urgent = derive.table(spark, sf, "orders").where("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'")
    gone = urgent.select(F.concat(F.lit("t-"), F.col("o_custkey").cast("string")).alias("id"))
    children = {
        "services": derive.services(spark, sf), "api_keys": derive.api_keys(spark, sf),
        "retention_policies": derive.policies(spark, sf),
    }
    tenants, kept = M.cascade_delete(derive.tenants(spark, sf), children, gone)
    result = tenants.select(F.lit("tenants").alias("table"), "id")
    for name, child in kept.items():
        result = result.unionByName(child.select(F.lit(name).alias("table"), "id"))
    return result


# Brands of small parts are there already; brands of all parts are seeded.
@query("seed_do_nothing", """
SELECT DISTINCT p_brand AS name, p_brand IN (SELECT p_brand FROM part WHERE p_size <= 2) AS old FROM part""")
def seed_do_nothing(spark, sf):
    part = derive.table(spark, sf, "part")
    existing = part.where("p_size <= 2").select(F.col("p_brand").alias("name"), F.lit(True).alias("old")).distinct()
    return M.seed_do_nothing(existing, part.select(F.col("p_brand").alias("name"), F.lit(False).alias("old")))


_DOUBLED = "audit_keys AS (SELECT *, CASE WHEN CAST(substr(id, 3) AS BIGINT) % 501 = 0 THEN sha256('key-0') ELSE key_hash END AS hash FROM api_keys)"


@query("metadata_audit", with_tables(",".join([TENANTS, SERVICES, API_KEYS, POLICIES, "\n" + _DOUBLED]), """
SELECT 'tenants' AS "table", 'blank_name' AS rule, id AS key FROM tenants WHERE trim(name) = ''
UNION ALL SELECT 'tenants', 'duplicate_slug', slug FROM tenants GROUP BY slug HAVING count(*) > 1
UNION ALL SELECT 'api_keys', 'duplicate_key_hash', hash FROM audit_keys GROUP BY hash HAVING count(*) > 1
UNION ALL SELECT 'services', 'blank_tenant', id FROM services WHERE tenant_id = ''
UNION ALL SELECT 'services', 'duplicate_name', tenant_id || '/' || name FROM services GROUP BY tenant_id, name HAVING count(*) > 1
UNION ALL SELECT 'retention_policies', 'days_not_positive', id FROM policies WHERE retention_days <= 0
UNION ALL SELECT 'retention_policies', 'second_policy', tenant_id FROM policies GROUP BY tenant_id HAVING count(*) > 1
UNION ALL SELECT 'services', 'orphan_tenant', id FROM services WHERE tenant_id <> '' AND tenant_id NOT IN (SELECT id FROM tenants)
UNION ALL SELECT 'api_keys', 'orphan_tenant', id FROM api_keys WHERE tenant_id NOT IN (SELECT id FROM tenants)
UNION ALL SELECT 'retention_policies', 'orphan_tenant', id FROM policies WHERE tenant_id NOT IN (SELECT id FROM tenants)"""))
def metadata_audit(spark, sf):
    number = F.substring("id", 3, 20).cast("long")
    twice = F.when(number % 501 == 0, F.sha2(F.lit("key-0"), 256)).otherwise(F.col("key_hash"))
    keys = derive.api_keys(spark, sf).withColumn("key_hash", twice)
    return M.metadata_audit(derive.tenants(spark, sf), keys, derive.services(spark, sf), derive.policies(spark, sf))


# ------------------------------------------------------------ reconciliation


@query("reconcile_counts", with_tables(DOCUMENTS, """
SELECT (SELECT count(*) FROM classified WHERE parse_error IS NULL) AS submitted, (SELECT count(DISTINCT doc_id) FROM accepted) AS stored,
  (SELECT count(DISTINCT doc_id) FROM classified WHERE parse_error IS NULL AND doc_id NOT IN (SELECT doc_id FROM accepted)) AS missing,
  0 AS duplicates, 0 AS unexpected"""))
def reconcile_counts(spark, sf):
    parsed = I.parse_log(zones.raw_zone(spark, sf)).where("parse_error IS NULL")
    submitted = I.to_document(parsed, F.col("arrived_at"))
    return M.reconcile_counts(submitted, zones.documents(spark, sf))


@query("missing_documents", with_tables(CLASSIFIED, """
SELECT DISTINCT doc_id FROM classified WHERE parse_error IS NULL AND doc_id NOT IN (SELECT doc_id FROM accepted)"""))
def missing_documents(spark, sf):
    parsed = I.parse_log(zones.raw_zone(spark, sf)).where("parse_error IS NULL")
    return M.missing_documents(I.to_document(parsed, F.col("arrived_at")), zones.messages(spark, sf))
