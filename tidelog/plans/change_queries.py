"""Registered queries: batches of metadata changes, checked with a model that makes them one by one.

The batches are derived so that they fall into cells which share no id and no
unique value.  The SQL walks through all cells at once, one change of each per
step of a recursive query, and looks every change up in the rows as they are then.
"""

from pyspark.sql import functions as F

from tidelog.operators import metadata as M
from tidelog.plans import derive
from tidelog.plans.derive_sql import rfc3339
from tidelog.plans.metadata_queries import API_KEYS, SERVICES, TENANTS
from tidelog.plans.registry import query, stamp

_AS_OF = "2024-06-01T00:00:00Z"
_NOW = "TIMESTAMP '2024-06-01'"
_ORDERS = f"""
o AS (
  SELECT o_orderkey AS seq, CASE o_orderstatus WHEN 'O' THEN 'create' WHEN 'F' THEN 'update' ELSE 'delete' END AS op, o_custkey % {derive.CELLS} AS cell,
    o_custkey % {derive.CELLS} + {derive.CELLS} * (o_orderkey % 9) AS number, o_orderpriority, o_orderdate FROM orders
)"""
_POLICIES = """
policies AS (SELECT 'p-' || c_custkey AS id, 't-' || c_custkey AS tenant_id, c_nationkey AS retention_days, c_acctbal > 0 AS enabled FROM customer)"""


def _one_by_one(relation: str, held: str, changes: str, fields: dict[str, tuple[str, str, str]], body: str) -> str:
    """Rows ``made`` and outcomes ``told`` of a batch.

    ``held`` gives ``key, value`` and the columns of the relation, ``changes`` also ``seq, op, cell, invalid``;
    ``fields`` has per column what a create, an update and any other change leaves in it.
    """
    after = ", ".join(f"{name} := CASE op WHEN 'create' THEN {made} WHEN 'update' THEN {updated} ELSE {other} END" for name, (made, updated, other) in fields.items())
    rows = ", ".join(f"{name} := {name}" for name in fields)
    return f"""
WITH RECURSIVE {relation.strip()},{_ORDERS},
held AS ({held}), changes AS ({changes}),
numbered AS (SELECT row_number() OVER (PARTITION BY cell ORDER BY seq) AS k, *, struct_pack({rows}) AS given FROM changes),
st(slot, cell, here, key, value, r, k, told) USING KEY (slot) AS (
  SELECT 'row ' || key, CAST(regexp_extract(key, '[0-9]+') AS BIGINT) % {derive.CELLS}, true, key, value, struct_pack({rows}), 0::BIGINT, []::STRUCT(seq BIGINT, outcome VARCHAR)[] FROM held
  UNION ALL SELECT DISTINCT 'at ' || cell, cell, false, NULL, NULL, NULL, 0, [] FROM changes
  UNION
  SELECT w.slot, w.cell, w.here, w.key, w.value, w.r, w.k, w.told FROM (
    SELECT unnest([
      {{'slot': 'at ' || cell, 'cell': cell, 'here': false, 'key': NULL, 'value': NULL, 'r': NULL, 'k': k, 'told': told || [{{'seq': seq, 'outcome': outcome}}]}},
      {{'slot': 'row ' || key, 'cell': cell, 'here': CASE WHEN outcome = 'ok' THEN op <> 'delete' ELSE there END, 'key': key,
        'value': CASE WHEN outcome = 'ok' AND op IN ('create', 'update') THEN value ELSE old_value END,
        'r': CASE WHEN outcome = 'ok' THEN struct_pack({after}) ELSE old END, 'k': k, 'told': []}}
    ]) AS w FROM (
      SELECT *, CASE WHEN invalid THEN 'invalid' WHEN op = 'create' AND (there OR taken) THEN 'exists' WHEN op <> 'create' AND NOT there THEN 'not_found'
        WHEN op = 'update' AND taken THEN 'exists' ELSE 'ok' END AS outcome
      FROM (
        SELECT c.*, coalesce(s.here, false) AS there, s.r AS old, s.value AS old_value, a.told,
          EXISTS (SELECT 1 FROM recurring.st h WHERE h.here AND h.cell = c.cell AND h.value = c.value AND h.key <> c.key) AS taken
        FROM (SELECT cell, k, told FROM st WHERE slot LIKE 'at %') a JOIN numbered c ON c.cell = a.cell AND c.k = a.k + 1 LEFT JOIN recurring.st s ON s.slot = 'row ' || c.key)))
), told AS (SELECT unnest(told, recursive := true) FROM st WHERE slot LIKE 'at %'),
made AS (SELECT key, unnest(r) FROM st WHERE here)
{body}"""


def _written(name: str, made: str | None = None, other: str | None = None) -> tuple[str, str, str]:
    return made or f"given.{name}", f"given.{name}", other or f"old.{name}"


_STATUS = "coalesce(nullif(given.status, ''), 'active')"
_TIMES = {"created_at": (_NOW, "old.created_at", "old.created_at"), "updated_at": (_NOW, _NOW, "old.updated_at")}


def _tenants(body: str) -> str:
    fields = {"name": _written("name"), "slug": _written("slug"), "status": (_STATUS, _STATUS, "old.status"), **_TIMES}
    changes = f"""SELECT seq, op, cell, 't-' || number AS key, slug AS value, op <> 'delete' AND trim(name) = '' AS invalid, * EXCLUDE (seq, op, cell), NULL::TIMESTAMP AS created_at, NULL::TIMESTAMP AS updated_at FROM (
      SELECT *, CASE WHEN seq % 41 = 0 THEN '' ELSE 'Tenant ' || seq END AS name, CASE WHEN seq % 4 = 0 THEN 'suspended' ELSE '' END AS status,
        CASE WHEN seq % 11 = 0 THEN 'customer-' || lpad(CAST(cell + {derive.CELLS} * (seq % 4) AS VARCHAR), 9, '0') ELSE 'slug-' || cell || '-' || (seq % 5) END AS slug FROM o)"""
    return _one_by_one(TENANTS, "SELECT *, id AS key, slug AS value, created_at AS updated_at FROM tenants", changes, fields, body)


@query("metadata_change_outcomes", _tenants("SELECT t.seq, c.op, c.key AS id, t.outcome FROM told t JOIN changes c ON c.seq = t.seq"))
def metadata_change_outcomes(spark, sf):
    outcomes = M.change_outcomes(derive.tenants(spark, sf), derive.tenant_changes(spark, sf), ["slug"], ["name", "slug"])
    return outcomes.select("seq", "op", "id", "outcome")


@query("apply_metadata_changes", _tenants(f"""
SELECT key AS id, name, slug, status, {rfc3339('created_at')} AS created_at, {rfc3339('updated_at')} AS updated_at FROM made"""))
def apply_metadata_changes(spark, sf):
    snapshot, _ = M.apply_metadata_changes(derive.tenants(spark, sf), derive.tenant_changes(spark, sf), ["slug"], ["name", "slug"], _AS_OF)
    return snapshot.select("id", "name", "slug", "status", stamp("created_at"), stamp("updated_at"))


@query("apply_service_changes", _one_by_one(
    SERVICES,
    "SELECT *, id AS key, tenant_id || '/' || name AS value, created_at AS updated_at FROM services",
    f"""SELECT seq, op, cell, 's-' || number AS key, tenant_id || '/' || name AS value, op <> 'delete' AND trim(tenant_id) = '' AS invalid, tenant_id, name,
      NULL::TIMESTAMP AS created_at, NULL::TIMESTAMP AS updated_at FROM (
      SELECT *, CASE WHEN seq % 37 = 0 THEN ' ' ELSE 't-' || (cell + {derive.CELLS} * (seq % 2)) END AS tenant_id, 'svc-' || (seq % 3) AS name FROM o)""",
    {"tenant_id": _written("tenant_id"), "name": _written("name"), **_TIMES},
    f"SELECT key AS id, tenant_id, name, {rfc3339('created_at')} AS created_at, {rfc3339('updated_at')} AS updated_at FROM made",
))
def apply_service_changes(spark, sf):
    unique = ["tenant_id", "name"]
    snapshot, _ = M.apply_metadata_changes(derive.services(spark, sf), derive.service_changes(spark, sf), unique, unique, _AS_OF)
    return snapshot.select("id", "tenant_id", "name", stamp("created_at"), stamp("updated_at"))


@query("apply_key_changes", _one_by_one(
    API_KEYS,
    "SELECT *, id AS key, key_hash AS value, NULL::TIMESTAMP AS last_used_at FROM api_keys",
    f"""SELECT seq, CASE seq // 3 % 4 WHEN 0 THEN 'create' WHEN 1 THEN 'touch' WHEN 2 THEN 'delete' ELSE 'revoke' END AS op, cell, 'k-' || number AS key,
      sha256('key-' || (cell + {derive.CELLS} * (seq % 11))) AS value, value AS key_hash, 't-' || cell AS tenant_id, CASE WHEN seq % 43 = 0 THEN '' ELSE o_orderpriority END AS name,
      seq // 3 % 4 = 0 AND seq % 43 = 0 AS invalid, '' AS status, NULL::TIMESTAMP AS created_at, CAST(o_orderdate AS TIMESTAMP) AS last_used_at, NULL::TIMESTAMP AS expires_at FROM o""",
    {
        "tenant_id": _written("tenant_id"), "key_hash": _written("key_hash"), "name": _written("name"), "expires_at": _written("expires_at"), "created_at": _TIMES["created_at"],
        "status": (_STATUS, _STATUS, "CASE WHEN op = 'revoke' THEN 'revoked' ELSE old.status END"),
        "last_used_at": ("given.last_used_at", "old.last_used_at", "CASE WHEN op = 'touch' THEN given.last_used_at ELSE old.last_used_at END"),
    },
    f"""SELECT key AS id, tenant_id, key_hash, name, status, {rfc3339('created_at')} AS created_at, {rfc3339('last_used_at')} AS last_used_at,
      {rfc3339('expires_at')} AS expires_at FROM made""",
))
def apply_key_changes(spark, sf):
    required = ["tenant_id", "key_hash", "name"]
    snapshot, _ = M.apply_metadata_changes(derive.api_keys(spark, sf), derive.key_changes(spark, sf), ["key_hash"], required, _AS_OF, touch_column="last_used_at")
    return snapshot.select("id", "tenant_id", "key_hash", "name", "status", stamp("created_at"), stamp("last_used_at"), stamp("expires_at"))


@query("apply_policy_changes", _one_by_one(
    _POLICIES,
    "SELECT *, tenant_id AS key, NULL::VARCHAR AS value, TIMESTAMP '2024-01-01' AS created_at, TIMESTAMP '2024-01-01' AS updated_at FROM policies",
    """SELECT seq, op, cell, 't-' || number AS key, NULL::VARCHAR AS value, 'p-' || seq AS id, CAST(seq % 40 AS INTEGER) AS retention_days, seq % 3 = 0 AS enabled,
      op <> 'delete' AND seq % 40 = 0 AS invalid, NULL::TIMESTAMP AS created_at, NULL::TIMESTAMP AS updated_at FROM o""",
    {"id": ("given.id", "old.id", "old.id"), "retention_days": _written("retention_days"), "enabled": _written("enabled"), **_TIMES},
    f"SELECT id, key AS tenant_id, retention_days::BIGINT AS retention_days, enabled, {rfc3339('created_at')} AS created_at, {rfc3339('updated_at')} AS updated_at FROM made",
))
def apply_policy_changes(spark, sf):
    held, changes = derive.single_policies(spark, sf), derive.policy_changes(spark, sf)
    snapshot, _ = M.apply_metadata_changes(held, changes, [], ["tenant_id"], _AS_OF, key="tenant_id", positive=("retention_days",))
    return snapshot.select("id", "tenant_id", F.col("retention_days").cast("long").alias("retention_days"), "enabled", stamp("created_at"), stamp("updated_at"))
