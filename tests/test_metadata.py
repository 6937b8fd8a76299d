import datetime as dt
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import metadata as M
from tidelog.schemas import API_KEYS, RETENTION_POLICIES, SERVICES, TENANTS
from tidelog.session import shared_dir
from tidelog.sources import metadata as source

from helpers import at, column, message_frame

T0 = at("2026-01-01T00:00:00")


def tenants(spark, *rows):
    return spark.createDataFrame([(i, n, s, "active", T0, T0) for i, n, s in rows], TENANTS)


def key(i, status="active", expires=None, raw=None, tenant="t1"):
    return (i, tenant, hashlib.sha256((raw or i).encode()).hexdigest(), i, status, T0, None, expires)


def test_key_validity(spark):
    now = "2026-06-01T00:00:00Z"
    keys = spark.createDataFrame(
        [
            key("future", expires=at("2027-01-01T00:00:00")), key("past", expires=at("2026-05-31T23:59:59")),
            key("exact", expires=at("2026-06-01T00:00:00")), key("none"), key("revoked", "revoked"),
        ],
        API_KEYS,
    )
    assert sorted(column(M.valid_keys(keys, now), "id")) == ["exact", "future", "none"]
    requests = spark.createDataFrame([(" future\n",), ("past",), ("revoked",), ("who",)], "api_key string")
    rows = {r["key_hash"]: (r["key_state"], r["tenant_id"]) for r in M.resolve_api_key(requests, keys, now).collect()}
    names = {hashlib.sha256(n.encode()).hexdigest(): n for n in ("future", "past", "revoked", "who")}
    assert {names[h]: v for h, v in rows.items()} == {
        "future": ("ok", "t1"), "past": ("expired", None), "revoked": ("revoked", None), "who": ("unknown", None),
    }


def change(seq, op, id_, name="n", slug="s", status=""):
    return (seq, op, id_, name, slug, status, None, None)


CHANGE = "seq long, op string, id string, name string, slug string, status string, created_at timestamp, updated_at timestamp"


def outcomes(spark, existing, changes):
    rows = M.change_outcomes(existing, spark.createDataFrame(changes, CHANGE), ["slug"], ["name", "slug"])
    return {r["seq"]: r["outcome"] for r in rows.collect()}


def test_change_outcomes(spark):
    existing = tenants(spark, ("t1", "One", "one"), ("t2", "Two", "two"))
    got = outcomes(
        spark, existing,
        [
            change(1, "create", "t3", slug="three"), change(2, "create", "t1", slug="x"), change(3, "create", "t4", slug="two"),
            change(4, "create", "t5", slug="three"), change(5, "create", "t6", name=" ", slug="six"), change(6, "update", "nope", slug="y"),
            change(7, "delete", "t2", slug=""), change(8, "delete", "gone", slug=""),
        ],
    )
    assert got == {1: "ok", 2: "exists", 3: "exists", 4: "exists", 5: "invalid", 6: "not_found", 7: "ok", 8: "not_found"}


def test_changes_take_effect_one_after_the_other(spark):
    got = outcomes(
        spark, tenants(spark, ("t1", "One", "one")),
        [
            change(1, "create", "t2", slug="a"), change(2, "update", "t2", slug="b"), change(3, "create", "t3", slug="b"), change(4, "create", "t4", slug="a"),
            change(5, "delete", "t1"), change(6, "create", "t5", slug="one"), change(7, "create", "t1", slug="one"), change(8, "create", "t1", slug="two"),
            change(9, "update", "t9", slug="c"), change(10, "create", "t6", slug="c"), change(11, "delete", "t2"), change(12, "update", "t3", slug="b"),
            change(13, "create", "t3", slug="d"), change(14, "create", "t7", slug="d"), change(15, "fly", "t1"), change(16, "create", None, slug="e"),
        ],
    )
    failed = {3: "exists", 7: "exists", 9: "not_found", 12: "not_found", 14: "exists", 15: "invalid", 16: "invalid"}
    assert got == {n: failed.get(n, "ok") for n in range(1, 17)}


class OneByOne:
    """A plain model of a relation with one unique value; changes are made in turn."""

    def __init__(self, rows, key, unique, required, positive, touch):
        self.rows = [dict(r) for r in rows]
        self.key, self.unique, self.required, self.positive, self.touch = key, unique, required, positive, touch

    def make(self, c, now):
        op, mine = c["op"], [r for r in self.rows if r[self.key] == c[self.key]]
        writes = op in ("create", "update")
        if op not in ("create", "update", "delete", "revoke", "touch") or c[self.key] is None:
            return "invalid"
        if writes and (any(not (c[n] or "").strip() for n in self.required) or any(not (c[n] or 0) > 0 for n in self.positive)):
            return "invalid"
        value = tuple(c[n] for n in self.unique)
        taken = bool(self.unique) and any(tuple(r[n] for n in self.unique) == value and r[self.key] != c[self.key] for r in self.rows)
        if op == "create" and (mine or taken):
            return "exists"
        if op != "create" and not mine:
            return "not_found"
        if op == "update" and taken:
            return "exists"
        if op == "create":
            row = {n: c[n] for n in self.rows_columns}
            row |= {n: now for n in ("created_at", "updated_at") if n in row}
            if "status" in row:
                row["status"] = row["status"] or "active"
            self.rows.append(row)
        elif op == "delete":
            self.rows = [r for r in self.rows if r[self.key] != c[self.key]]
        for r in mine:
            if op == "revoke" and "status" in r:
                r["status"] = "revoked"
            if op == "touch" and self.touch:
                r[self.touch] = c[self.touch]
            if op == "update":
                fixed = {"id", self.key, "created_at", self.touch}
                r |= {n: c[n] for n in r if n not in fixed}
                r["updated_at"] = now
                if "status" in r:
                    r["status"] = r["status"] or "active"
        return "ok"


RELATIONS = {
    "tenants": dict(schema=TENANTS, key="id", unique=["slug"], required=["name", "slug"], positive=(), touch=None, ops=["create", "update", "delete"]),
    "services": dict(schema=SERVICES, key="id", unique=["tenant_id", "name"], required=["tenant_id", "name"], positive=(), touch=None, ops=["create", "delete", "update"]),
    "api_keys": dict(schema=API_KEYS, key="id", unique=["key_hash"], required=["tenant_id", "key_hash", "name"], positive=(), touch="last_used_at", ops=["create", "revoke", "touch", "delete"]),
    "policies": dict(schema=RETENTION_POLICIES, key="tenant_id", unique=[], required=["tenant_id"], positive=("retention_days",), touch=None, ops=["create", "update", "delete"]),
}


@pytest.mark.parametrize("hot", [M.HOT, 3])
@pytest.mark.parametrize("relation", RELATIONS)
def test_batches_against_one_by_one(spark, relation, hot, monkeypatch):
    """Random batches over few keys and values, so that changes hang on each other; also folded in slices."""
    monkeypatch.setattr(M, "HOT", hot)
    how, rng = RELATIONS[relation], random.Random(f"{relation}{hot}")
    names = how["schema"].fieldNames()

    def row(i):
        pick = {"id": f"i{i}", "tenant_id": f"t{rng.randrange(5)}", "name": rng.choice(["a", "b", "c", " "]), "slug": rng.choice("uvwxyz"), "key_hash": rng.choice("uvwxyz")}
        pick |= {"status": rng.choice(["", "suspended"]), "retention_days": rng.choice([0, 7, 30]), "enabled": rng.random() < 0.5}
        return {n: pick.get(n, T0 + dt.timedelta(minutes=rng.randrange(99)) if n.endswith("_at") else None) for n in names}

    held = [row(i) for i in range(5)]
    if relation == "policies":
        held = [{**r, "tenant_id": f"t{i}"} for i, r in enumerate(held[:3])]
    batch = [{**row(rng.randrange(9)), "seq": n * 7, "op": rng.choice(how["ops"])} for n in range(70)]
    model = OneByOne(held, how["key"], how["unique"], how["required"], how["positive"], how["touch"])
    model.rows_columns = names
    now = at("2026-06-01T00:00:00")
    want = {c["seq"]: model.make(c, now) for c in batch}

    snapshot = spark.createDataFrame([tuple(r[n] for n in names) for r in held], how["schema"])
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in how["schema"].fields]
    changes = spark.createDataFrame([(c["seq"], c["op"], *(c[n] for n in names)) for c in batch], ", ".join(["seq long", "op string", *fields]))
    after, made = M.apply_metadata_changes(snapshot, changes, how["unique"], how["required"], now, how["touch"], how["key"], how["positive"])
    assert {r["seq"]: r["outcome"] for r in made.collect()} == want and len(set(want.values())) > 2
    assert sorted(map(repr, map(tuple, after.collect()))) == sorted(repr(tuple(r[n].replace(tzinfo=None) if n.endswith("_at") and r[n] else r[n] for n in names)) for r in model.rows)


def test_long_chain_of_freed_values(spark):
    """Every change needs the one before it."""
    existing = tenants(spark, *[(f"t{i}", "n", f"s{i}") for i in range(8)])
    got = outcomes(spark, existing, [change(i, "update", f"t{7 - i}", slug=f"s{8 - i}") for i in range(8)])
    assert set(got.values()) == {"ok"}
    got = outcomes(spark, existing, [change(i, "update", f"t{i}", slug=f"s{i + 1}") for i in range(8)])
    assert got == {**dict.fromkeys(range(7), "exists"), 7: "ok"}


def test_tables_do_not_grow_with_the_chain(spark):
    """Sixty changes that each need the one before it are walked through once, not in sixty turns."""
    area = shared_dir(spark, "tidelog-changes")

    def tables():
        return sum("_SUCCESS" in files for _, _, files in os.walk(area))

    n, before = 60, tables()
    existing = tenants(spark, *[(f"t{i}", "n", f"s{i}") for i in range(n)])
    got = outcomes(spark, existing, [change(i, "update", f"t{n - 1 - i}", slug=f"s{n - i}") for i in range(n)])
    assert got == dict.fromkeys(range(n), "ok") and tables() - before < 10


def test_no_changes_and_no_rows(spark):
    none, rows = spark.createDataFrame([], TENANTS), tenants(spark, ("t1", "One", "one"))
    empty = spark.createDataFrame([], CHANGE)
    assert outcomes(spark, none, [change(1, "create", "t1", slug="a"), change(2, "delete", "t2")]) == {1: "ok", 2: "not_found"}
    after, made = M.apply_metadata_changes(rows, empty, ["slug"], ["name"], "2026-06-01T00:00:00Z")
    assert made.count() == 0 and after.collect() == rows.collect()


def test_new_snapshot(spark):
    existing = tenants(spark, ("t1", "One", "one"), ("t2", "Two", "two"), ("t3", "Three", "three"))
    changes = spark.createDataFrame(
        [change(1, "update", "t1", "Uno", "one", "suspended"), change(2, "delete", "t2"), change(3, "create", "t4", "Four", "four"), change(4, "revoke", "t3")],
        CHANGE,
    )
    snapshot, _ = M.apply_metadata_changes(existing, changes, ["slug"], ["name", "slug"], "2026-06-01T00:00:00Z")
    rows = {r["id"]: (r["name"], r["slug"], r["status"], r["updated_at"].month) for r in snapshot.collect()}
    assert rows == {
        "t1": ("Uno", "one", "suspended", 6), "t3": ("Three", "three", "revoked", 1), "t4": ("Four", "four", "active", 6),
    }


def test_snapshot_is_not_shuffled_for_few_changed_keys(spark, capsys):
    """The outcomes are reduced once, to a written table small enough to be broadcast, before the snapshot is read."""
    existing = spark.range(1000).select(F.format_string("t%d", "id").alias("id"), F.lit("n").alias("name"), F.format_string("s%d", "id").alias("slug"), F.lit("active").alias("status"), F.lit(T0).alias("created_at"), F.lit(T0).alias("updated_at"))
    changes = spark.createDataFrame([change(1, "delete", "t2"), change(2, "create", "t1000", slug="s2")], CHANGE)
    snapshot, _ = M.apply_metadata_changes(existing, changes, ["slug"], ["name", "slug"], "2026-06-01T00:00:00Z")
    snapshot.explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert sorted(column(snapshot, "id")) == sorted([f"t{i}" for i in range(1001) if i != 2])


def test_audit(spark):
    t = tenants(spark, ("t1", "One", "same"), ("t2", " ", "same"), ("t3", "Three", ""))
    keys = spark.createDataFrame([key("a", raw="x"), key("b", raw="x"), key("c", tenant="ghost")], API_KEYS)
    services = spark.createDataFrame(
        [("s1", "t1", "api", T0, T0), ("s2", "t1", "api", T0, T0), ("s3", "t2", "api", T0, T0), ("s4", "", " ", T0, T0)], SERVICES
    )
    policies = spark.createDataFrame([("p1", "t1", 30, True, T0, T0), ("p2", "t1", 0, True, T0, T0)], RETENTION_POLICIES)
    found = {(r["table"], r["rule"], r["key"]) for r in M.metadata_audit(t, keys, services, policies).collect()}
    assert found == {
        ("tenants", "blank_name", "t2"), ("tenants", "blank_slug", "t3"), ("tenants", "duplicate_slug", "same"),
        ("api_keys", "duplicate_key_hash", hashlib.sha256(b"x").hexdigest()), ("api_keys", "orphan_tenant", "c"),
        ("services", "duplicate_name", "t1/api"), ("services", "blank_tenant", "s4"), ("services", "blank_name", "s4"),
        ("retention_policies", "days_not_positive", "p2"), ("retention_policies", "second_policy", "t1"),
    }


def test_lists_and_lookups(spark):
    t = tenants(spark, ("t1", "One", "one"), ("t2", "Two", "two"))
    assert column(M.tenant_by_slug(t, "two"), "id") == ["t2"]
    assert column(M.list_tenants(t), "id") == ["t1", "t2"]
    assert M.tenant_by_id(t, "t9").count() == 0


def test_registered_services(spark):
    m = message_frame(spark, [{"service": "a"}, {"service": "b"}, {"service": "a", "tenant_id": "x"}])
    services = spark.createDataFrame([("default", "a"), ("default", "a"), ("x", "b")], "tenant_id string, name string")
    assert sorted((r["tenant_id"], r["service"]) for r in M.unknown_services(m, services).collect()) == [("default", "b"), ("x", "a")]
    assert M.known_services(m, services).count() == 1


def test_cascade(spark):
    t = tenants(spark, ("t1", "One", "one"), ("t2", "Two", "two"))
    child = spark.createDataFrame([("t1", 1), ("t2", 2)], "tenant_id string, n int")
    left, kept = M.cascade_delete(t, {"child": child}, t.where("id = 't1'"))
    assert column(left, "id") == ["t2"] and column(kept["child"], "n") == [2]


def test_seed(spark):
    have = spark.createDataFrame([("production", 1)], "name string, n int")
    new = spark.createDataFrame([("production", 2), ("staging", 2)], "name string, n int")
    assert sorted(map(tuple, M.seed_do_nothing(have, new).collect())) == [("production", 1), ("staging", 2)]


@pytest.mark.parametrize("condition,fires", [("gt", False), ("gte", True)])
def test_alerts(spark, condition, fires):
    import datetime as dt

    now = at("2026-08-28T10:00:00")
    ages = [0, 59, 299, 300, 301, 3000]  # seconds
    m = message_frame(spark, [{"ingested_at": now - dt.timedelta(seconds=s)} for s in ages] + [{"level": "INFO"}])
    rules = spark.createDataFrame(
        [("r1", "five minutes", "svc-1", condition, 3, 5, True), ("r2", "off", "svc-1", "gte", 0, 5, False), ("r3", "quiet", "svc-9", "gte", 1, 5, True)],
        "id string, name string, service string, condition string, threshold int, window_minutes int, enabled boolean",
    )
    rows = {r["id"]: (r["errors"], r["fires"]) for r in M.alert_evaluation(m, rules, now).collect()}
    assert rows == {"r1": (3, fires), "r3": (0, False)}


def test_alert_windows_against_brute_force(spark):
    import datetime as dt
    import random

    rng = random.Random(5)
    now = at("2026-08-28T10:00:00")
    ages = [(f"svc-{rng.randint(0, 2)}", rng.choice([0, 59, 60, 61, 119, 120, 600, rng.randint(0, 4000)])) for _ in range(80)]
    m = message_frame(spark, [{"service": s, "ingested_at": now - dt.timedelta(seconds=a)} for s, a in ages])
    rows = [(f"r{i}", f"svc-{i % 4}", rng.randint(1, 70)) for i in range(40)]
    rules = spark.createDataFrame(
        [(i, i, s, "gte", 1, w, True) for i, s, w in rows],
        "id string, name string, service string, condition string, threshold int, window_minutes int, enabled boolean",
    )
    got = {r["id"]: r["errors"] for r in M.alert_evaluation(m, rules, now).collect()}
    assert got == {i: sum(1 for s2, a in ages if s2 == s and a < w * 60) for i, s, w in rows}


def test_app_services(spark):
    apps = spark.createDataFrame([("a1", "shop")], "id string, name string")
    envs = spark.createDataFrame([("e1", "prod")], "id string, name string")
    services = spark.createDataFrame(
        [("s2", "a1", "e1", "zeta", T0), ("s1", "a1", "e1", "api", T0), ("s3", "a1", "none", "x", T0)],
        "id string, application_id string, environment_id string, name string, created_at timestamp",
    )
    rows = M.services_with_app_env(services, apps, envs).collect()
    assert [(r["name"], r["app_name"], r["env_name"]) for r in rows] == [("api", "shop", "prod"), ("zeta", "shop", "prod")]


def test_reconcile(spark):
    sent = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "doc_id string")
    stored = spark.createDataFrame([("a",), ("a",), ("b",), ("z",)], "doc_id string")
    assert M.reconcile_counts(sent, stored).first().asDict() == {"submitted": 4, "stored": 4, "missing": 1, "duplicates": 1, "unexpected": 1}
    assert column(M.missing_documents(sent, stored), "doc_id") == ["c"]


def test_metadata_files_keep_the_fixed_schema(spark, root):
    source.write_metadata_files(tenants(spark, ("t1", "One", "one")), root, "tenants")
    back = source.read_metadata_files(spark, root, "tenants")
    assert back.schema == TENANTS and back.count() == 1
    assert back.select(F.col("created_at")).first()[0] is not None
