"""Lookups, audits, batch changes and joins over tenant metadata.

Join sides are not hinted: Spark broadcasts one only when its measured size is
below ``spark.sql.autoBroadcastJoinThreshold`` and splits skewed keys otherwise.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.text import is_error, ws_trim
from tidelog.functions.times import as_timestamp
from tidelog.operators.components import connected_components
from tidelog.scratch import Scratch

# Statuses (fixed values).
ACTIVE = "active"
REVOKED = "revoked"

# ------------------------------------------------------------------ lookups


def lookup(df: DataFrame, **equal: str) -> DataFrame:
    """Rows whose columns equal the given values."""
    for name, value in equal.items():
        df = df.where(F.col(name) == value)
    return df


def tenant_by_id(tenants: DataFrame, tenant_id: str) -> DataFrame:
    return lookup(tenants, id=tenant_id)


def tenant_by_slug(tenants: DataFrame, slug: str) -> DataFrame:
    return lookup(tenants, slug=slug)


def service_by_name(services: DataFrame, tenant_id: str, name: str) -> DataFrame:
    return lookup(services, tenant_id=tenant_id, name=name)


def key_by_hash(keys: DataFrame, key_hash: str) -> DataFrame:
    return lookup(keys, key_hash=key_hash)


def policy_by_tenant(policies: DataFrame, tenant_id: str) -> DataFrame:
    return lookup(policies, tenant_id=tenant_id)


def list_tenants(tenants: DataFrame) -> DataFrame:
    return tenants.orderBy("created_at", "id")


def list_services(services: DataFrame, tenant_id: str) -> DataFrame:
    return lookup(services, tenant_id=tenant_id).orderBy("name", "id")


def list_keys(keys: DataFrame, tenant_id: str) -> DataFrame:
    return lookup(keys, tenant_id=tenant_id).orderBy("created_at", "id")


# --------------------------------------------------------------------- keys


def hash_key(raw_key: Column) -> Column:
    """SHA-256 of the trimmed key; only hashes are ever stored."""
    return F.sha2(ws_trim(raw_key), 256)


def key_is_valid(as_of: Column | str | dt.datetime) -> Column:
    """Active and not past its expiry; the expiry moment itself is still valid."""
    return (F.col("status") == ACTIVE) & (F.col("expires_at").isNull() | (F.col("expires_at") >= as_timestamp(as_of)))


def valid_keys(keys: DataFrame, as_of: Column | str | dt.datetime) -> DataFrame:
    return keys.where(key_is_valid(as_of))


def resolve_api_key(
    requests: DataFrame, keys: DataFrame, as_of: Column | str | dt.datetime, api_key: str = "api_key"
) -> DataFrame:
    """Stamp the tenant behind each request's key.

    ``key_state`` is ``ok``, ``unknown``, ``revoked`` or ``expired``; only ``ok``
    requests get a ``tenant_id``.
    """
    known = keys.select(
        "key_hash", "tenant_id", "status", key_is_valid(as_of).alias("_valid")
    ).withColumnRenamed("tenant_id", "_tenant")
    joined = requests.withColumn("key_hash", hash_key(F.col(api_key))).join(known, "key_hash", "left")
    state = (
        F.when(F.col("_tenant").isNull(), "unknown")
        .when(F.col("_valid"), "ok")
        .when(F.col("status") != ACTIVE, "revoked")
        .otherwise("expired")
    )
    stamped = joined.withColumn("key_state", state)
    stamped = stamped.withColumn("tenant_id", F.when(F.col("key_state") == "ok", F.col("_tenant")))
    return stamped.drop("_tenant", "_valid", "status", api_key)


# -------------------------------------------------------------------- joins


def registered_services(services: DataFrame) -> DataFrame:
    return services.select("tenant_id", F.col("name").alias("service")).distinct()


def unknown_services(events: DataFrame, services: DataFrame) -> DataFrame:
    """Events of a (tenant, service) that nobody registered."""
    return events.join(registered_services(services), ["tenant_id", "service"], "left_anti")


def known_services(events: DataFrame, services: DataFrame) -> DataFrame:
    return events.join(registered_services(services), ["tenant_id", "service"], "left_semi")


def services_with_app_env(app_services: DataFrame, applications: DataFrame, environments: DataFrame) -> DataFrame:
    """Services beside their application and environment, by name."""
    apps = applications.select(F.col("id").alias("application_id"), F.col("name").alias("app_name"))
    envs = environments.select(F.col("id").alias("environment_id"), F.col("name").alias("env_name"))
    joined = app_services.join(apps, "application_id").join(envs, "environment_id")
    return joined.select("id", "name", "app_name", "env_name", "created_at").orderBy("name", "id")


def alert_evaluation(messages: DataFrame, rules: DataFrame, as_of: Column | str | dt.datetime) -> DataFrame:
    """Enabled rules with the errors of their window and whether they fire.

    ``rules`` has ``service`` beside the rule columns; ``condition`` is ``gt`` or
    ``gte``.  Errors are counted per service and whole minute of age first: an
    error lies in a window of w minutes exactly when its age in whole minutes is
    below w.  The distinct windows are then laid between the ages, and one running
    sum per service answers all of them, so no rule is paired with any error.
    """
    now = F.unix_micros(as_timestamp(as_of))
    age = F.floor((now - F.unix_micros("ingested_at")) / F.lit(60_000_000))
    # Nothing older than the longest window is looked at.
    longest = rules.where("enabled").agg(F.max(F.col("window_minutes").cast("int"))).scalar()
    since = as_timestamp(as_of) - F.make_dt_interval(F.lit(0), F.lit(0), longest)
    errors = messages.where(is_error(F.col("level")) & (F.col("ingested_at") <= as_timestamp(as_of)) & (F.col("ingested_at") > since))
    ages = errors.groupBy("service", age.alias("age")).agg(F.count(F.lit(1)).alias("n"))
    active = rules.where("enabled")
    asked = active.select("service", F.col("window_minutes").cast("long").alias("age")).distinct()
    line = ages.withColumn("asked", F.lit(1)).unionByName(
        asked.withColumn("n", F.lit(0).cast("long")).withColumn("asked", F.lit(0))
    )
    younger = Window.partitionBy("service").orderBy("age", "asked").rowsBetween(Window.unboundedPreceding, 0)
    counted = line.withColumn("errors", F.sum("n").over(younger)).where("asked = 0")
    counted = counted.select("service", F.col("age").cast("int").alias("window_minutes"), "errors")
    joined = active.join(counted, ["service", "window_minutes"], "left")
    fires = F.when(F.col("condition") == "gt", F.col("errors") > F.col("threshold")).otherwise(
        F.col("errors") >= F.col("threshold")
    )
    return joined.select(
        "id", "name", "service", "condition", "threshold", "window_minutes", "errors", fires.alias("fires")
    )


def cascade_delete(
    tenants: DataFrame, children: dict[str, DataFrame], deleted: DataFrame
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Tenants and child tables without the tenants in ``deleted(id)``."""
    gone = deleted.select("id").distinct()
    owner = gone.withColumnRenamed("id", "tenant_id")
    kept = {name: child.join(owner, "tenant_id", "left_anti") for name, child in children.items()}
    return tenants.join(gone, "id", "left_anti"), kept


def seed_do_nothing(existing: DataFrame, new: DataFrame, key: str = "name") -> DataFrame:
    """``existing`` plus the rows of ``new`` whose key is not there yet."""
    fresh = new.join(existing.select(key).distinct(), key, "left_anti").dropDuplicates([key])
    return existing.unionByName(fresh.select(*existing.columns))


# -------------------------------------------------------------------- audit


def _finding(df: DataFrame, table: str, rule: str, key: Column) -> DataFrame:
    return df.select(F.lit(table).alias("table"), F.lit(rule).alias("rule"), key.cast("string").alias("key"))


def _blank(name: str) -> Column:
    return ws_trim(F.coalesce(F.col(name), F.lit(""))) == ""


def _repeated(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def metadata_audit(tenants: DataFrame, keys: DataFrame, services: DataFrame, policies: DataFrame) -> DataFrame:
    """Rows that break a rule of the metadata model: ``(table, rule, key)``."""
    owner = tenants.select(F.col("id").alias("tenant_id")).distinct()
    pair = F.concat_ws("/", "tenant_id", "name")
    findings = [
        _finding(tenants.where(_blank("name")), "tenants", "blank_name", F.col("id")),
        _finding(tenants.where(_blank("slug")), "tenants", "blank_slug", F.col("id")),
        _finding(_repeated(tenants, "slug"), "tenants", "duplicate_slug", F.col("slug")),
        _finding(_repeated(keys, "key_hash"), "api_keys", "duplicate_key_hash", F.col("key_hash")),
        _finding(services.where(_blank("tenant_id")), "services", "blank_tenant", F.col("id")),
        _finding(services.where(_blank("name")), "services", "blank_name", F.col("id")),
        _finding(_repeated(services, "tenant_id", "name"), "services", "duplicate_name", pair),
        _finding(policies.where(_blank("tenant_id")), "retention_policies", "blank_tenant", F.col("id")),
        _finding(policies.where("retention_days <= 0"), "retention_policies", "days_not_positive", F.col("id")),
        _finding(_repeated(policies, "tenant_id"), "retention_policies", "second_policy", F.col("tenant_id")),
    ]
    for name, child in {"api_keys": keys, "services": services, "retention_policies": policies}.items():
        orphans = child.where(~_blank("tenant_id")).join(owner, "tenant_id", "left_anti")
        findings.append(_finding(orphans, name, "orphan_tenant", F.col("id")))
    result = findings[0]
    for other in findings[1:]:
        result = result.unionByName(other)
    return result


# ------------------------------------------------------------ batch changes

#: Changes that hang on each other and are made by one task at a time; beyond it they are made piece by piece.
HOT = 1_000_000
SLICES = 256
_WRITES = ("create", "update")
_OPS = (*_WRITES, "delete", "revoke", "touch")
# Kinds of the rows a task walks through: what a key holds, how many rows hold a value, a change, an invalid one.
_KEY, _VALUE, _CHANGE, _INVALID = range(4)


def _in_turn(key: str, unique: list[str], emit: bool):
    """Makes the changes of each group one by one; its states come first.  With ``emit``, new states follow it."""
    key_state, value_state, invalid, writes = _KEY, _VALUE, _INVALID, _WRITES

    def walk(batches):
        import pyarrow as pa

        group, states, held, moved, made = None, {}, {}, {}, {}

        def new_states(schema):
            told = [(key_state, k, v, int(here)) for k, (here, v) in made.items()] + [(value_state, None, v, n) for v, n in moved.items() if n]
            columns = {"_group": [group] * len(told), "_kind": [t[0] for t in told], "_n": [t[3] for t in told], key: [t[1] for t in told]}
            for i, name in enumerate(unique):
                columns[name] = [t[1] if name == key and t[0] == key_state else t[2] and t[2][i] for t in told]
            arrays = [pa.array(columns.get(f.name, [None] * len(told)), f.type) for f in schema]
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        schema = None
        for batch in batches:
            schema = pa.schema([*[pa.field(f.name, f.type) for f in batch.schema], pa.field("outcome", pa.string())])
            values = zip(*[batch.column(c).to_pylist() for c in unique], strict=True) if unique else [None] * batch.num_rows
            outcomes = []
            names = ("_group", "_kind", "_n", "op", key)
            for (g, kind, n, op, k), value in zip(zip(*[batch.column(c).to_pylist() for c in names], strict=True), values, strict=True):
                if g != group:
                    if emit and (made or moved):
                        yield new_states(schema)
                    group, states, held, moved, made = g, {}, {}, {}, {}
                if kind == key_state:
                    states[k] = (n > 0, value)
                    outcomes.append(None)
                    continue
                if kind == value_state:
                    held[value] = n
                    outcomes.append(None)
                    continue
                if kind == invalid:
                    outcomes.append("invalid")
                    continue
                here, old = made.get(k) or states.get(k, (False, None))
                own = here and old == value
                taken = bool(unique) and op in writes and held.get(value, 0) + moved.get(value, 0) - own > 0
                if (here or taken) if op == "create" else (here and taken and op == "update"):
                    outcomes.append("exists")
                    continue
                if op != "create" and not here:
                    outcomes.append("not_found")
                    continue
                outcomes.append("ok")
                if op in writes:
                    made[k] = (True, value)
                    if not own:
                        moved[value] = moved.get(value, 0) + 1
                        if here:
                            moved[old] = moved.get(old, 0) - 1
                elif op == "delete":
                    made[k] = (False, old)
                    moved[old] = moved.get(old, 0) - 1
            told = pa.array(outcomes, pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, told], schema=schema).filter(told.is_valid())
        if emit and (made or moved):
            yield new_states(schema)

    return walk


def change_outcomes(
    snapshot: DataFrame, changes: DataFrame, unique: list[str], required: list[str], key: str = "id", positive: tuple[str, ...] = ()
) -> DataFrame:
    """Outcome of each change of a batch, as if they were made one by one: ok, exists, not_found or invalid.

    ``changes`` has ``seq, op`` beside the columns of ``snapshot``; ``seq`` is unique and orders them,
    ``op`` is create, update, delete, revoke or touch, ``key`` names the row.  A write without a
    value in a ``required`` column or not above zero in a ``positive`` one, an unknown ``op`` and a
    null key are invalid.  The ``unique`` columns together may belong to one row only: a write that
    takes the value another row has at that moment gets ``exists``.

    A change depends on what came before it on its key and on its unique value, and so on along both.
    Keys and values that meet in a change, or in a row that is changed, are linked; changes of different
    connected components do not touch each other.  Each component is walked through once, in the order
    of ``seq``, however long its changes hang on each other; a task streams its rows and holds what the
    component's keys and values are by then.  A component of more than ``HOT`` changes is walked in
    pieces of about that many, each by a new task that starts from the states the earlier ones left.
    Every piece is a written table.
    """
    spark = changes.sparkSession
    scratch = Scratch(spark, "changes", area="tidelog-changes")
    op = F.col("op")
    invalid = ~op.isin(*_OPS) | F.col(key).isNull()
    for name in required:
        invalid = invalid | (op.isin(*_WRITES) & _blank(name))
    for name in positive:
        invalid = invalid | (op.isin(*_WRITES) & ~(F.coalesce(F.col(name), F.lit(0)) > 0))
    # Nodes are hashes: two that fall together only make one component of two.
    of_key, of_value = F.xxhash64(F.lit("key"), key), F.xxhash64(F.lit("value"), *unique)
    rows = changes.withColumn("_kind", F.when(F.coalesce(invalid, F.lit(True)), _INVALID).otherwise(_CHANGE))
    rows = scratch.write(rows, "start")
    writes = F.lit(bool(unique)) & op.isin(*_WRITES)
    pairs = rows.where(F.col("_kind") == _CHANGE).groupBy(of_key.alias("a"), F.when(writes, of_value).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    pairs = scratch.write(pairs, "pairs")

    # Of the rows there are, those the batch can meet: what its keys hold, and how many hold its values.
    held = snapshot.groupBy(key).agg(F.min(F.struct(*unique)).alias("_first")) if unique else snapshot.select(key).distinct()
    others = [F.col(f"_first.{c}").alias(c) for c in unique if c != key]
    held = held.select(key, *others, F.lit(_KEY).alias("_kind"), F.lit(1).cast("long").alias("_n")).withColumn("a", of_key)
    held = scratch.write(held.join(pairs.select("a").distinct(), "a", "left_semi"), "held")
    links, states = pairs.select("a", "b"), held
    if unique:
        holders = snapshot.groupBy(*unique).agg(F.count(F.lit(1)).alias("_n")).withColumn("_kind", F.lit(_VALUE)).withColumn("a", of_value)
        holders = holders.join(pairs.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
        links = links.unionByName(held.select("a", of_value.alias("b")))
        states = states.unionByName(holders, allowMissingColumns=True)
    nodes = scratch.write(connected_components(links, scratch).withColumnRenamed("node", "a"), "nodes")

    def grouped(df: DataFrame) -> DataFrame:
        return df.join(nodes, "a", "left").withColumn("_group", F.coalesce("component", "a")).drop("a", "component")

    sizes = grouped(pairs).groupBy("_group").agg(F.sum("n").alias("n"))
    rows = grouped(rows.withColumn("_n", F.lit(None).cast("long")).withColumn("a", F.when(F.col("_kind") == _CHANGE, of_key).otherwise(F.xxhash64("seq"))))
    states, last = grouped(states), 0
    if (sizes.agg(F.max("n")).first()[0] or 0) > HOT:
        span = rows.agg(F.min("seq").alias("low"), F.max("seq").alias("high")).first()
        width = max(1, -(-(span["high"] - span["low"] + 1) // SLICES))
        rows = rows.withColumn("_slice", F.expr(f"(seq - {span['low']}L) div {width}L"))
        before = F.sum("n").over(Window.partitionBy("_group").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
        cuts = rows.where(F.col("_kind") == _CHANGE).join(sizes.where(F.col("n") > HOT).select("_group"), "_group", "left_semi")
        cuts = cuts.groupBy("_group", "_slice").agg(F.count(F.lit(1)).alias("n"))
        cuts = scratch.write(cuts.select("_group", "_slice", F.floor(F.coalesce(before, F.lit(0)) / HOT).cast("int").alias("_piece")), "cuts")
        rows = rows.join(cuts, ["_group", "_slice"], "left").withColumn("_piece", F.coalesce("_piece", F.lit(0))).drop("_slice")
        rows, states = scratch.write(rows, "rows", by="_piece"), scratch.write(states, "states")
        last = cuts.agg(F.max("_piece")).first()[0]

    columns = ["_group", "_kind", "_n", *changes.columns]
    told = None
    for piece in range(last + 1):
        here = rows.where(F.col("_piece") == piece).drop("_piece") if last else rows
        before = states if told is None else _latest(states, here, told.where(F.col("outcome").isNull()), key, unique)
        walked = here.unionByName(before, allowMissingColumns=True).select(*columns)
        walked = walked.repartition("_group").sortWithinPartitions("_group", "_kind", "seq")
        # All fields may be null in a state.
        schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in walked.schema], T.StructField("outcome", T.StringType())])
        walked = walked.mapInArrow(_in_turn(key, unique, emit=piece < last), schema)
        scratch.write(walked, f"walked/_at={piece}")
        told = spark.read.schema(schema.add("_at", T.IntegerType())).parquet(f"{scratch.root}/walked")
    return told.where(F.col("outcome").isNotNull()).select(*changes.columns, "outcome")


def _latest(states: DataFrame, here: DataFrame, left: DataFrame, key: str, unique: list[str]) -> DataFrame:
    """What the keys and values of ``here`` are after the pieces that ``left`` their states."""
    named = ["_group", "_kind", "_n", *dict.fromkeys([key, *unique])]
    states = states.select(*named, F.lit(-1).alias("_at")).unionByName(left.select(*named, "_at"))
    keys = states.where(F.col("_kind") == _KEY).join(here.select("_group", key).distinct(), ["_group", key], "left_semi")
    newest = F.max_by(F.struct("_n", *[c for c in unique if c != key]), "_at")
    keys = keys.groupBy("_group", key).agg(newest.alias("_new")).select("_group", key, F.lit(_KEY).alias("_kind"), "_new.*")
    if not unique:
        return keys
    asked = here.select("_group", F.struct(*unique).alias("_value")).distinct()
    values = states.where(F.col("_kind") == _VALUE).withColumn("_value", F.struct(*unique)).join(asked, ["_group", "_value"], "left_semi")
    values = values.groupBy("_group", "_value").agg(F.sum("_n").alias("_n")).select("_group", "_value.*", F.lit(_VALUE).alias("_kind"), "_n")
    return keys.unionByName(values, allowMissingColumns=True)


def apply_metadata_changes(
    snapshot: DataFrame,
    changes: DataFrame,
    unique: list[str],
    required: list[str],
    as_of: Column | str | dt.datetime,
    touch_column: str | None = None,
    key: str = "id",
    positive: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """(new snapshot, outcomes) of a batch of changes; the inputs are not modified.

    Of all changes of a key that are ok, the new row has the fields of its last create or update, the
    status of the last one that sets it, and the last touch; ``id`` and ``created_at`` are those of its
    creation.  A row deleted and made again is a new one.
    """
    outcomes = change_outcomes(snapshot, changes, unique, required, key, positive)
    now = as_timestamp(as_of)
    fixed = list(dict.fromkeys(["id", key, "created_at"]))
    fields = [c for c in snapshot.columns if c not in fixed]
    op, seq = F.col("op"), F.col("seq")

    def last(value: Column, *ops: str) -> Column:
        return F.max_by(value, F.when(op.isin(*ops), seq))

    done = outcomes.where(F.col("outcome") == "ok").groupBy(F.col(key).alias("_key")).agg(
        last(op, "create", "delete").alias("_set"),
        F.max(op == "delete").alias("_gone"),
        last(F.struct(*[c for c in fixed if c != "created_at"]), "create").alias("_made"),
        last(F.struct(op, *fields), *_WRITES).alias("_new"),
        last(F.struct(op), *_WRITES, "revoke").alias("_state"),
        *([last(F.struct(touch_column), "touch", "create").alias("_touch")] if touch_column else []),
    )
    # Written, as it is used twice, and its size known, so that few changed keys are broadcast and the snapshot stays where it is.
    done = Scratch(changes.sparkSession, "done", area="tidelog-changes").write(done, "keys")

    def value(name: str, old: Column) -> Column:
        wrote = F.col("_new").isNotNull()
        if name == "updated_at":
            return F.when(wrote, now).otherwise(old)
        if name == touch_column:
            return F.when(F.col("_touch").isNotNull(), F.col(f"_touch.{name}")).otherwise(old)
        if name == "status":
            given = F.coalesce(F.nullif(F.col("_new.status"), F.lit("")), F.lit(ACTIVE))
            return F.when(F.col("_state.op") == "revoke", F.lit(REVOKED)).when(wrote, given).otherwise(old)
        return F.when(wrote, F.col(f"_new.{name}")).otherwise(old)

    kept = snapshot.join(done, snapshot[key].eqNullSafe(done["_key"]), "left").where(~F.coalesce("_gone", F.lit(False)))
    kept = kept.select(*[F.col(c) if c in fixed else value(c, F.col(c)).alias(c) for c in snapshot.columns])
    kinds = {f.name: f.dataType for f in snapshot.schema.fields}
    made = done.where(F.col("_set") == "create")
    made = made.select(*[
        now.cast(kinds[c]).alias(c) if c == "created_at" else F.col(f"_made.{c}").alias(c) if c in fixed else value(c, F.lit(None).cast(kinds[c])).alias(c)
        for c in snapshot.columns
    ])
    return kept.unionByName(made), outcomes


# ------------------------------------------------------------- reconciliation


def reconcile_counts(submitted: DataFrame, stored: DataFrame) -> DataFrame:
    """Submitted, stored, missing and repeated ids of a run, each as one count.

    Both sides are reduced to one row per id before they meet, so an id that
    makes up a third of the data is a single row in the join.
    """
    # 16 bytes instead of 32 hex digits through the shuffle.
    sent = submitted.groupBy(F.unhex("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("sent"))
    kept = stored.groupBy(F.unhex("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("kept"))
    # The counts are partitioned by id already, so the join shuffles nothing.
    both = sent.join(kept, "id", "full_outer")
    return both.agg(
        F.coalesce(F.sum("sent"), F.lit(0)).alias("submitted"),
        F.coalesce(F.sum("kept"), F.lit(0)).alias("stored"),
        F.count_if(F.col("kept").isNull()).alias("missing"),
        F.count_if(F.col("kept") > 1).alias("duplicates"),
        F.count_if(F.col("sent").isNull()).alias("unexpected"),
    )


def missing_documents(accepted: DataFrame, stored: DataFrame) -> DataFrame:
    """Accepted ids that the store does not have."""
    return accepted.select("doc_id").distinct().join(stored.select("doc_id").distinct(), "doc_id", "left_anti")
