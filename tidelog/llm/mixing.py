"""Sources interleaved to target weights by Pfair scheduling.

Rows of a source form blocks in a fixed random order.  With ``w`` its share of the
weights, its ``j``-th block (from 0) may not stand before slot ``floor(j / w)`` and has
to stand before slot ``ceil((j + 1) / w)``: the release time and the deadline of an
even flow.  Earliest deadline first among the released blocks, sources in order among equal
deadlines, meets all of them, so that every prefix holds each source's share to
less than one block.  When a source has run out, a new stretch begins in which the others
share all slots, still in proportion; every row comes out exactly once.  Shares are
integers over their sum, ``UNITS`` of them in all, and all arithmetic is exact.

Slots are many, so the schedule is made in pieces at once.  What has been done by a
moment differs from the even flow only in which of the open blocks are done, and how many
those are is known.  If at an earlier moment the open blocks of earliest deadline are
taken as done, all later deadlines are still met, and once the deadlines of
that moment's open blocks have passed, earliest deadline first has arrived at the very
state it would have had from the start: which blocks are open then depends on
releases since and on the number of open blocks only, not on which they were.  So a
piece starts from a run over the slots before it, as many as the longest time between release
and deadline, which is that of the smallest share.

Only sources (some numbers each) are gathered in one row; the table of blocks is joined to the
rows.  Everything is Spark expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.scratch import Scratch

ADDED = ("source_block", "position", "place")
BLOCK = 16
#: Sum of the shares as integers; a share is off by half of one at most, a prefix of T slots so by T / 2 ** 37 blocks.
UNITS = 2**36
#: Rows of the block table (24 bytes each) up to which it is broadcast.
MAX_BROADCAST_ROWS = 1_000_000
#: Slots scheduled by one task at least, and slots written out together.
SPAN, PIECE = 4_096, 256

_DECIMAL = "cast({} as decimal(20,0))"


def _times(a: str, b: str) -> str:
    return f"{_DECIMAL.format(a)} * {_DECIMAL.format(b)}"


def _job(j: str, x: str, due_units: str) -> str:
    """Block ``j`` of source ``x``, counted like ``rem`` from the moment a run begins; its deadline comes first, so that the least is picked."""
    return f"""named_struct('due', (({j} + 1) * {due_units} - {x}.rem + {x}.w - 1) div {x}.w, 's', {x}.s, 'release', ({j} * {due_units} - {x}.rem) div {x}.w,
        'j', {j}, 'w', {x}.w, 'rem', {x}.rem, 'first', {x}.first)"""


def _begin(active: str, units: str, at: str) -> str:
    """Jobs of all sources at slot ``at`` of a stretch: of the open blocks, those of earliest deadline count as done."""
    even = f"""transform({active}, x -> named_struct('s', x.s, 'w', x.w, 'first', x.first + cast({_times(at, 'x.w')} div {units} as bigint),
        'rem', cast(({_times(at, 'x.w')}) % {units} as bigint)))"""
    jobs = f"transform({even}, x -> {_job('0L', 'x', units)})"
    # As many open blocks are done as whole units of all remainders make.
    return f"""element_at(transform(array({jobs}), jobs -> transform(array_sort(jobs), (x, i) -> if(
        element_at(transform(array(cast(aggregate(jobs, cast(0 as decimal(38,0)), (t, y) -> cast(t + y.rem as decimal(38,0))) div {units} as bigint)), k ->
            aggregate(slice(array_sort(jobs), 1, i + 1), 0L, (t, y) -> t + if(y.rem > 0, 1L, 0L)) <= k), 1) and x.rem > 0,
        {_job('1L', 'x', units)}, x))), 1)"""


def _step(jobs: str, t: str, units: str, then: str) -> str:
    """``then``, an expression of ``after`` (the jobs) and ``pick``, after the released job of earliest deadline got slot ``t``."""
    after = f"transform({jobs}, x -> if(x.s = pick.s, {_job('(x.j + 1)', 'x', units)}, x))"
    return f"element_at(transform(array(array_min(filter({jobs}, x -> x.release <= {t}))), pick -> {then.replace('AFTER', after)}), 1)"


def _run(jobs: str, start: str, slots: str, units: str) -> str:
    """The jobs after some slots."""
    return f"aggregate(if({slots} <= 0, array(), sequence({start}, {start} + {slots} - 1)), {jobs}, (acc, t) -> {_step('acc', 't', units, 'AFTER')})"


def _let(value: str, name: str, then: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {then}), 1)"


def _horizon(active: str, units: str) -> str:
    """Slots after which no block open now can still be open."""
    return f"array_max(transform({active}, x -> {units} div x.w)) + 2"


def _stretches() -> str:
    """All stretches between two run-outs: first slot, number of slots, sum of the shares, and the sources in them.

    A stretch ends when the first source is due to have run out; if its last block is still open then, it has
    the next slot, as no other block can be due there.
    """
    left = "filter(transform(all, x -> named_struct('s', x.s, 'w', x.w, 'first', element_at(acc.done, x.s + 1), 'left', x.b - element_at(acc.done, x.s + 1))), x -> x.left > 0)"
    units = "aggregate(active, 0L, (t, x) -> t + x.w)"
    ends = f"array_min(transform(active, x -> cast({_times('x.left', 'units')} div x.w as bigint)))"
    warm = _let(f"greatest(0L, end - ({_horizon('active', 'units')}))", "base", f"named_struct('base', base, 'jobs', {_run(_begin('active', 'units', 'base'), '0L', '(end - base)', 'units')})")
    late = f"exists(jobs, x -> exists(active, y -> y.s = x.s and cast({_times('y.left', 'units')} div y.w as bigint) = end and x.first + x.j < y.first + y.left))"
    final = f"if({late}, {_step('jobs', '(end - at.base)', 'units', 'AFTER')}, jobs)"
    done = "transform(acc.done, (n, i) -> coalesce(get(transform(filter(jobs, x -> x.s = i), x -> x.first + x.j), 0), n))"
    entry = f"named_struct('start', acc.start, 'slots', end + if({late}, 1L, 0L), 'units', units, 'active', active)"
    inner = _let("at.jobs", "jobs", _let(entry, "entry", _let(final, "jobs", f"named_struct('done', {done}, 'start', acc.start + entry.slots, 'out', concat(acc.out, array(entry)))")))
    step = _let(left, "active", f"if(size(active) = 0, acc, {_let(units, 'units', _let(ends, 'end', _let(warm, 'at', inner)))})")
    kind = "array<struct<start:bigint,slots:bigint,units:bigint,active:array<struct<s:int,w:bigint,first:bigint,left:bigint>>>>"
    return f"aggregate(sequence(1, size(all)), named_struct('done', transform(all, x -> 0L), 'start', 0L, 'out', cast(array() as {kind})), (acc, n) -> {step}, acc -> acc.out)"


def schedule(sources: DataFrame) -> DataFrame:
    """``(s, source_block, position)`` of all blocks of ``sources (s, w, b)``.

    ``s`` numbers the sources from 0, ``w`` is the share as an integer above 0, ``b`` the number of blocks.
    """
    whole = sources.agg(F.expr("array_sort(collect_list(struct(s, w, b)))").alias("all")).where("size(all) > 0")
    stretches = whole.select(F.explode(F.expr(_stretches())).alias("x")).select("x.*")
    span = stretches.withColumn("span", F.expr(f"greatest({SPAN}L, {_horizon('active', 'units')})"))
    spans = span.select("*", F.explode(F.expr("sequence(0L, (slots - 1) div span)")).alias("part")).repartition(64, "start", "part")
    spans = spans.withColumns({"at": F.expr("part * span"), "many": F.expr("least(span, slots - part * span)")})
    spans = spans.withColumn("base", F.expr(f"greatest(0L, at - ({_horizon('active', 'units')}))"))
    spans = spans.withColumn("jobs", F.expr(_run(_begin("active", "units", "base"), "0L", "(at - base)", "units")))
    # The jobs at the start of every piece, then the picks of each piece.
    onward = _run("acc.jobs", f"(at - base + g * {PIECE}L)", f"least({PIECE}L, many - g * {PIECE}L)", "units")
    marks = f"""aggregate(sequence(0L, (many - 1) div {PIECE}), named_struct('jobs', jobs, 'out', array(named_struct('g', 0L, 'jobs', jobs))),
        (acc, g) -> {_let(onward, 'jobs', "named_struct('jobs', jobs, 'out', concat(acc.out, array(named_struct('g', g + 1, 'jobs', jobs))))")}, acc -> acc.out)"""
    pieces = spans.select("start", "units", "base", "at", "many", F.explode(F.expr(marks)).alias("mark")).select("start", "units", "base", "at", "many", "mark.*")
    pieces = pieces.where(f"g * {PIECE} < many").repartition(64, "start", "at", "g")
    one = _step("acc.jobs", "t", "units", "named_struct('jobs', AFTER, 'out', concat(acc.out, array(named_struct('t', t, 's', pick.s, 'source_block', pick.first + pick.j))))")
    slots = f"sequence(at - base + g * {PIECE}L, at - base + least((g + 1) * {PIECE}L, many) - 1)"
    picks = f"aggregate({slots}, named_struct('jobs', jobs, 'out', cast(array() as array<struct<t:bigint,s:int,source_block:bigint>>)), (acc, t) -> {one}, acc -> acc.out)"
    return pieces.select("start", "base", F.inline(F.expr(picks))).select("s", "source_block", F.expr("start + base + t").alias("position"))


def shares(sizes: DataFrame, weights: dict[str | None, float] | None) -> DataFrame:
    """``w``, the share of each source's weight in whole ``UNITS``, one at least; sources without a weight go."""
    if weights is None:
        weighted = sizes.withColumn("weight", F.sqrt(F.col("n").cast("double")))
    else:
        named = F.lit(0.0)
        for source, weight in weights.items():
            named = F.when(F.col("source").eqNullSafe(F.lit(source)), F.lit(float(weight))).otherwise(named)
        weighted = sizes.withColumn("weight", named).where("weight > 0")
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy(F.lit(1)))
    return weighted.withColumn("w", F.greatest(F.lit(1), F.floor(UNITS * share + 0.5)).cast("long")).drop("weight")


def _small(lookup: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, broadcast if it is within the bound, else joined by shuffle."""
    return F.broadcast(lookup) if lookup.count() <= MAX_BROADCAST_ROWS else lookup


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block: int = BLOCK) -> DataFrame:
    """``docs (doc_id, source, ...)`` with the place of every row in the mixture.

    ``source_block`` numbers the blocks of a source, ``position`` all blocks in the
    order of the mixture, ``place`` the rows in a block, all from 0; read in the
    order of ``position`` and ``place``.  ``weights`` maps sources to target
    weights; a source without one, or with 0, is not part of the mixture.  Without
    ``weights`` they are the square roots of the row counts.  Null is a source like
    any other; rows without an id and repeated rows are placed like others; an
    empty table gives an empty result.  Columns named like the added ones are
    replaced.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    docs = docs.drop(*ADDED)
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rest = F.xxhash64(*[c for c, kind in docs.dtypes if not kind.startswith("map")])
    rows = docs.select(
        F.struct(*docs.columns).alias("row"), "doc_id", "source", key.alias("_mix_key"), rest.alias("_mix_rest"), F.substring(key, 1, 3).alias("_mix_part")
    )

    # A source is ranked in up to 4,096 parts, by its part's rows and the rows of the parts before.
    parts = rows.groupBy("source", "_mix_part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("_mix_part")) - F.col("n")
    parts = scratch.write(parts.withColumn("before", before), "parts")
    sizes = parts.groupBy("source").agg(F.sum("n").alias("n"))
    blocks = shares(sizes, weights).withColumn("b", F.expr(f"(n + {block - 1}) div {block}"))
    sources = blocks.select((F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("source")) - 1).alias("s"), "source", "w", "b")
    sources = scratch.write(sources, "sources")
    plan = scratch.write(schedule(sources), "plan")

    in_part = F.row_number().over(Window.partitionBy("source", "_mix_part").orderBy("_mix_key", "doc_id", "_mix_rest"))
    ranked = rows.withColumn("_mix_in", in_part)
    same = lambda a, b, *names: [a[n].eqNullSafe(b[n]) for n in names]
    of_part = parts.join(sources, parts.source.eqNullSafe(sources.source)).select(parts.source, "_mix_part", "before", "s")
    placed = ranked.join(_small(of_part), same(ranked, of_part, "source", "_mix_part")).drop(of_part.source, of_part._mix_part)
    placed = placed.withColumn("_mix_rank", F.col("_mix_in") - 1 + F.col("before")).withColumn("source_block", F.expr(f"_mix_rank div {block}"))
    place = F.expr(f"_mix_rank - source_block * {block}").cast("int").alias("place")
    return placed.join(_small(plan), ["s", "source_block"]).select("row.*", "source_block", "position", place)
