import collections
import hashlib
import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tidelog.llm import catalog
from tidelog.llm import mixing as M


def slots(sources):
    """Blocks ``(source, its block)`` in order: earliest deadline first, slot by slot; sources are ``(w, b)``."""
    done, out = [0] * len(sources), []
    while any(d < b for d, (_, b) in zip(done, sources, strict=True)):
        left = {i: b - done[i] for i, (_, b) in enumerate(sources) if done[i] < b}
        share = {i: Fraction(sources[i][0], sum(sources[k][0] for k in left)) for i in left}
        until, got, t = min(math.floor(left[i] / share[i]) for i in left), dict.fromkeys(left, 0), 0
        while t < until or (t == until and any(math.floor(left[i] / share[i]) == until and got[i] < left[i] for i in left)):
            due, i = min((math.ceil((got[i] + 1) / share[i]), i) for i in left if math.floor(got[i] / share[i]) <= t)
            assert t < due
            out.append((i, done[i] + got[i]))
            got[i], t = got[i] + 1, t + 1
            assert all(abs(got[k] - t * share[k]) < 1 for k in left)
        for i in left:
            done[i] += got[i]
    return out


def brute(rows, block, weights=None):
    """The mixture in plain Python."""
    by = collections.defaultdict(list)
    for key, source in rows:
        by[source].append((hashlib.md5(("" if key is None else str(key)).encode()).hexdigest(), key is not None, key or 0))
    if weights is None:
        weights = {s: math.sqrt(len(v)) for s, v in by.items()}
    by = {s: sorted(v) for s, v in by.items() if weights.get(s, 0) > 0}
    names = sorted(by, key=lambda s: (s is not None, s))
    total = sum(weights[s] for s in names)
    out = {}
    for position, (i, n) in enumerate(slots([(max(1, math.floor(M.UNITS * (weights[s] / total) + 0.5)), -(-len(by[s]) // block)) for s in names])):
        for place, (_, there, key) in enumerate(by[names[i]][n * block : (n + 1) * block]):
            out[key if there else None, names[i]] = (n, position, place)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string")


def result(df):
    return {(r.doc_id, r.source): (r.source_block, r.position, r.place) for r in df.collect()}


def test_against_plain_loop(spark):
    rows = [(i, "a") for i in range(130)] + [(1000 + i, "b") for i in range(31)] + [(2000 + i, "c") for i in range(64)] + [(3000, "d"), (3001, None), (None, "a")]
    got = result(M.mix(frame(spark, rows), block=4))
    assert got == brute(rows, 4)
    assert sorted({p for _, p, _ in got.values()}) == list(range(1 + max(p for _, p, _ in got.values())))


def test_target_weights(spark):
    rows = [(i, f"s{i % 3}") for i in range(300)] + [(i, "left out") for i in range(900, 910)]
    weights = {"s0": 0.7, "s1": 0.2, "s2": 0.1}
    got = result(M.mix(frame(spark, rows), weights, block=2))
    assert got == brute(rows, 2, weights)
    assert not any(s == "left out" for _, s in got)


@pytest.mark.parametrize("span, piece", [(M.SPAN, M.PIECE), (16, 5), (9, 2)])
def test_pieces_meet_in_the_state_of_one_run(spark, monkeypatch, span, piece):
    """Pieces that start anywhere, after a run over the slots before, give the schedule of one run from the start."""
    monkeypatch.setattr(M, "SPAN", span)
    monkeypatch.setattr(M, "PIECE", piece)
    rng = random.Random(span)
    for count in (1, 4, 15):
        sources = [(i, rng.choice([1, 2, 3, 50, 977, 10**6, 7**9]), rng.randrange(1, 90)) for i in range(count)]
        got = sorted((r.position, r.s, r.source_block) for r in M.schedule(spark.createDataFrame(sources, "s int, w long, b long")).collect())
        assert got == [(p, i, n) for p, (i, n) in enumerate(slots([(w, b) for _, w, b in sources]))]


def test_many_small_sources_beside_a_large_one(spark):
    small = {f"s{i}": 0.005 for i in range(100)}
    rows = [(i, "a") for i in range(500)] + [(i, s) for s in small for i in range(6)]
    got = result(M.mix(frame(spark, rows), {"a": 0.5, **small}, block=1))
    assert got == brute(rows, 1, {"a": 0.5, **small})


def test_less_than_one_block_from_unrounded_weights_over_millions(spark):
    """Three million rows, a third of them in one source, until the first source runs out; weights are roots."""
    sizes = [1_000_000] + [int(2_000_000 * k / 190) for k in range(1, 20)]
    roots = [math.sqrt(n) for n in sizes]
    df = spark.createDataFrame([(str(k), n) for k, n in enumerate(sizes)], "source string, n long")
    blocks = M.shares(df, None).select(F.col("source").cast("int").alias("s"), "w", F.expr("(n + 15) div 16").alias("b"))
    order = [r.s for r in M.schedule(blocks).orderBy("position").collect()]
    assert len(order) == sum(-(-n // 16) for n in sizes)
    done, worst, total = [0] * len(sizes), 0, sum(roots)
    for t, s in enumerate(order, 1):
        done[s] += 1
        worst = max(worst, *(abs(n - t * root / total) for n, root in zip(done, roots, strict=True)))
        if done[s] == -(-sizes[s] // 16):
            break
    assert t > 5_000 and worst < 1


def test_rows_come_out_once(spark):
    rows = [(i, f"s{i * i % 7}") for i in range(700)] + [(None, None), (900, "one")]
    got = M.mix(frame(spark, rows), block=4).collect()
    assert len(got) == len(rows) and sorted({r.position for r in got}) == list(range(1 + max(r.position for r in got)))


def test_odd_empty_and_clashing(spark, odd):
    out = M.mix(odd)
    assert out.count() == odd.count()
    assert out.select("position", "place", "source").distinct().count() == odd.count()
    assert M.mix(frame(spark, [])).count() == 0
    df = odd.withColumns({c: F.lit(5) for c in ("position", "place", "s", "k", "j", "u", "b", "n", "phase", "before", "slot", "start")})
    again = M.mix(df)
    assert again.count() == odd.count()
    assert [c for c in again.columns if c not in M.ADDED] == [c for c in df.columns if c not in M.ADDED]


def test_plan_stays_native(spark):
    text = catalog.op3_mixing(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Cartesian" not in text and "NestedLoop" not in text
