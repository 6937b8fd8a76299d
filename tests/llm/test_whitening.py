import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import catalog
from tidelog.llm import whitening as W

VECTOR = "vec_id long, embedding array<float>"


def brute(rows, components=8):
    """Plain numpy over the usable rows, exact parts in Python integers."""
    sizes = [len(e) for _, e in rows]
    size = max(set(sizes), key=lambda s: (sizes.count(s), s))
    rows = [(k, e) for k, e in rows if len(e) == size]
    x = [[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in e] for _, e in rows]
    n, total = len(x), [sum(c) for c in zip(*x, strict=True)]
    apart = [[n * v - s for v, s in zip(row, total, strict=True)] for row in x]
    centred = np.array([[v / n for v in row] for row in apart])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return [k for k, _ in rows], n, [sum(v * v for v in row) for row in apart], centred @ vectors / np.sqrt(values), values / np.trace(cov)


def check(got, rows, components=8):
    ids, n, deviation, white, share = brute(rows, components)
    k = white.shape[1]
    assert len(got) == len(ids) * k and {r.n for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    places = {}
    for i, vec in enumerate(ids):
        places.setdefault(vec, []).append(i)
    signs = [np.sign(sum(by[vec, c + 1][0].whitened * white[at[0], c] for vec, at in places.items())) for c in range(k)]
    for vec, at in places.items():
        for c in range(k):
            found = sorted((r.deviation, int(r.deviation_exact), r.whitened) for r in by[vec, c + 1])
            want = sorted((deviation[i], deviation[i], white[i, c] * signs[c]) for i in at)
            assert [f[:2] for f in found] == [w[:2] for w in want]
            assert np.allclose([f[2] for f in found], [w[2] for w in want], rtol=0, atol=1e-9)
            assert abs(by[vec, c + 1][0].explained - share[c]) <= 1e-9 * share[c]
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_whole_table_against_numpy(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    check(catalog.op12_whitening(spark, "/root/testdata/sf0.001").collect(), rows)


@pytest.mark.parametrize("least, tasks", [(7, 1), (16, 3)])
def test_many_blocks_far_from_zero(spark, monkeypatch, least, tasks):
    """Hundreds of entries around 900, blocks of a few rows, dealt over several tasks; few dimensions."""
    monkeypatch.setattr(W, "LEAST_ROWS", least)
    monkeypatch.setattr(W, "BLOCKS_A_TASK", tasks)
    rng = np.random.default_rng(5)
    rows = [(i % 150, [float(v) for v in 900 + rng.normal(size=5) @ np.diag([9, 5, 3, 2, 1])]) for i in range(200)]
    check(W.whiten(spark.createDataFrame(rows, VECTOR).repartition(5)).collect(), rows)
    check(W.whiten(spark.createDataFrame(rows, VECTOR), components=2).collect(), rows, components=2)


def test_hot_vector(spark):
    """A third of all rows are one vector."""
    rng = np.random.default_rng(6)
    rows = [(i, [0.5] * 9 if i % 3 == 0 else [float(v) for v in rng.normal(size=9)]) for i in range(120)]
    check(W.whiten(spark.createDataFrame(rows, VECTOR)).collect(), rows)


def test_unusable_rows_go(spark):
    rng = np.random.default_rng(7)
    good = [(i, [float(v) for v in rng.normal(size=3)]) for i in range(20)] + [(None, [0.5, 1.5, -2.0]), (4, [0.1, 0.2, 0.3]), (4, [0.1, 0.2, 0.3])]
    bad = [(50, None), (51, [1.0, None, 2.0]), (52, [1.0, float("nan"), 2.0]), (53, [float("inf"), 1.0, 1.0]), (54, []), (55, [1.0]), (56, [1e30, 0.0, 0.0])]
    df = spark.createDataFrame(good + bad, VECTOR).withColumns({c: F.lit("z") for c in ("x", "at", "index", "component", "n", "label", "apart", "w")})
    check(W.whiten(df).collect(), good)


def test_without_variance_dimensions_or_rows(spark):
    flat = W.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], VECTOR)).collect()
    assert len(flat) == 4
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in flat} == {(2, 0, None, None, None)}
    line = W.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(9)], VECTOR)).collect()
    by = {c: [r for r in line if r.component == c] for c in (1, 2, 3)}
    assert abs(by[1][0].explained - 1) < 1e-12 and all(r.whitened is not None for r in by[1])
    assert all(r.whitened is None and r.explained == 0 for c in (2, 3) for r in by[c]) and by[1][0].identity_error < 1e-9
    for rows in ([], [(1, [])], [(1, None)]):
        empty = W.whiten(spark.createDataFrame(rows, VECTOR))
        assert empty.count() == 0 and empty.columns == W.whiten(spark.createDataFrame([(1, [1.0])], VECTOR)).columns


def test_deviation_beyond_a_long(spark):
    big = 4.0e9
    got = W.whiten(spark.createDataFrame([(1, [big, 0.0]), (2, [-big, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")).collect()
    apart = 3 * 1024 * int(big)
    exact = {r.vec_id: int(r.deviation_exact) for r in got}
    assert exact == {1: apart**2 + 1024**2, 2: apart**2 + 1024**2, 3: 2048**2}
    assert {r.vec_id: r.deviation for r in got} == {1: None, 2: None, 3: 2048**2}
