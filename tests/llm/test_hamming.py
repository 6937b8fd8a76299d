from pyspark.sql import functions as F

from tidelog.llm import hamming as H

VEC = "vec_id long, embedding array<float>"


def result(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.distance) for r in df.collect())


def plain(rows, queries, k):
    codes = {i: tuple(x > 0 for x in v) for i, v in rows if i is not None and v and None not in v}
    out = []
    for i, v in {i: v for i, v in queries if i is not None and v and None not in v}.items():
        near = sorted((sum((x > 0) != b for x, b in zip(v, w, strict=True)), j) for j, w in codes.items() if j != i and len(w) == len(v))
        out += [(i, r + 1, j, d) for r, (d, j) in enumerate(near[:k])]
    return sorted(out)


def vectors(rng, n, bits, hot=0):
    rows = [(i, [rng.uniform(-1, 1) for _ in range(bits)]) for i in range(n)]
    base = [rng.uniform(-1, 1) for _ in range(bits)]
    return rows + [(n + i, list(base)) for i in range(hot)]


def test_against_all_pairs(spark, rng):
    rows = vectors(rng, 120, 40, hot=60)
    queries = rows[::17]
    got = result(H.top_k(spark.createDataFrame(rows, VEC), spark.createDataFrame(queries, VEC), 5))
    assert got == plain(rows, queries, 5)


def test_odd_lengths_nulls_and_few_rows(spark, rng):
    rows = vectors(rng, 6, 20) + [(50, None), (51, []), (None, [1.0] * 20), (52, [1.0, None]), (53, [0.5] * 7), (0, None)]
    rows.append(rows[2])
    got = result(H.top_k(spark.createDataFrame(rows, VEC).withColumn("code", F.lit("clash")), spark.createDataFrame(rows, VEC), 3))
    assert got == plain([r for r in rows if r[1]], [r for r in rows if r[1]], 3)
    none = spark.createDataFrame([], VEC)
    assert H.top_k(none, none).count() == 0
    assert H.top_k(spark.createDataFrame(rows, VEC), none).count() == 0
