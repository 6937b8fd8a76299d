import random

import numpy as np
import pytest

from conftest_llm import words
from tidelog.llm import near_dedup as N
from tidelog.llm.components import connected_components
from tidelog.llm.scratch import Scratch
from tidelog.llm.shingles import shingle_set


def brute(rows, width, percent):
    """Component of every id by comparing all pairs of word shingle sets."""
    sets = {}
    for key, text in rows:
        w = (text or "").encode().lower().split()
        n = max(1, len(w) - width + 1)
        sets.setdefault(key, []).append({tuple(w[i : i + width]) for i in range(n)} if w else set())
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {k: root(k) for k in sets}


def family(rng, size, length=120):
    """A text and copies with ever more replaced words, on both sides of the threshold."""
    base = words(rng, length, 5000).split()
    out = [" ".join(base)]
    for i in range(size):
        copy = list(base)
        for at in rng.sample(range(length), i % 9):
            copy[at] = f"edit{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("width", [4, 5])
def test_against_all_pairs(spark, docs_of, rng, width):
    texts = family(rng, 25) + family(rng, 25, 30) + [words(rng, 3), words(rng, 60), "", None, "one two", "ONE two", "Été a b c", "été a b c"]
    texts += texts[:4]
    rng.shuffle(texts)
    got = {r.doc_id: r for r in N.near_duplicates(docs_of(texts), width=width).collect()}
    want = brute(list(enumerate(texts)), width, 80)
    assert {k: r.component_id for k, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert {k: r.n_shingles for k, r in got.items()} == {k: len(shingle_set(t, width)) for k, t in enumerate(texts)}


def test_small_tiles_and_chains(docs_of, rng):
    """Copies of copies: neighbours are linked, ends are not; tiles of three members change nothing."""
    chain, text = [], words(rng, 100, 5000).split()
    for i in range(14):
        text = list(text)
        text[(7 * i) % 100] = f"step{i}"
        chain.append(" ".join(text))
    texts = chain + family(rng, 20)
    want = brute(list(enumerate(texts)), 5, 80)
    for tile in (3, 192):
        got = {r.doc_id: r.component_id for r in N.near_duplicates(docs_of(texts), tile=tile).collect()}
        assert got == want


def test_odd_rows(odd):
    rows = N.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert all(r.n_shingles == 0 and r.kept for r in rows if r.doc_id in (0, 1, 2))
    by_id = {r.doc_id: r.component_id for r in rows}
    assert by_id[10] == by_id[11] == 10
    kept = N.keep_one(odd).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    assert sum(r.doc_id is None for r in kept) == 2


def test_empty_and_clashing_columns(spark, docs_of):
    empty = docs_of([])
    assert N.near_duplicates(empty).count() == 0 and N.keep_one(empty).count() == 0
    df = docs_of(["a b c d e f", "a b c d e f"])
    for name in ("bands", "rep", "set_key", "component_id", "hashes"):
        df = df.withColumn(name, df.lang)
    assert [r.component_id for r in N.near_duplicates(df).collect()] == [0, 0]
    assert N.keep_one(df).columns == df.columns


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(3)
    sketcher = N.Sketcher()
    for n in (8, 40, 2000):
        agree = []
        for _ in range(60):
            pool = np.sort(rng.integers(0, 2**64, n, dtype=np.uint64))
            drop = pool[rng.permutation(n)[: max(1, n // 8)]]
            other = np.setdiff1d(pool, drop)
            agree.append((sketcher.sketch(pool) == sketcher.sketch(other)).mean())
        true = (n - max(1, n // 8)) / n
        assert abs(np.mean(agree) - true) < 0.06


def test_components_against_union_find(spark):
    rng = random.Random(5)
    for n, m in ((1, 0), (40, 30), (200, 120), (60, 400)):
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(300, 330)]
        parent = {}

        def root(x, parent=parent):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for a, b in links:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
        got = connected_components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "cc-test")).collect()
        nodes = {x for a, b in links if a != b for x in (a, b)}
        assert {r.node: r.component for r in got} == {x: root(x) for x in nodes}
        assert len(got) == len(nodes)
