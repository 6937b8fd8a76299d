import collections
import random

import pytest
from pyspark.sql import functions as F

from conftest_llm import words
from tidelog.llm import repeats as R


def brute(texts):
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(raw[i : i + R.LENGTH] for raw in raws for i in range(len(raw) - R.LENGTH + 1))
    out = []
    for raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - R.LENGTH + 1):
            if seen[raw[i : i + R.LENGTH]] > 1:
                gone[i : i + R.LENGTH] = b"\x01" * R.LENGTH
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone, strict=True) if not g)))
    return out


def fixture(rng):
    passage = [words(rng, n, 5000) for n in (33, 60, 150)]
    texts = ["", None, "short", "a" * 199, "b" * 200, "c" * 201, "ab" * 300, "xyz" * 100 + "q" + "xyz" * 100, "é🙂" * 90]
    for i in range(40):
        texts.append(words(rng, rng.randrange(80), 5000) + " " + passage[i % 3] + " " + words(rng, rng.randrange(80), 5000))
    base = words(rng, 200, 5000).split()
    for i in range(30):
        copy = list(base)
        for at in rng.sample(range(200), i % 7):
            copy[at] = f"edit{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    return texts + texts[10:13] + [words(rng, 100, 5000)]


@pytest.mark.parametrize("limits", [{}, {"GATHER": 2}, {"BLOCK": 300}, {"LONGEST": 300, "BLOCK": 1}])
def test_against_all_strings(docs_of, rng, monkeypatch, limits):
    """Also with every shared anchor counted across the cluster, and with few texts or parts of texts ranked at once."""
    texts = fixture(rng)
    if "GATHER" in limits or not limits:
        for name, value in limits.items():
            monkeypatch.setattr(R, name, value)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in R.remove_repeats(docs_of(texts)).collect()}
        assert [got[i] for i in range(len(texts))] == brute(texts)
        return
    raws = [(t or "").encode() for t in texts]
    one = [R.runs_of([raw]) for raw in raws]
    for name, value in limits.items():
        monkeypatch.setattr(R, name, value)
    together = R.runs_of(raws)
    assert [sum(r[3] + 1) for r in one] == [sum(together[3][together[0] == i] + 1) for i in range(len(raws))]
    if "LONGEST" not in limits:
        for k in range(1, 6):
            assert [x for r in one for x in r[k]] == list(together[k])


def test_runs_cover_every_position(rng):
    raws = [words(random.Random(1), 500).encode(), b"", b"x" * 250, b"short", words(random.Random(2), 90).encode()]
    owner, anchor, first, more, off, _ = R.runs_of(raws)
    for i, raw in enumerate(raws):
        mine = owner == i
        covered = [p for a, m in zip(first[mine], more[mine], strict=True) for p in range(a, a + m + 1)]
        assert covered == list(range(len(raw) - R.LENGTH + 1))
        grams = R.gram_ranks(__import__("numpy").frombuffer(raw, "uint8")) if mine.any() else []
        for a, m, o, h in zip(first[mine], more[mine], off[mine], anchor[mine], strict=True):
            assert grams[a + o] == h and a + m <= a + o <= a + R.WINDOW - 1


def test_removal_of_stretches():
    raw = bytes(range(256)) * 4
    assert R.remove(raw, []) == (0, 0, raw)
    assert R.remove(raw, [(0, 3), (100, 100), (500, 501)]) == (300 + 201, 2, raw[300:500] + raw[701:])


def test_odd_empty_and_clashing(odd, docs_of):
    rows = R.remove_repeats(odd.withColumns({c: F.lit(1) for c in ("row_key", "anchor", "packed", "kept")})).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[8].n_removed == 300_000 and by_id[9].n_removed == by_id[9].n_bytes and by_id[4].n_removed == 0
    assert R.remove_repeats(docs_of([])).count() == 0
    same = words(random.Random(2), 60)
    twice = R.remove_repeats(docs_of([(1, same), (1, same), (None, "other")])).collect()
    assert sorted(r.n_removed for r in twice) == [0, len(same), len(same)]
