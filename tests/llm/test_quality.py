import collections
import math

import pytest
from pyspark.sql import functions as F

from conftest_llm import words
from tidelog.llm import quality as Q

LABELS = "doc_id long, quality int, toxic int"


def corpus(rng, n, shift=0):
    """Good prose, poor shouting, and prose with one of two bad words; every second row is labelled."""
    texts, labels = [], []
    for i in range(n):
        text = words(rng, 40 + rng.randrange(200), 3000).replace("x", "").capitalize() + "."
        kind = i % 5
        if kind == 0:
            text = text.upper().replace(" ", "!! ")
        if kind == 1:
            text = text + " " + ("nasty" if i % 2 else "vile") + " end."
        texts.append((i + shift, text))
        labels.append((i + shift, int(kind != 0), int(kind == 1)))
    return texts, labels


def test_held_out_accuracy(spark, docs_of, rng):
    texts, labels = corpus(rng, 600)
    rows = Q.score(docs_of(texts), spark.createDataFrame(labels[::2], LABELS)).collect()
    want = {k: bool(q and not t) for k, q, t in labels}
    held_out = [r for r in rows if r.doc_id % 2]
    assert len(rows) == 600
    assert sum(r.keep == want[r.doc_id] for r in held_out) / len(held_out) > 0.97
    kept = {r.doc_id for r in Q.keep_good(docs_of(texts), spark.createDataFrame(labels[::2], LABELS)).collect()}
    assert kept == {r.doc_id for r in rows if r.keep}


def test_sparse_sites_shrink_toward_the_level_above(spark, docs_of, rng):
    texts, labels = corpus(rng, 400)
    good, poor = [t for t in texts if t[0] % 5 > 1], [t for t in texts if t[0] % 5 == 0]
    rows = [(i, good[i % len(good)][1], "big good") for i in range(120)] + [(200 + i, poor[i % len(poor)][1], "big poor") for i in range(120)]
    rows += [(500, good[0][1], "one good"), (501, poor[0][1], "one poor")]
    df = spark.createDataFrame([(k + 10_000, t, "en", s) for k, t, s in rows] + [(k, t, "en", "mixed") for k, t in texts], "doc_id long, text string, lang string, source string")
    out = {r.doc_id: r for r in Q.score(df, spark.createDataFrame(labels, LABELS)).collect()}
    big_good, big_poor, one_good, one_poor = (out[10_000 + k].host_rate for k in (0, 200, 500, 501))
    assert big_poor < one_poor < one_good < big_good
    assert one_good - one_poor < 0.8 * (big_good - big_poor)


def test_without_labels_everything_stays(spark, odd, docs_of):
    none = spark.createDataFrame([], LABELS)
    assert Q.keep_good(odd, none).count() == odd.count()
    assert Q.keep_good(docs_of([]), none).count() == 0
    one_class = spark.createDataFrame([(4, 1, 0), (5, 1, None), (None, 0, 1), (6, None, 1)], LABELS)
    assert Q.keep_good(odd, one_class).exceptAll(odd).count() == 0


def test_odd_rows_and_clashing_columns(spark, docs_of, rng):
    texts, labels = corpus(rng, 60)
    texts += [(None, None), (None, ""), (7, texts[7][1]), (900, "word " * 50_000)]
    labels += [(0, 1, 0), (0, 0, 0)]
    df = docs_of(texts).withColumns({c: F.lit("z") for c in ("host", "path", "row_key", "p_doc", "row", "keep", "good", "rate")})
    labels = spark.createDataFrame(labels, LABELS)
    kept = Q.keep_good(df, labels)
    assert kept.columns == df.columns
    assert Q.score(df, labels).count() == df.count()
    assert {r.doc_id for r in kept.collect()} <= {k for k, _ in texts}


def strength(groups):
    """Pseudo-counts by moments; ``groups`` are ``(n, mean, prior)``."""
    n = [g[0] for g in groups]
    level = sum(p * (1 - p) for _, _, p in groups) / len(groups)
    spread = sum(k * (m - p) ** 2 for k, m, p in groups) - sum(p * (1 - p) for _, _, p in groups)
    between = spread / max(sum(n) - sum(k * k for k in n) / sum(n), 1.0)
    return max(1.0, min(1e6, level / between - 1 if between > 1e-12 else 1e6))


def posteriors(rows):
    """Rates and scores in plain Python, from ``(host, path, probability)`` of each document."""
    def logit(p):
        p = max(1e-6, min(1 - 1e-6, p))
        return math.log(p / (1 - p))

    hosts, paths = collections.defaultdict(list), collections.defaultdict(list)
    for host, path, p in rows:
        hosts[host].append(p)
        paths[host, path].append(p)
    rate = sum(p for *_, p in rows) / len(rows)
    k = strength([(len(v), sum(v) / len(v), rate) for v in hosts.values()])
    of_host = {h: (sum(v) + k * rate) / (len(v) + k) for h, v in hosts.items()}
    k = strength([(len(v), sum(v) / len(v), of_host[h]) for (h, _), v in paths.items()])
    of_site = {s: (sum(v) + k * of_host[s[0]]) / (len(v) + k) for s, v in paths.items()}
    return [(of_host[h], of_site[h, s], 1 / (1 + math.exp(-(logit(p) + logit(of_site[h, s]) - logit(rate))))) for h, s, p in rows]


def test_posteriors_against_plain_python(spark, rng):
    """Hosts and paths of very different sizes, null ones among them, one host with a third of all documents."""
    texts, labels = corpus(rng, 300)
    rows = []
    for i, (k, text) in enumerate(texts):
        host = "hot" if i % 3 == 0 else rng.choice(["good" if k % 5 > 1 else "poor", None, f"rare{i}"])
        rows.append((k, text, rng.choice(["en", "de", None]), host))
    out = Q.score(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, LABELS)).collect()
    want = posteriors([(r.row_key.host, r.row_key.path, r.p_doc) for r in out])
    for r, (host_rate, site_rate, score) in zip(out, want, strict=True):
        assert r.host_rate == pytest.approx(host_rate, abs=1e-9) and r.site_rate == pytest.approx(site_rate, abs=1e-9)
        assert r.score == pytest.approx(score, abs=1e-9) and (abs(score - 0.5) < 1e-9 or r.keep == (score >= 0.5))
    assert len({round(r.host_rate, 6) for r in out}) > 5 and len({r.keep for r in out}) == 2
