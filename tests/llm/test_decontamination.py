import collections
import itertools
import re

from pyspark.sql import functions as F

from conftest_llm import words
from tidelog.llm import catalog
from tidelog.llm import decontamination as D

BENCH = "item_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_masks_miss_no_placement():
    """Every way to place the allowed replaced words leaves room for one of the masks."""
    for n in range(D.MIN_WORDS, D.WINDOW + 1):
        for bad in itertools.combinations(range(n), D.allowed(n)):
            fits = any(
                all(mask[i] == "0" or at + i not in bad for i in range(len(mask)))
                for mask in D.MASKS
                for at in range(n - len(mask) + 1)
            )
            assert fits, (n, bad)


def test_short_items_are_found_word_for_word(spark, docs_of):
    bench = spark.createDataFrame([(1, "one two three"), (2, "One, two"), (3, "three"), (4, "two one")], BENCH)
    texts = ["zero one TWO three four", "one x two", "one-two", "three", "two three", "onetwo"]
    got = {(r.doc_id, r.item_id, r.window, r.matched) for r in D.contaminated(docs_of(texts), bench).collect()}
    assert got == {(0, 1, 3, 3), (0, 2, 2, 2), (0, 3, 1, 1), (2, 2, 2, 2), (3, 3, 1, 1), (4, 3, 1, 1)}


def test_one_item_under_many_ids_and_one_text_with_many_hits(spark, docs_of, rng):
    item = words(rng, 12, 5000)
    bench = spark.createDataFrame([(i, item) for i in range(50)], BENCH)
    got = D.contaminated(docs_of([" ".join([item] * 40), item[5:]]), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, i) for d in range(2) for i in range(50)} and len(got) == 100


def brute(texts, items):
    out = {}
    for k, text in enumerate(texts):
        d = WORD.findall((text or "").lower())
        places = {}
        for at, w in enumerate(d):
            places.setdefault(w, []).append(at)
        for key, item in items:
            q = WORD.findall((item or "").lower())
            if not q:
                continue
            win = min(D.WINDOW, len(q))
            best = 0
            agree = collections.Counter(at - p for p, w in enumerate(q) for at in places.get(w, []))
            for off in (o for o, n in agree.items() if n >= win - D.allowed(win)):
                same = [0 <= p + off < len(d) and d[p + off] == w for p, w in enumerate(q)]
                best = max([best, *(sum(same[s : s + win]) for s in range(len(q) - win + 1))])
            if best >= win - D.allowed(win):
                out[k, key] = (win, best)
    return out


def test_against_all_alignments(spark, docs_of, rng):
    items = [(i, words(rng, n, 60)) for i, n in enumerate([7, 8, 9, 11, 12, 13, 15, 16, 17, 30, 60])]
    items += [(20 + n, words(rng, n, 9)) for n in (1, 2, 3, 3, 5)] + [(40, items[4][1]), (90, None), (91, ""), (3, "short one"), (92, "never?")]
    texts = [words(rng, 50, 60), "", None, "w1x"]
    for _, item in items[:11]:
        for edits in range(6):
            w = item.split()
            for at in rng.sample(range(len(w)), min(edits, len(w))):
                w[at] = f"new{rng.randrange(99)}"
            cut = rng.randrange(3)
            texts.append(words(rng, rng.randrange(5), 60) + ", " + " ".join(w[cut:]).upper() + ".\n" + words(rng, 4, 60))
    df, bench = docs_of(texts), spark.createDataFrame(items, BENCH)
    got = {(r.doc_id, r.item_id): (r.window, r.matched) for r in D.contaminated(df, bench).collect()}
    want = brute(texts, items)
    assert got == want and len(want) > 20 and {win for win, _ in want.values()} >= {1, 2, 8, 12, 16}
    left = {r.doc_id for r in D.drop_contaminated(df, bench).collect()}
    assert left == set(range(len(texts))) - {k for k, _ in want}


def test_shuffled_when_the_benchmark_is_large(spark, docs_of, rng, monkeypatch):
    items = [(i, words(rng, 20, 60)) for i in range(3)] + [(9, "w1x w2x")]
    texts = [words(rng, 5) + " " + items[i % 3][1] for i in range(6)] + ["a W1x, w2x b"]
    monkeypatch.setattr(D, "MAX_BROADCAST", 1)
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs_of(texts), spark.createDataFrame(items, BENCH)).collect()}
    assert got >= {(i, i % 3) for i in range(6)} | {(6, 9)}


def test_odd_empty_and_clashing(spark, odd, docs_of, rng):
    item = words(rng, 20)
    bench = spark.createDataFrame([(1, item), (None, item), (1, item)], BENCH)
    assert D.contaminated(odd, bench).count() == 0
    assert D.drop_contaminated(odd, bench).exceptAll(odd).count() == 0 and D.drop_contaminated(odd, bench).count() == odd.count()
    none = spark.createDataFrame([], BENCH)
    assert D.contaminated(docs_of([item]), none).count() == 0 and D.drop_contaminated(docs_of([item]), none).count() == 1
    assert D.contaminated(docs_of([]), bench).count() == 0 and D.drop_contaminated(docs_of([]), bench).count() == 0
    df = docs_of([item, (None, item), (None, item)]).withColumns({c: F.lit("z") for c in ("row_key", "seed", "item_id", "_bad_row", "words")})
    assert {(r.doc_id, r.item_id) for r in D.contaminated(df, bench).collect()} == {(0, 1), (0, None), (None, 1), (None, None)}
    kept = D.drop_contaminated(df, bench)
    assert kept.columns == df.columns and kept.count() == 0


def test_plan_stays_native(spark):
    text = catalog.op10_decontamination(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Cartesian" not in text and "NestedLoop" not in text
