import hashlib
import re

import pytest
import zstandard
from pyspark.sql import functions as F

from tidelog.llm import language as L

SYLLABLES = {"en": ["the", "tion", "ing", "and", "er"], "de": ["sch", "ung", "ein", "der", "keit"], "fr": ["eau", "que", "les", "ment", "oi"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy_and_margin(spark, rng):
    langs = list(SYLLABLES)
    train = [(i, text(rng, langs[i % 3], 80), langs[i % 3]) for i in range(90)]
    test = [(i, text(rng, langs[i % 3], 25), langs[i % 3]) for i in range(300)]
    dictionaries = L.learn(frame(spark, train))
    assert sorted(x for x, _ in dictionaries) == sorted(langs) and all(len(c) <= L.DICT_BYTES for _, c in dictionaries)
    rows = L.identify(frame(spark, test), dictionaries).collect()
    assert sum(r.lang_pred == langs[r.doc_id % 3] for r in rows) / 300 > 0.98
    assert all(0 <= r.score <= 1 for r in rows)
    mixed = L.identify(frame(spark, [(1, text(rng, "en", 300) + " " + text(rng, "de", 300), None)]), dictionaries).first()
    clear = L.identify(frame(spark, [(1, text(rng, "en", 600), None)]), dictionaries).first()
    assert mixed.score < clear.score and not clear.rejected


def test_labels_and_ids_are_no_inputs(spark, rng):
    dictionaries = L.learn(frame(spark, [(i, text(rng, lang, 60), lang) for i, lang in enumerate(list(SYLLABLES) * 5)]))
    body = text(rng, "fr", 30)
    rows = L.identify(frame(spark, [(1, body, "en"), (2, body, "de"), (None, body, None)]), dictionaries).collect()
    assert {(r.lang_pred, r.score) for r in rows} == {("fr", rows[0].score)}


def test_whole_texts_count(spark, rng):
    dictionaries = L.learn(frame(spark, [(i, text(rng, lang, 60), lang) for i, lang in enumerate(list(SYLLABLES) * 5)]))
    long = text(rng, "en", 2_000) + " " + text(rng, "de", 40_000)
    assert L.identify(frame(spark, [(1, long, None)]), dictionaries).first().lang_pred == "de"


def test_odd_and_empty(spark, odd, docs_of, rng):
    dictionaries = L.learn(frame(spark, [(i, text(rng, lang, 60), lang) for i, lang in enumerate(list(SYLLABLES) * 5)] + [(99, None, "xx"), (98, "123", "yy"), (None, "abc", "zz")]))
    assert {x for x, _ in dictionaries} == set(SYLLABLES)
    rows = L.identify(odd.withColumn("score", F.lit(1)), dictionaries).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if r.doc_id in (0, 1, 2, 7):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
    assert L.identify(docs_of([]), dictionaries).count() == 0
    assert L.learn(docs_of([])) == [] and L.identify(odd, []).where("lang_pred <> 'und'").count() == 0


def brute(train, texts, sample_docs, sample_chars, dict_bytes):
    """One loop: beginnings of a language's first documents as raw dictionary, all pieces compressed with each, smallest total wins."""
    by = {}
    for key, body, lang in train:
        if lang is not None and key is not None and any(c.isalpha() for c in body or ""):
            by.setdefault(lang, []).append((hashlib.md5(str(key).encode()).hexdigest(), key, body))
    order = sorted(by, key=lambda lang: (-len(by[lang]), lang))
    plain = lambda body: re.sub(r"[\W\d_]+", " ", body.lower()).strip().encode()
    packers = []
    for lang in order:
        first = sorted({k[:2] for k in by[lang]})[:sample_docs]
        content = b" ".join(plain(body[:sample_chars]) for _, _, body in sorted(set(k for k in by[lang] if k[:2] in first)))[-dict_bytes:]
        packers.append(zstandard.ZstdCompressor(level=L.LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False))
    out = []
    for body in texts:
        letters = plain(body or "")
        if not letters:
            out.append(("und", 0.0))
            continue
        sizes = [sum(len(p.compress(letters[i : i + L.PIECE])) for i in range(0, len(letters), L.PIECE)) for p in packers]
        best = sizes.index(min(sizes))
        out.append((order[best], 1 - sizes[best] / min(s for i, s in enumerate(sizes) if i != best)))
    return out


@pytest.mark.parametrize("bounds", [(64, 16_000, 131_072), (3, 50, 400)])
def test_against_one_loop(spark, rng, bounds):
    """Also with equal sizes: texts of one letter compress alike, and the language with most documents wins."""
    train = [(i, text(rng, lang, rng.randrange(1, 200)), lang) for i, lang in enumerate((["en"] * 3 + ["de"] * 2 + ["fr"]) * 9)]
    texts = [text(rng, rng.choice(list(SYLLABLES)), rng.choice([1, 2, 9, 40, 3000])) for _ in range(60)] + ["q", "zz", "1 2", None, "", "é", "Ω" * 20_000]
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(frame(spark, [(i, t, None) for i, t in enumerate(texts)]), L.learn(frame(spark, train), *bounds)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(train, texts, *bounds)


def test_long_documents_teach(spark, rng):
    train = [(i, text(rng, "de", 9_000), "de") for i in range(4)] + [(10 + i, text(rng, "en", 60), "en") for i in range(4)]
    assert min(len(t) for k, t, _ in train if k < 10) > L.SAMPLE_CHARS
    dictionaries = L.learn(frame(spark, train))
    assert {lang for lang, _ in dictionaries} == {"de", "en"}
    assert L.identify(frame(spark, [(1, text(rng, "de", 50), None)]), dictionaries).first().lang_pred == "de"
