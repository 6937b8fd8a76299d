import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from conftest_llm import ODD_TEXTS, words
from tidelog.llm import catalog
from tidelog.llm import token_counts as T
from tidelog.llm import vocabularies as V

PATH = V.installed(V.PIECE_BPE)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def known():
    return T.Vocabulary(V.read_file(PATH))


def test_random_strings_against_the_library(known, library):
    rng = random.Random(3)
    alphabet = "ab  ▁é🙂\n\t<s>0xA'ß中文 　̀e\x00Ġ." * 2
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(4_000)]
    assert [known.count(t) for t in texts] == [len(x) for x in library.encode(texts)]


@pytest.mark.parametrize("text", ["a" * 20_000, " " * 9_999, "ab" * 7_000, "▁ " * 500, "\n" * 300, "日本" * 4_000, "x́" * 3_000])
def test_long_runs(known, library, text):
    assert known.count(text) == len(library.encode(text))


def test_cuts_change_nothing(known, library, rng):
    """Pieces over the kept length are cut between characters no entry holds together."""
    long = "".join(rng.choice("abcxyz,.-_/#") for _ in range(3_000))
    assert "".join(known.uncrossed(long)) == long and len(list(known.uncrossed(long))) > 3
    assert known.count(long) == len(library.encode(long)) == known.merged("▁" + long)


def test_full_cache_is_emptied(known, library, rng, monkeypatch):
    monkeypatch.setattr(T, "KEPT", 5)
    text = words(rng, 300)
    assert known.count(text) == len(library.encode(text)) and len(known) <= 5


def test_whole_table_against_the_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: (len((r.text or "").encode()), len(library.encode(r.text or ""))) for r in docs.collect()}
    rows = catalog.op11_token_counts(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(want)
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in rows} == want
    assert all(r.over_limit == (r.n_tokens > 4096) for r in rows) and any(r.over_limit for r in rows)


def test_odd_empty_and_clashing(odd, docs_of, library):
    df = odd.withColumns({c: F.lit("z") for c in ("n_bytes", "n_tokens", "over_limit")})
    rows = T.count_tokens(df, PATH, limit=2).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if r.doc_id is not None and r.doc_id < len(ODD_TEXTS) and r.doc_id != 3:
            text = ODD_TEXTS[r.doc_id] or ""
            assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(library.encode(text)))
            assert r.over_limit == (r.n_tokens > 2)
    assert T.count_tokens(docs_of([]), PATH).count() == 0
    binary = docs_of(["x"]).withColumn("text", F.expr("cast(X'61ff62' as string)"))
    assert T.count_tokens(binary, PATH).first().n_bytes == 3


def test_vocabularies_counted_otherwise_are_refused(monkeypatch):
    """A vocabulary is tried on odd strings before use; here the library is made to differ on one."""
    right = sentencepiece.SentencePieceProcessor.encode
    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "encode", lambda self, text, **more: right(self, text + "x" * (text == " "), **more))
    with pytest.raises(ValueError, match="byte fallback"):
        T.Vocabulary(V.read_file(PATH))
