import collections
import hashlib
import random

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest_llm import words
from tidelog.llm import alignment as A
from tidelog.llm import catalog
from tidelog.llm import vocabularies as V

BYTE, PIECE = V.installed(V.BYTE_BPE), V.installed(V.PIECE_BPE)
NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(BYTE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECE)


def brute(texts, libraries):
    """Token by token, whole texts, one loop."""
    a_model, b_model = libraries
    letters = A.byte_of_letter()
    groups = []
    for text in texts:
        if not text:
            groups.append([])
            continue
        want = (" " + text).encode()
        a = [(i, bytes(letters[c] for c in a_model.id_to_token(i))) for i in a_model.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in b_model.encode(text):
            piece = b_model.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if b_model.is_byte(i) else piece.replace("▁", " ").encode()))
        if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            groups.append([])
            continue
        out, i, j, ends = [], 0, 0, [0, 0]
        now = ([], [])
        while i < len(a) or j < len(b):
            if ends[0] <= ends[1]:
                now[0].append(a[i][0])
                ends[0] += len(a[i][1])
                i += 1
            else:
                now[1].append(b[j][0])
                ends[1] += len(b[j][1])
                j += 1
            if ends[0] == ends[1]:
                out.append(now)
                now = ([], [])
        groups.append(out)
    links = [collections.Counter((x, y) for xs, ys in g for x in xs for y in ys) for g in groups]
    counts = collections.Counter(p for doc in links for p in doc)
    highest = collections.Counter()
    for (x, _), n in counts.items():
        highest[x] = max(highest[x], n)
    out = []
    for g, doc in zip(groups, links, strict=True):
        digest = hashlib.sha256(";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in g).encode()).hexdigest() if g else ""
        best = sum(n for p, n in doc.items() if counts[p] == highest[p[0]])
        out.append((sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(doc.values()), best, sum(n * counts[p] for p, n in doc.items()), digest))
    return out


def rows_of(df):
    return {r.doc_id: tuple(r[n] for n in NAMES) for r in df.collect()}


def odd_strings(rng, n):
    alphabet = "ab  ▁é🙂\n\t<s>0xA'ß中文 　̀e\x00Ġ.,“”\xa0  " * 2
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def mixed(rng):
    texts = [words(rng, rng.randrange(1, 60)) for _ in range(30)] + odd_strings(rng, 120)
    texts += ["", None, " ", "  two  blanks \n\n here  ", "x▁y", "▁", "<|endoftext|> and <s>", "a" * 3_000, "日本語の文" * 60, "é" * 500, "don't, we'll (see)…", "1234567 89,0"]
    return texts + texts[:9]


def test_against_token_by_token(docs_of, rng, libraries):
    texts = mixed(rng)
    got = rows_of(A.align_tokenizers(docs_of(texts), BYTE, PIECE))
    want = brute(texts, libraries)
    assert [got[i] for i in range(len(texts))] == want and sum(w[2] > 0 for w in want) > 80 and sum(w[2] == 0 for w in want) > 10


def test_whole_table_against_token_by_token(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = rows_of(catalog.op13_alignment(spark, "/root/testdata/sf0.001"))
    assert [got[d.doc_id] for d in docs] == brute([d.text for d in docs], libraries) and len(got) == len(docs)


@pytest.mark.parametrize("limits", [{"MAX_BROADCAST": 40}, {"MAX_BROADCAST": 0}, {"BATCH_BYTES": 1, "PARTIAL": 8}, {"BATCH_BYTES": 300, "KEPT": 9}, {"PAIRS": 1}])
def test_limits_change_nothing(spark, rng, libraries, monkeypatch, limits):
    """Pairs joined by shuffle, single texts, partial counts passed on early, groups in slices: inside one process."""
    texts = [t for t in mixed(random.Random(5)) if t] * 2
    for name, value in limits.items():
        monkeypatch.setattr(A, name, value)
    if "MAX_BROADCAST" in limits:
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = rows_of(A.align_tokenizers(df, BYTE, PIECE))
        assert [got[i] for i in range(len(texts))] == brute(texts, libraries)
        return
    import pyarrow as pa

    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    found = list(A._align(V.read_file(BYTE), V.read_file(PIECE))(iter([batch])))
    want = brute(texts, libraries)
    rows = [r for b in found for r in b.to_pylist()]
    assert [(r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) for r in rows] == [(*w[:4], w[6]) for w in want]
    partial = collections.Counter()
    for b in A._partial(iter(found)):
        for r in b.to_pylist():
            partial[r["code"]] += r["docs"]
    assert partial == collections.Counter(c for r in rows for c in r["codes"])


def test_cutting_changes_nothing(rng):
    """The groups of a text do not depend on whether it is cut into stretches."""
    import pyarrow as pa

    known = A.Known(A.Pair(V.read_file(BYTE), V.read_file(PIECE)))
    assert known.pair.cuts
    texts = pa.array([t.encode() for t in [*odd_strings(rng, 400), words(rng, 400)]], pa.binary())
    cut = A.align(texts, known)
    known.pair.cuts = False
    whole = A.align(texts, known)
    for name in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256"):
        assert cut[name] == whole[name]
    assert len(A.stretches(texts, True).flatten()) > 2 * len(A.stretches(texts, False).flatten())


def test_odd_empty_and_clashing(odd, docs_of):
    df = odd.withColumns({c: F.lit("z") for c in ("row", "codes", "links", "code", "docs", "best", "n_a", "count_sum")})
    rows = A.align_tokenizers(df, BYTE, PIECE).collect()
    assert len(rows) == odd.count()
    assert {r.groups_sha256 for r in rows if r.doc_id in (0, 1)} == {""} and all(r.n_links == r.count_sum == 0 for r in rows if r.doc_id in (0, 1))
    assert A.align_tokenizers(docs_of([]), BYTE, PIECE).count() == 0
    assert A.align_tokenizers(docs_of([None, ""]), BYTE, PIECE).count() == 2
    twice = A.align_tokenizers(docs_of([(1, "same words"), (1, "same words"), (None, "same words")]), BYTE, PIECE).collect()
    assert len(twice) == 3 and {r.count_sum for r in twice} == {3 * twice[0].n_links}
    broken = docs_of(["x"]).withColumn("text", F.expr("cast(X'61ff62' as string)"))
    assert A.align_tokenizers(broken, BYTE, PIECE).first().n_a == 0
