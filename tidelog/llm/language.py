"""Language of texts by compression against per-language dictionaries.

A language is represented by ordinary text of it, used as a raw-content
dictionary.  A text is cut into pieces of ``PIECE`` bytes, all of them are
compressed with each dictionary, and the language with the smallest total wins;
how much smaller it is than the runner-up is the score.  Too narrow a margin is
marked as rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.ranking import first_per_group

#: Dictionary of one language: the beginnings, of at most so many characters, of at most so many documents, and so many bytes of them.
SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES = 64, 16_000, 131_072
PIECE, LEVEL = 8_192, 3
MIN_MARGIN = 0.01
UNKNOWN = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def normal(text: str | None) -> bytes:
    """Lower-cased letters, anything else a blank; empty without letters."""
    return _NOT_LETTERS.sub(" ", (text or "").lower()).strip().encode("utf-8", "surrogatepass")


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, dict_bytes: int = DICT_BYTES) -> list[tuple[str, bytes]]:
    """``(lang, dictionary)``, languages with most documents first.

    ``docs`` has ``doc_id, text, lang``.  A language's sample are its first ``sample_docs`` documents in the
    order of a hash of the id, however long they are; of each the first ``sample_chars`` characters
    teach, and the last ``dict_bytes`` of all of them stay.  So ``dict_bytes`` per language reach the
    driver.  Rows without language, id or letters teach nothing.
    """
    usable = docs.where("lang is not null and doc_id is not null and text is not null")
    usable = usable.where(F.col("text").rlike(r"\p{L}"))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    keys = usable.select("lang", "doc_id", F.md5(F.col("doc_id").cast("string")).alias("order")).distinct()
    first = first_per_group(keys, ["lang"], [F.col("order"), F.col("doc_id")], sample_docs, spread=["doc_id"])
    begin = F.substring("text", 1, sample_chars).alias("text")
    rows = usable.join(first, ["lang", "doc_id"]).select("lang", "order", "doc_id", begin).collect()
    rows = sorted({(r["lang"], r["order"], r["doc_id"], r["text"]) for r in rows})
    out = []
    for lang in sorted(sizes, key=lambda name: (-sizes[name], name)):
        content = b" ".join(normal(text) for name, _, _, text in rows if name == lang)[-dict_bytes:]
        if content:
            out.append((lang, content))
    return out


class Classifier:
    """Compressors of all learned languages, set up once per task."""

    def __init__(self, dictionaries: list[tuple[str, bytes]]):
        self.langs = [lang for lang, _ in dictionaries]
        self.compressors = []
        for _, content in dictionaries:
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and margin; among equal sizes the language with most documents."""
        letters = normal(text)
        if not letters or not self.langs:
            return UNKNOWN, 0.0
        sizes = [sum(len(c.compress(letters[i : i + PIECE])) for i in range(0, len(letters), PIECE)) for c in self.compressors]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        others = [s for i, s in enumerate(sizes) if i != best]
        return self.langs[best], 1 - sizes[best] / min(others) if others else 1.0


def _predict(dictionaries: list[tuple[str, bytes]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(dictionaries)
        for batch in batches:
            found = [classifier.predict(t.as_py()) for t in batch.column("text")]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return run


def identify(docs: DataFrame, dictionaries: list[tuple[str, bytes]], min_margin: float = MIN_MARGIN) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` of every row of ``docs (doc_id, text, ...)``.

    ``lang_pred`` is the best language also where the margin is too narrow and
    ``rejected`` is true; a text that is null or has no letter is ``und`` with score
    0 and rejected.  Only ``doc_id`` and ``text`` are read; the id is carried along
    and may be null or repeated.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(_predict(dictionaries), rows.select("doc_id").schema.add("lang_pred", "string").add("score", "double"))
    return out.withColumn("rejected", F.col("score") < min_margin)
