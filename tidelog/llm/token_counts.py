"""Numbers of tokens by byte-pair merging, without making the tokens.

A text is normalized as the vocabulary asks for (a blank in front, blanks as
U+2581) and cut into pieces no merge can cross: a place where the two characters
beside it stand next to each other in no entry of the vocabulary.  In a piece every
character is a symbol of a linked list, and a heap holds the adjacent pairs that are
in the vocabulary; the pair of lowest rank is popped and merged, leftmost first
among equal ranks, until none is left.  A character without an entry counts as its
UTF-8 bytes, which never merge, so the count is the initial symbols less the merges.
No identifier is looked up or returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from operator import add

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.vocabularies import read_file

BLANK = "▁"
#: Pieces of at most so many characters are kept with their counts, so many of them per worker.
KEPT_CHARS, KEPT = 32, 1_000_000
_PLACE = (1 << 32) - 1
_PROBES = ("", " ", "  a", "a  b \n c", "ﬁ ① Å", f"x{BLANK}y {BLANK}", "é\U0001f642\x00", "<s></s><unk><0x41>", "aaaa" * 9)


class Vocabulary(dict):
    """Counts of pieces seen so far, and what is needed to count another one.

    Only vocabularies of merges with byte fallback and without a text normalization
    of their own can be counted this way; others are refused.
    """

    def __init__(self, model: bytes):
        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        entries = [i for i in range(library.get_piece_size()) if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i))]
        texts = [library.id_to_piece(i) for i in entries]
        scores = [library.get_score(i) for i in entries]
        order = {s: k for k, s in enumerate(sorted(set(scores), reverse=True))}
        self.rank = {t: order[s] for t, s in zip(texts, scores, strict=True)}
        self.bigrams = {t[i : i + 2] for t in texts for i in range(len(t) - 1)}
        self.characters = {t for t in texts if len(t) == 1}
        self.pieces = re.compile(self._pieces()).findall
        if any(library.is_unused(i) for i in entries) or any(self.count(p) != len(library.encode(p)) for p in _PROBES):
            raise ValueError("not a vocabulary of byte-pair merges with byte fallback and identity normalization")

    def _pieces(self) -> str:
        """A pattern that cuts a text before blanks that follow something else, and around ASCII characters that no longer entry holds."""
        alone = re.escape("".join(c for c in map(chr, range(128)) if not any(c in b for b in self.bigrams)))
        inside = alone if any(b[1] == BLANK != b[0] for b in self.bigrams) else alone + BLANK
        kinds = [f"{BLANK}+[^{inside}]*", f"[^{inside}{BLANK}]+", f"[{alone}]" if alone else ""]
        return "|".join(filter(None, kinds))

    def __missing__(self, piece: str) -> int:
        if len(piece) > KEPT_CHARS:
            return sum(self[p] if len(p) <= KEPT_CHARS else self.merged(p) for p in self.uncrossed(piece))
        if len(self) >= KEPT:
            self.clear()
        self[piece] = n = self.merged(piece)
        return n

    def uncrossed(self, piece: str) -> Iterator[str]:
        """``piece`` cut wherever no entry holds the two characters in a row."""
        start, bigrams = 0, self.bigrams
        for i in range(1, len(piece)):
            if piece[i - 1 : i + 1] not in bigrams:
                yield piece[start:i]
                start = i
        yield piece[start:]

    def merged(self, piece: str) -> int:
        """Symbols left of one piece after all merges."""
        get, n = self.rank.get, len(piece)
        symbols: list[str | None] = list(piece)
        weights = {c: len(c.encode("utf-8", "surrogatepass")) for c in set(piece) - self.characters}
        left = sum(weights.get(c, 1) for c in piece) if weights else n
        heap = [r << 32 | i for i, r in enumerate(map(get, map(add, piece, piece[1:]))) if r is not None]
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            pair = heappop(heap)
            i = pair & _PLACE
            first, j = symbols[i], after[i]
            if first is None or j >= n:
                continue
            second = symbols[j]
            both = first + second
            if get(both) != pair >> 32:
                continue  # one of the two has been merged with another since
            left -= weights.get(first, 1) + weights.get(second, 1) - 1 if weights else 1
            symbols[i], symbols[j] = both, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get(both + symbols[k])) is not None:
                    heappush(heap, r << 32 | i)
            if (p := before[i]) >= 0 and (r := get(symbols[p] + both)) is not None:
                heappush(heap, r << 32 | p)
        return left

    def count(self, text: str) -> int:
        if not text:
            return 0
        return sum(map(self.__getitem__, self.pieces(BLANK + text.replace(" ", BLANK))))


_LOADED: dict[int, Vocabulary] = {}


def vocabulary(model: bytes) -> Vocabulary:
    """The vocabulary of ``model``, set up once per worker."""
    key = hash(model)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(model)
    return _LOADED[key]


def _count(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(model)
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            counts = [known.count((t.as_py() or b"").decode("utf-8", "replace")) for t in texts]
            yield pa.record_batch([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs (doc_id, text, ...)``.

    ``model_path`` is a vocabulary file, read once on the driver.  Null and empty texts
    have no bytes and no tokens; begin and end marks are not counted, and their strings
    inside a text are ordinary text.  Whole texts are counted, whatever their length.
    Repeated rows and null ids are counted like others; other columns are ignored.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    schema = docs.select("doc_id").schema.add("n_bytes", "long").add("n_tokens", "long")
    return rows.mapInArrow(_count(read_file(model_path)), schema).withColumn("over_limit", F.col("n_tokens") > limit)
