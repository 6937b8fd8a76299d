"""Benchmark passages in documents, found by spaced seeds and verified with substitutions.

A mask looks at some words of a short stretch and ignores the others, so a seed
still matches when an ignored word was replaced.  All stretches of all texts and
of all benchmark items are hashed under each mask and joined on the hash; every
hit proposes an alignment, and along it the words are compared one by one.

An item is found when a window of ``WINDOW`` of its words (all of them, if it has
fewer) stands in the text with at most the allowed replaced words.  The two masks
hit every such window: whatever places the replaced words take, one of the masks
fits between them (``tests/llm/test_decontamination.py`` goes through all
placements).  An item of fewer than ``MIN_WORDS`` words is found where it stands
word for word; its mask looks at all of its words.  So the join loses nothing that
the comparison would accept.

Texts are scanned once for seeds.  What is proposed, a few rows, is written, and
only the texts named there are read again to be compared.  Everything is Spark
expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.scratch import Scratch

#: Looked-at words are 1; the pair is lossless for the limits of ``allowed``.
MASKS = ("111011", "11010011")
WINDOW = 16
MIN_WORDS = 8
#: Rows (under 100 bytes each) up to which seeds, items, or the keys of texts to compare are broadcast.
MAX_BROADCAST = 1_000_000


def allowed(words: int) -> int:
    """Replaced words tolerated in a window of so many words."""
    return 3 if words >= 16 else 2 if words >= 12 else 1 if words >= MIN_WORDS else 0


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased words: runs of letters, digits and non-ASCII characters."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(words: str, number: int, mask: str) -> str:
    looked = ", ".join(f"{words}[i + {k}]" for k, c in enumerate(mask) if c == "1")
    last = f"size({words}) - {len(mask)}"
    return f"if({last} < 0, array(), transform(sequence(0, {last}), i -> xxhash64({number}, {looked})))"


def row_key() -> Column:
    """128 bits that rows with one id and one text share; never null."""
    text = F.col("text").cast("string")
    return F.struct(F.xxhash64(F.col("doc_id"), text).alias("a"), F.xxhash64(F.lit(1), text, F.col("doc_id")).alias("b"))


def _hint(df: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Broadcast behind a count, else a shuffled join."""
    return F.broadcast if df.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else (lambda other: other)


def _masks(items: DataFrame) -> list[tuple[int, str, str]]:
    """Number, mask and condition on an item's words of each mask in use; one more per short length that occurs."""
    short = sorted(r["n"] for r in items.where(f"size(item_words) < {MIN_WORDS}").select(F.size("item_words").alias("n")).distinct().collect())
    usual = [(k, mask, f"size(item_words) >= {MIN_WORDS}") for k, mask in enumerate(MASKS)]
    return usual + [(len(MASKS) + n, "1" * n, f"size(item_words) = {n}") for n in short]


def _proposed(texts: DataFrame, seeds: DataFrame, masks: list[tuple[int, str, str]]) -> DataFrame:
    """``row_key, item_key, n_words, offset``: word ``p`` of the item would stand at ``p + offset`` of the text."""
    words = texts.select("row_key", word_hashes(F.col("text")).alias("words"))
    every = ", ".join(_seeds("words", number, mask) for number, mask, _ in masks)
    stretches = words.select("row_key", F.size("words").alias("size"), F.posexplode(F.expr(f"concat({every})")).alias("at", "seed"))
    before, start = "0", "case mask"
    for number, mask, _ in masks:
        start += f" when {number} then {before}"
        before += f" + greatest(size - {len(mask) - 1}, 0)"
    hits = stretches.join(_hint(seeds)(seeds), "seed")
    return hits.select("row_key", "item_key", "n_words", F.expr(f"at - ({start} end) - item_at").alias("offset")).distinct()


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(row_key, doc_id, item_id, window, matched)`` of all items found in rows of ``docs``, a written table.

    ``docs`` has ``doc_id`` and ``text``, ``benchmark`` ``item_id`` and ``text``;
    other columns are ignored.  ``window`` is the number of words compared at once,
    ``matched`` the most that agree.  Null and empty texts and items without words
    give nothing.  Rows with one id and one text, null ids included, give one result.
    """
    scratch = Scratch(docs.sparkSession, "decontamination")
    texts = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row_key", row_key())
    named = benchmark.select(F.col("item_id"), word_hashes(F.col("text")).alias("item_words")).where("size(item_words) > 0").distinct()
    named = scratch.write(named.withColumn("item_key", F.xxhash64("item_words")), "items")
    items = named.select("item_key", "item_words").distinct()
    masks = _masks(items)
    seeds = [
        items.where(use).select("item_key", F.size("item_words").alias("n_words"), F.lit(number).alias("mask"), F.posexplode(F.expr(_seeds("item_words", number, mask))).alias("item_at", "seed"))
        for number, mask, use in masks
    ]
    all_seeds = seeds[0]
    for more in seeds[1:]:
        all_seeds = all_seeds.unionAll(more)
    found = scratch.write(_proposed(texts, scratch.write(all_seeds, "seeds"), masks), "proposed")

    # One row per text with its alignments; of the text only the words along each of them go on.
    hits = found.groupBy("row_key").agg(F.collect_list(F.struct("item_key", "n_words", "offset")).alias("hits"))
    hit_texts = texts.join(_hint(found)(hits), "row_key").dropDuplicates(["row_key"])
    along = F.expr("""transform(hits, h -> named_struct('item_key', h.item_key, 'offset', h.offset,
        'along', slice(words, greatest(h.offset, 0) + 1, h.n_words + least(h.offset, 0))))""")  # fmt: skip
    aligned = hit_texts.withColumn("words", word_hashes(F.col("text"))).select("row_key", "doc_id", F.inline(along))
    aligned = aligned.join(_hint(items)(items), "item_key").withColumn("window", F.least(F.lit(WINDOW), F.size("item_words")))
    aligned = aligned.withColumn("same", F.expr("""transform(item_words, (w, p) ->
        if(p + least(offset, 0) >= 0 and try_element_at(along, p + 1 + least(offset, 0)) = w, 1, 0))"""))  # fmt: skip
    matched = F.expr("""array_max(transform(sequence(0, size(item_words) - window), s ->
        aggregate(slice(same, s + 1, window), 0, (total, x) -> total + x)))""")  # fmt: skip
    aligned = aligned.select("row_key", "doc_id", "item_key", "window", matched.alias("matched"))
    limit = F.lit(allowed(1))
    for least in (MIN_WORDS, 12, 16):
        limit = F.when(F.col("window") >= least, allowed(least)).otherwise(limit)
    enough = aligned.where(F.col("matched") >= F.col("window") - limit)
    best = enough.groupBy("row_key", "doc_id", "item_key").agg(F.max("window").alias("window"), F.max("matched").alias("matched"))
    out = scratch.write(best.join(named.select("item_key", "item_id").distinct(), "item_key").drop("item_key"), "overlaps")
    scratch.drop("proposed", "seeds", "items")
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, window, matched)``: each pair of a document and an item found in it."""
    found = overlaps(docs, benchmark).groupBy("doc_id", "item_id")
    return found.agg(F.max("window").alias("window"), F.max("matched").alias("matched"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, with their columns."""
    bad = overlaps(docs, benchmark).select("row_key").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), row_key().alias("row_key"))
    return rows.join(_hint(bad)(bad), "row_key", "left_anti").select("row.*")
