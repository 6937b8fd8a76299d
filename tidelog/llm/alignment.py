"""Which tokens of two tokenizers cover the same bytes, over a corpus.

Everything inside a task is Arrow: a batch of texts is a list array of stretches,
flattened with parent indices; each different stretch is tokenized once.  Byte
lengths of tokens are summed up per stretch to the ends of the tokens, and a hash
join of both tokenizers' ends gives the places where both stop, which bound the
groups.  Tokens are joined on their group to pairs, counted with ``Table.group_by``
per stretch and document, and once more per task over documents; Spark merges
these partial counts and deals the corpus-wide ones back to the documents.

A stretch ends before a blank that follows a printable character.  There a
byte-level vocabulary with the usual word pattern starts a new word, and no entry of a
piece vocabulary goes on over it, so tokens and groups are those of the whole text.
If a vocabulary is of another make, texts are not cut.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType
from tokenizers import Tokenizer

from tidelog.llm.scratch import Scratch
from tidelog.llm.vocabularies import read_file

BLANK = "▁"
#: Bytes of text aligned at once (one text at least), and pairs made at once.
BATCH_BYTES, PAIRS = 1 << 20, 1 << 20
#: Different stretches a worker keeps aligned.
KEPT = 250_000
#: Stretches joined to one text, and texts tokenized in one call.
TOGETHER, CALL = 64, 64
#: Partial counts a task holds before it passes them on.
PARTIAL = 1 << 20
#: Most frequent pairs (16 bytes each) that are broadcast; the others are joined by shuffle.
MAX_BROADCAST = 500_000


def byte_of_letter() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones themselves, the others from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Pair:
    """Both tokenizers, with the bytes of each of their tokens."""

    def __init__(self, byte_model: bytes, piece_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(byte_model.decode("utf-8"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        letters = byte_of_letter()
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = pa.array([bytes(letters[c] for c in name if c in letters) for name in names], pa.binary())
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        plain = [b"" if self.b.is_control(i) or self.b.is_unknown(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.b_bytes = pa.array([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else q for i, (p, q) in enumerate(zip(pieces, plain, strict=True))], pa.binary())
        self.a_size, self.b_size = (pc.binary_length(x).to_numpy().astype(np.int64) for x in (self.a_bytes, self.b_bytes))
        made = json.loads(byte_model)
        usual = made.get("normalizer") is None and all(t.get("special") for t in made.get("added_tokens", []))
        words = made.get("pre_tokenizer") or {}
        usual = usual and words.get("type") == "ByteLevel" and words.get("use_regex", True) and not words.get("add_prefix_space")
        self.cuts = bool(usual) and not any(BLANK in p.lstrip(BLANK) for i, p in enumerate(pieces) if plain[i])

    def tokens(self, whole: pa.Array, joinable: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Where the tokens of each stretch begin, and their identifiers, of both.

        Every stretch starts with a blank, which the piece vocabulary adds itself.  The first ``joinable``
        ones end where another stretch may follow, so many of them are one text to the tokenizers.
        """
        texts = [s.decode("utf-8", "replace") for s in whole.to_pylist()]
        units = ["".join(texts[i : min(i + TOGETHER, joinable)]) for i in range(0, joinable, TOGETHER)]
        ends = np.cumsum(pc.binary_length(whole).to_numpy().astype(np.int64))[:joinable]
        a: list[list[int]] = []
        for start in range(0, len(units), CALL):
            a += [e.ids for e in self.a.encode_batch(units[start : start + CALL], add_special_tokens=False)]
        parted = self._parted(a, self.a_size, ends), self._parted(self.b.encode([u[1:] for u in units], num_threads=1), self.b_size, ends)
        if parted[0] is None or parted[1] is None:
            return self.tokens(whole, 0)
        rest = texts[joinable:]
        single = _flat([e.ids for e in self.a.encode_batch(rest, add_special_tokens=False)]), _flat(self.b.encode([t[1:] for t in rest], num_threads=1))
        return tuple((np.concatenate((at, at[-1] + more[1:])), np.concatenate((ids, others))) for (at, ids), (more, others) in zip(parted, single, strict=True))

    def _parted(self, lists: list[list[int]], size: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Identifiers of joined stretches dealt to them by their ends; None if a token lies across an end."""
        ids = _flat(lists)[1]
        reach = np.cumsum(size[ids])
        at = np.searchsorted(reach, ends, "right")
        if len(ends) and not np.array_equal(np.concatenate(([0], reach))[at], ends):
            return None
        return np.concatenate(([0], at)), ids


def _solid(last: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Whether a byte, with the one before it, ends an ASCII sign or letter, or a letter of two bytes from U+00C0 on.

    None of them is white space or the mark of a blank.
    """
    return ((last > 32) & (last < 127)) | ((last >= 128) & (lead >= 0xC3) & (lead <= 0xDF))


def stretches(texts: pa.Array, cuts: bool) -> pa.ListArray:
    """The stretches of each of some binary texts."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[: offsets[-1]]
    begins = np.zeros(len(data) + 1, bool)
    if cuts:
        begins[2:-1] = (data[2:] == 32) & _solid(data[1:-1], data[:-2])
        begins[offsets[1:] - 1] = False  # a blank that ends a text is no stretch: alone it would be an empty text
    begins[offsets] = True
    at = np.flatnonzero(begins).astype(np.int32)
    inside = np.searchsorted(at, offsets).astype(np.int32)
    flat = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), texts.buffers()[2]])
    return pa.ListArray.from_arrays(pa.array(inside), flat)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.concatenate(([0], np.cumsum(sizes))), np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum()))


def _ends(offsets: np.ndarray, ids: np.ndarray, table: pa.Array, whole: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """End of every token in its stretch (sums of lengths per stretch), and which stretches the joined tokens equal."""
    parts = table.take(pa.array(ids))
    total = np.concatenate(([0], pc.cumulative_sum(pc.binary_length(parts)).to_numpy().astype(np.int64)))
    base = total[offsets]
    joined = pa.Array.from_buffers(pa.binary(), len(whole), [None, pa.py_buffer(base.astype(np.int32)), parts.buffers()[2] or pa.py_buffer(b"")])
    owner = pc.list_parent_indices(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))).to_numpy()
    same = pc.fill_null(pc.equal(joined, whole), False).to_numpy(zero_copy_only=False)
    return np.column_stack((owner, total[1:] - base[owner])), same


def _times(columns: dict[str, np.ndarray], keys: list[str]) -> pa.Table:
    return pa.table(columns).group_by(keys, use_threads=False).aggregate([([], "count_all")])


class Aligned:
    """Groups and pairs of different stretches: per stretch counts, text of its groups, and its pairs."""

    def __init__(self, whole: pa.Array, joinable: int, pair: Pair):
        n, self.whole = len(whole), whole
        (a_at, a), (b_at, b) = pair.tokens(whole, joinable)
        a_ends, a_same = _ends(a_at, a, pair.a_bytes, whole)
        b_ends, b_same = _ends(b_at, b, pair.b_bytes, whole)
        self.same = a_same & b_same
        self.n_a, self.n_b = np.diff(a_at), np.diff(b_at)
        a, a_ends = a[self.same[a_ends[:, 0]]], a_ends[self.same[a_ends[:, 0]]]
        b, b_ends = b[self.same[b_ends[:, 0]]], b_ends[self.same[b_ends[:, 0]]]
        sides = [pa.table({"stretch": e[:, 0], "end": e[:, 1]}) for e in (a_ends, b_ends)]
        marks = sides[0].join(sides[1], keys=["stretch", "end"], join_type="inner", use_threads=False).sort_by([("stretch", "ascending"), ("end", "ascending")])
        owner = marks["stretch"].to_numpy()
        places = owner << 32 | marks["end"].to_numpy()
        a_group = np.searchsorted(places, a_ends[:, 0] << 32 | a_ends[:, 1])
        b_group = np.searchsorted(places, b_ends[:, 0] << 32 | b_ends[:, 1])
        self.n_groups = np.bincount(owner, minlength=n)
        self.text = self._text(a, a_group, b, b_group, len(places)).to_pylist()
        self._pairs(a, a_group, b, b_group, owner, n, len(pair.b_bytes))

    def _text(self, a: np.ndarray, a_group: np.ndarray, b: np.ndarray, b_group: np.ndarray, groups: int) -> pa.Array:
        def side(ids: np.ndarray, group: np.ndarray) -> pa.Array:
            at = np.searchsorted(group, np.arange(groups + 1)).astype(np.int32)
            return pc.binary_join(pa.ListArray.from_arrays(pa.array(at), pa.array(ids).cast(pa.string())), ",")

        both = pc.binary_join_element_wise(side(a, a_group), side(b, b_group), "|")
        at = np.concatenate(([0], np.cumsum(self.n_groups))).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(at), both), ";").cast(pa.binary())

    def _pairs(self, a: np.ndarray, a_group: np.ndarray, b: np.ndarray, b_group: np.ndarray, owner: np.ndarray, n: int, b_size: int) -> None:
        """Pairs of a stretch with the number of links, joined on the group; some rows of a group at a time if it is large."""
        left = _times({"group": a_group, "a": a.astype(np.int64)}, ["group", "a"]).sort_by("group")
        right = _times({"group": b_group, "b": b.astype(np.int64)}, ["group", "b"]).rename_columns(["group", "b", "b_times"])
        fan = np.cumsum(np.bincount(right["group"].to_numpy(), minlength=len(owner))[left["group"].to_numpy()])
        found, start = [], 0
        while start < left.num_rows:
            done = fan[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(fan, done + PAIRS, "right")))
            links = left.slice(start, stop - start).join(right, keys="group", join_type="inner", use_threads=False)
            rows = pa.table({
                "stretch": owner[links["group"].to_numpy()],
                "code": pc.add(pc.multiply(links["a"], b_size), links["b"]),
                "links": pc.multiply(links["count_all"], links["b_times"]),
            })
            found.append(rows.group_by(["stretch", "code"], use_threads=False).aggregate([("links", "sum")]))
            start = stop
        if not found:
            self.at, self.codes, self.links = np.zeros(n + 1, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
            return
        rows = pa.concat_tables(found)
        if len(found) > 1:
            rows = rows.group_by(["stretch", "code"], use_threads=False).aggregate([("links_sum", "sum")]).rename_columns(["stretch", "code", "links_sum"])
        rows = rows.sort_by("stretch")
        self.at = np.searchsorted(rows["stretch"].to_numpy(), np.arange(n + 1))
        self.codes, self.links = rows["code"].to_numpy(), rows["links_sum"].to_numpy()


def gathered(at: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the lists at ``places``, list ``i`` being the rows from ``at[i]`` on, and where each list begins among them."""
    size = at[places + 1] - at[places]
    begins = np.concatenate(([0], np.cumsum(size)))
    return np.repeat(at[places] - begins[:-1], size) + np.arange(begins[-1]), begins


class Known:
    """Stretches aligned so far, so that frequent ones are tokenized once per worker.

    When full, those of the batch at hand stay.
    """

    def __init__(self, pair: Pair):
        self.pair = pair
        self.clear()

    def clear(self) -> None:
        self.whole = pa.array([], pa.binary())
        self.same = np.empty(0, bool)
        self.n_a = self.n_b = self.n_groups = self.codes = self.links = np.empty(0, np.int64)
        self.at = np.zeros(1, np.int64)
        self.text: list[bytes] = []

    def _keep(self, places: np.ndarray) -> None:
        """Only the stretches at ``places`` stay, in that order."""
        row, at = gathered(self.at, places)
        self.codes, self.links = self.codes[row], self.links[row]
        for name in ("same", "n_a", "n_b", "n_groups"):
            setattr(self, name, getattr(self, name)[places])
        self.at, self.text, self.whole = at, [self.text[i] for i in places.tolist()], self.whole.take(pa.array(places))

    def places(self, whole: pa.Array) -> np.ndarray:
        """Where the given different stretches are kept, after new ones were aligned."""
        found = pc.index_in(whole, value_set=self.whole)
        if len(self.whole) + found.null_count > KEPT:
            self._keep(found.drop_null().to_numpy().astype(np.int64))
            found = pc.index_in(whole, value_set=self.whole)
        places = pc.fill_null(found, 0).to_numpy().astype(np.int64)
        if found.null_count:
            new = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
            joins = self._joins(whole.take(pa.array(new)))
            new = np.concatenate((new[joins], new[~joins]))
            places[new] = len(self.whole) + np.arange(len(new))
            self._add(Aligned(whole.take(pa.array(new)), int(joins.sum()), self.pair))
        return places

    def _joins(self, whole: pa.Array) -> np.ndarray:
        """Which stretches another one may follow within one text, without a change to either."""
        if not self.pair.cuts:
            return np.zeros(len(whole), bool)
        last, lead = (np.frombuffer(pc.binary_slice(pc.binary_join_element_wise(pa.scalar(b"  "), whole, b""), k, k + 1 or None).buffers()[2], np.uint8) for k in (-1, -2))
        strange = pc.match_substring(whole, BLANK).to_numpy(zero_copy_only=False)
        try:
            whole.cast(pa.string())
        except pa.ArrowInvalid:
            strange[:] = True
        return _solid(last[: len(whole)], lead[: len(whole)]) & ~strange

    def _add(self, more: Aligned) -> None:
        for name in ("same", "n_a", "n_b", "n_groups", "codes", "links"):
            setattr(self, name, np.concatenate((getattr(self, name), getattr(more, name))))
        self.at = np.concatenate((self.at, self.at[-1] + more.at[1:]))
        self.text += more.text
        self.whole = pa.concat_arrays([self.whole, more.whole])


_LOADED: dict[int, Known] = {}


def _known(byte_model: bytes, piece_model: bytes) -> Known:
    """Set up once per worker."""
    key = hash((byte_model, piece_model))
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Known(Pair(byte_model, piece_model))
    return _LOADED[key]


def align(texts: pa.Array, known: Known) -> dict[str, pa.Array]:
    """Counts, digest and pairs of some binary texts, none of them empty."""
    listed = stretches(pc.binary_join_element_wise(pa.scalar(b" ", pa.binary()), texts, pa.scalar(b"", pa.binary())), known.pair.cuts)
    owner = pc.list_parent_indices(listed).to_numpy()
    coded = pc.list_flatten(listed).dictionary_encode()
    which = known.places(coded.dictionary)[coded.indices.to_numpy()]

    good = np.bincount(owner[~known.same[which]], minlength=len(texts)) == 0
    counts = {name: (np.bincount(owner, getattr(known, name)[which], len(texts)) * good).astype(np.int64) for name in ("n_a", "n_b", "n_groups")}
    at = np.searchsorted(owner, np.arange(len(texts) + 1))
    digests = [hashlib.sha256(b";".join(map(known.text.__getitem__, which[i:j].tolist()))).hexdigest() if ok else "" for i, j, ok in zip(at[:-1], at[1:], good, strict=True)]

    inside = good[owner]
    used = _times({"doc": owner[inside], "stretch": which[inside]}, ["doc", "stretch"])
    stretch = used["stretch"].to_numpy()
    place, _ = gathered(known.at, stretch)
    row = np.repeat(np.arange(len(stretch)), known.at[stretch + 1] - known.at[stretch])
    links = pa.table({"doc": used["doc"].to_numpy()[row], "code": known.codes[place], "links": known.links[place] * used["count_all"].to_numpy()[row]})
    links = links.group_by(["doc", "code"], use_threads=False).aggregate([("links", "sum")])
    doc = links["doc"].to_numpy()
    order = np.argsort(doc, kind="stable")
    begins = pa.array(np.searchsorted(doc[order], np.arange(len(texts) + 1)).astype(np.int32))
    per_pair = links["links_sum"].to_numpy()[order]
    total = np.concatenate(([0], np.cumsum(per_pair)))
    counts["n_links"] = np.diff(total[begins.to_numpy()])
    columns = {name: pa.array(values, pa.int64()) for name, values in counts.items()}
    columns["groups_sha256"] = pa.array(digests, pa.string())
    columns["codes"] = pa.ListArray.from_arrays(begins, pa.array(links["code"].to_numpy()[order], pa.int64()))
    columns["links"] = pa.ListArray.from_arrays(begins, pa.array(per_pair, pa.int64()))
    return columns


_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def _align(byte_model: bytes, piece_model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(byte_model, piece_model)
        for batch in batches:
            rows = batch.set_column(batch.schema.get_field_index("text"), "text", batch.column("text").cast(pa.binary()))
            reach = np.cumsum(pc.binary_length(rows.column("text")).to_numpy().astype(np.int64) + 1)
            start = 0
            while start < len(reach):
                done = reach[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(reach, done + BATCH_BYTES, "right")))
                part = rows.slice(start, stop - start)
                found = align(pa.concat_arrays([part.column("text")]), known)
                others = [c for c in part.schema.names if c != "text"]
                yield pa.record_batch([*[part.column(c) for c in others], *found.values()], names=[*others, *found])
                start = stop
                pa.default_memory_pool().release_unused()

    return run


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per pair, over a task's documents as far as they are held at once."""

    def summed(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by("code", use_threads=False).aggregate([("docs", "sum")]).rename_columns(["code", "docs"])

    held: list[pa.Table] = []
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            codes = pc.list_flatten(batch.column("codes").slice(start, 512))
            held.append(pa.table({"code": codes}).group_by("code", use_threads=False).aggregate([([], "count_all")]).rename_columns(["code", "docs"]))
            if sum(t.num_rows for t in held) > PARTIAL:
                held = [summed(held)]
                if held[0].num_rows > PARTIAL // 2:
                    yield from held.pop().combine_chunks().to_batches()
    if held:
        yield from summed(held).combine_chunks().to_batches()


def _frequent(counts: DataFrame) -> int:
    """The least number of documents, a power of two, from which on at most ``MAX_BROADCAST`` pairs are in.

    A pair below it holds less than a ``MAX_BROADCAST``-th part of two times all rows, so none is a hot key.
    """
    sizes = counts.groupBy(F.expr("cast(floor(log2(docs)) as int)").alias("power")).agg(F.count("*").alias("n")).collect()
    least, total = 63, 0
    for r in sorted(sizes, key=lambda r: -r["power"]):
        total += r["n"]
        if total > MAX_BROADCAST:
            break
        least = r["power"]
    return 2 ** min(least, 62)


def align_tokenizers(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """One row per row of ``docs (doc_id, text, ...)``: how two tokenizers' tokens lie over each other.

    ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.  A is the byte-level
    vocabulary in ``byte_path`` over a blank and the text, B the piece vocabulary in ``piece_path`` over
    the text.  Places where tokens of both end cut them into groups; every A token is linked with
    every B token of its group.  The count of a pair of identifiers is the number of rows of
    ``docs`` in which it is linked; ``n_best`` are the links whose count is the highest of
    their A identifier, ``count_sum`` is the sum of counts over the links.  ``groups_sha256`` is of
    the groups as ``a1,a2|b1;a3|b2,b3``.

    A text that is null or empty, or that a tokenizer does not give back byte by byte (a
    literal U+2581, bytes that are not UTF-8), has no tokens: zeros and an empty digest.  Rows with equal
    texts count each; ids may be null or repeated; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "alignment")
    byte_model, piece_model = read_file(byte_path), read_file(piece_path)
    b_size = sentencepiece.SentencePieceProcessor(model_proto=piece_model).get_piece_size()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id())
    schema = docs.select("doc_id").schema.add("row", "long")
    for name in _COUNTS[:3]:
        schema = schema.add(name, "long")
    schema = schema.add("n_links", "long").add("groups_sha256", "string").add("codes", ArrayType(LongType())).add("links", ArrayType(LongType()))
    texts = rows.where("text is not null and text <> ''").select("doc_id", "row", "text")
    aligned = scratch.write(texts.mapInArrow(_align(byte_model, piece_model), schema), "aligned")

    counts = aligned.select("codes").mapInArrow(_partial, "code long, docs long").groupBy("code").agg(F.sum("docs").alias("docs"))
    highest = F.max("docs").over(Window.partitionBy(F.expr(f"code div {b_size}")))
    counts = scratch.write(counts.select("code", "docs", (F.col("docs") == highest).alias("best")), "counts")

    each = aligned.where("n_links > 0").select("row", F.inline(F.arrays_zip("codes", "links")).alias("code", "links"))
    least = _frequent(counts)
    hot, cold = counts.where(F.col("docs") >= least), counts.where(F.col("docs") < least)
    found = each.join(F.broadcast(hot), "code")
    if not cold.isEmpty():
        found = found.unionByName(each.join(F.broadcast(hot), "code", "left_anti").join(cold, "code"))
    sums = found.groupBy("row").agg(F.sum(F.expr("if(best, links, 0)")).alias("n_best"), F.sum(F.expr("links * docs")).alias("count_sum"))
    done = aligned.drop("codes", "links").join(sums, "row", "left")
    names = [*_COUNTS, "n_best", "count_sum"]
    done = done.select("doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names], "groups_sha256")
    empty = rows.where("text is null or text = ''").select("doc_id", *[F.lit(0).cast("long").alias(c) for c in names], F.lit("").alias("groups_sha256"))
    return done.unionByName(empty)
