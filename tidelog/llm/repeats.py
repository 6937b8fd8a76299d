"""Repeated strings removed: prefix doubling over the positions that can still repeat.

Every string of ``LENGTH`` bytes is a position to be ranked.  Ranks are names: two
positions have the same rank at a length when the strings of that length there are
equal.  Ranks of 8, 16 and 32 bytes follow from each other by pairing the ranks at
a position and half a length further on; so do those of 64, 128 and, from two
overlapping ones, 200 bytes.  After each of three lengths Spark sorts what is left
by rank and lets go of what is unique:

1. 32 bytes.  Among the 32-byte ranks inside a string of ``LENGTH`` bytes the
   smallest one is its anchor, found from its content alone, so equal strings have
   equal anchors in the same place.  Consecutive positions with one anchor are a
   run.  Runs with an anchor rank that stands nowhere else cannot repeat.
2. Whole runs, by the pair of the ranks of their first and last position.  A run
   of which an equal one exists repeats as a whole, and equal runs go on as one.
3. Single positions at ``LENGTH``, for different runs that share an anchor rank.

What repeats is then cut out of the texts.  An anchor shared by very many
different runs is not gathered in one task: its positions are counted by rank
across the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.scratch import Scratch
from tidelog.llm.shingles import U64, mix

LENGTH = 200
GRAM = 32
WINDOW = LENGTH - GRAM + 1
#: Bytes of short texts ranked at once, and of a longer one; there a run ends.
BLOCK, LONGEST = 1 << 18, 1 << 20
#: Different runs of one anchor that one task may compare.
GATHER = 2_048
_A, _B, _C = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _A + mix(b + _C))


def gram_ranks(data: np.ndarray) -> np.ndarray:
    """Ranks of all 32-byte strings, doubled up from single bytes."""
    x = data.astype(U64)
    x = x[:-1] | (x[1:] << U64(8))
    x = x[:-2] | (x[2:] << U64(16))
    x = x[:-4] | (x[4:] << U64(32))
    x = mix(x + _B)
    x = _pair(x[:-8], x[8:])
    return _pair(x[:-16], x[16:])


def long_ranks(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ranks of the ``LENGTH``-byte strings at given positions."""

    def r64(p: np.ndarray) -> np.ndarray:
        return _pair(grams[p], grams[p + 32])

    def r128(p: np.ndarray) -> np.ndarray:
        return _pair(r64(p), r64(p + 64))

    return _pair(r128(at), r128(at + (LENGTH - 128)))


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, U64)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _blocks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Consecutive texts of about ``BLOCK`` bytes together, one at least."""
    reach, start = np.cumsum(sizes), 0
    while start < len(sizes):
        done = reach[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(reach, done + BLOCK, "right")))
        yield start, stop
        start = stop


def runs_of(raws: list[bytes]) -> tuple[np.ndarray, ...]:
    """Runs of some texts: number of the text, anchor rank, first position, positions less one, anchor offset, rank of the run.

    Texts are laid end to end, so that one call ranks many short ones; positions whose string would
    reach into the next text are left out.  A text over ``LONGEST`` is ranked in parts, where runs end.
    """
    sizes = np.fromiter(map(len, raws), np.int64, len(raws))
    parts = []
    for start, stop in _blocks(sizes):
        whole = b"".join(raws[start:stop])
        begin = np.cumsum(sizes[start:stop]) - sizes[start:stop]
        for at in range(0, len(whole) - LENGTH + 1, LONGEST):
            part = whole[at : at + LONGEST + LENGTH - 1] if len(whole) > LONGEST + LENGTH - 1 else whole
            parts.append(_runs(np.frombuffer(part, np.uint8), begin - at, sizes[start:stop], start, at))
    if not parts:
        return tuple(np.empty(0, np.int64) for _ in range(6))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _runs(data: np.ndarray, begin: np.ndarray, sizes: np.ndarray, number: int, at: int) -> tuple[np.ndarray, ...]:
    grams = gram_ranks(data)
    keyed = ((grams >> U64(32)) << U64(32)) | np.arange(len(grams), dtype=U64)
    anchor = (_window_minima(keyed, WINDOW) & U64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(len(anchor) + 1, np.int8)
    whole = sizes >= LENGTH
    np.add.at(inside, np.clip(begin[whole], 0, len(anchor)), 1)
    np.add.at(inside, np.clip((begin + sizes)[whole] - LENGTH + 1, 0, len(anchor)), -1)
    inside = np.cumsum(inside[:-1]).astype(bool)
    goes_on = np.concatenate(([False], inside[1:] & inside[:-1] & (anchor[1:] == anchor[:-1])))
    first = np.flatnonzero(inside & ~goes_on)
    last = np.flatnonzero(inside & ~np.append(goes_on[1:], False))
    place = anchor[first]
    rank = _pair(_pair(long_ranks(grams, first), long_ranks(grams, last)), ((last - first) * 256 + (place - first)).astype(U64))
    owner = np.searchsorted(begin, first, "right") - 1
    # Empty texts begin where the next one does; the last of them is the text itself.
    return owner + number, grams[place], first - begin[owner], last - first, place - first, rank


_RUN = "row_key long, anchor long, run long, at long, more int, off int"


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _emit_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        anchors = runs_of([_raw(t.as_py()) for t in batch.column("text")])[1]
        yield pa.record_batch([pa.array(anchors.view(np.int64))], names=["anchor"])


def _emit_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        owner, anchors, first, more, off, rank = runs_of([_raw(t.as_py()) for t in batch.column("text")])
        columns = [
            batch.column("row_key").take(pa.array(owner)), pa.array(anchors.view(np.int64)), pa.array(rank.view(np.int64)),
            pa.array(first), pa.array(more.astype(np.int32)), pa.array(off.astype(np.int32)),
        ]
        yield pa.record_batch(columns, names=["row_key", "anchor", "run", "at", "more", "off"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the way through a shuffle."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed = [press.compress(_raw(t.as_py())) for t in batch.column("text")]
        others = [c for c in batch.schema.names if c != "text"]
        yield pa.record_batch([*[batch.column(c) for c in others], pa.array(packed, pa.binary())], names=[*others, "packed"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the runs asked for, from their texts."""
    for batch in batches:
        out: dict[str, list] = {"anchor": [], "run": [], "n": [], "more": [], "off": [], "content": []}
        for packed, runs in zip(batch.column("packed"), batch.column("runs"), strict=True):
            raw = zstandard.decompress(packed.as_py())
            for r in runs.as_py():
                for name in ("anchor", "run", "n", "more", "off"):
                    out[name].append(r[name])
                out["content"].append(raw[r["at"] : r["at"] + r["more"] + LENGTH])
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(out.values(), kinds, strict=True)], names=list(out))


def _positions(rows: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of every position of the runs: number of the run, position in it, rank at ``LENGTH``."""
    more = rows.column("more").to_numpy(zero_copy_only=False).astype(np.int64)
    contents = [c.as_buffer() for c in rows.column("content")]
    data = np.frombuffer(b"".join(contents) + bytes(LENGTH), np.uint8)
    begin = np.concatenate(([0], np.cumsum([len(c) for c in contents])))[:-1]
    owner = np.repeat(np.arange(len(more)), more + 1)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(more + 1) - (more + 1), more + 1)
    return owner, inside, long_ranks(gram_ranks(data), begin[owner] + inside)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeating stretches of different runs that share an anchor; rows come sorted by anchor."""

    def solve(rows: pa.RecordBatch) -> pa.RecordBatch:
        owner, inside, rank = _positions(rows)
        anchor = rows.column("anchor").to_numpy()
        place = (rows.column("off").to_numpy().astype(np.int64)[owner] - inside) + LENGTH * np.unique(anchor, return_inverse=True)[1][owner]
        order = np.lexsort((rank, place))
        new = np.concatenate(([True], (rank[order][1:] != rank[order][:-1]) | (place[order][1:] != place[order][:-1])))
        weight = np.minimum(rows.column("n").to_numpy(), 2)[owner][order]
        total = np.add.reduceat(weight, np.flatnonzero(new))
        repeats = np.empty(len(owner), bool)
        repeats[order] = (total >= 2)[np.cumsum(new) - 1]
        return _stretches(rows, owner, inside, repeats)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        anchors = batch.column("anchor").to_numpy()
        if anchors[0] == anchors[-1]:
            continue
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        anchors = whole.column("anchor").to_numpy()
        cut = int(np.flatnonzero(anchors != anchors[-1])[-1]) + 1
        yield solve(whole.slice(0, cut))
        held = [whole.slice(cut)]
    if held and sum(h.num_rows for h in held):
        yield solve(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _stretches(rows: pa.RecordBatch, owner: np.ndarray, inside: np.ndarray, repeats: np.ndarray) -> pa.RecordBatch:
    """Maximal stretches of repeating positions as rows of the runs they are in."""
    at = np.flatnonzero(repeats)
    breaks = (owner[at][1:] != owner[at][:-1]) | (inside[at][1:] != inside[at][:-1] + 1)
    first = np.concatenate(([True], breaks)) if len(at) else np.empty(0, bool)
    last = np.concatenate((breaks, [True])) if len(at) else np.empty(0, bool)
    who = owner[at][first]
    columns = [rows.column("anchor").take(pa.array(who)), rows.column("run").take(pa.array(who))]
    columns += [pa.array(inside[at][first].astype(np.int32)), pa.array(inside[at][last].astype(np.int32))]
    return pa.record_batch(columns, names=["anchor", "run", "lo", "hi"])


def _emit_positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            rows = batch.slice(start, 1024)
            owner, inside, rank = _positions(rows)
            take = pa.array(owner)
            place = rows.column("off").to_numpy().astype(np.int32)[owner] - inside
            columns = [rows.column(c).take(take) for c in ("anchor", "run", "n")]
            columns += [pa.array(inside.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(rank.view(np.int64))]
            yield pa.record_batch(columns, names=["anchor", "run", "n", "lo", "place", "rank"])


def remove(raw: bytes, stretches: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """Bytes removed, maximal removed runs, and what is left, for stretches of repeating positions."""
    kept, removed, spans, end = [], 0, 0, 0
    reach = -1
    for lo, hi in sorted(stretches):
        if lo > reach:
            spans += 1
            kept.append(raw[end:lo])
        end = max(end, hi + LENGTH)
        removed += end - max(lo, reach, 0)
        reach = end
    kept.append(raw[end:])
    return removed, spans, b"".join(kept)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for packed, found in zip(batch.column("packed"), batch.column("stretches"), strict=True):
            raw = zstandard.decompress(packed.as_py())
            removed, spans, left = remove(raw, [(s["lo"], s["hi"]) for s in found.as_py() or []])
            out.append((len(raw), removed, spans, left))
        columns = [batch.column("doc_id")]
        columns += [pa.array([r[i] for r in out], pa.int64()) for i in range(3)] + [pa.array([r[3] for r in out], pa.binary())]
        yield pa.record_batch(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` of every row of ``docs (doc_id, text, ...)``.

    A byte goes when a string of ``LENGTH`` bytes over it also starts anywhere else,
    in the same text or another, overlaps included; strings are judged on the
    input.  ``kept`` are the remaining bytes; they need not be valid UTF-8.  A null
    text counts as empty, texts shorter than ``LENGTH`` stay whole, repeated rows
    repeat each other, ids may be null.  Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("row_key", F.xxhash64("doc_id", "text"))
    long_enough = texts.where(F.octet_length("text") >= LENGTH)

    anchors = long_enough.select("text").mapInArrow(_emit_anchors, "anchor long")
    shared = scratch.write(anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "shared")
    runs = long_enough.select("row_key", "text").mapInArrow(_emit_runs, _RUN)
    runs = scratch.write(runs.join(shared, "anchor", "left_semi"), "runs")

    first = F.min(F.struct("row_key", "at")).alias("first")
    kinds = scratch.write(runs.groupBy("anchor", "run", "more", "off").agg(F.count("*").alias("n"), first), "kinds")
    several = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    alone = kinds.join(several, "anchor", "left_anti").where("n > 1").select("anchor", "run", F.lit(0).alias("lo"), F.col("more").alias("hi"))

    asked = kinds.join(several, "anchor").withColumns({"row_key": F.col("first.row_key"), "at": F.col("first.at")})
    by_row = asked.groupBy("row_key").agg(F.collect_list(F.struct("anchor", "run", "n", "at", "more", "off")).alias("runs"))
    packed = long_enough.select("row_key", "text").mapInArrow(_pack, "row_key long, packed binary")
    cut = packed.join(by_row, "row_key").select("packed", "runs").mapInArrow(_cut, "anchor long, run long, n long, more int, off int, content binary")
    cut = scratch.write(cut.dropDuplicates(["anchor", "run"]).join(several, "anchor"), "contents")
    few = cut.where(f"kinds <= {GATHER}").repartition("anchor").sortWithinPartitions("anchor")
    compared = few.mapInArrow(_compare, "anchor long, run long, lo int, hi int")
    many = cut.where(f"kinds > {GATHER}").drop("kinds").mapInArrow(_emit_positions, "anchor long, run long, n long, lo int, place int, rank long")
    same = ["anchor", "place", "rank"]
    twice = many.groupBy(same).agg(F.sum("n").alias("total")).where("total > 1").drop("total")
    counted = many.join(twice, same, "left_semi").select("anchor", "run", "lo", F.col("lo").alias("hi"))
    verdicts = alone.unionByName(compared).unionByName(counted).groupBy("anchor", "run").agg(F.collect_list(F.struct("lo", "hi")).alias("parts"))
    verdicts = scratch.write(verdicts, "verdicts")
    scratch.drop("contents", "kinds")

    found = runs.select("anchor", "run", "row_key", "at").join(verdicts, ["anchor", "run"])
    found = found.select("row_key", F.expr("transform(parts, p -> named_struct('lo', at + p.lo, 'hi', at + p.hi))").alias("parts"))
    by_row = found.groupBy("row_key").agg(F.flatten(F.collect_list("parts")).alias("stretches"))
    everything = texts.select("row_key", "doc_id", "text").mapInArrow(_pack, texts.select("row_key", "doc_id").schema.add("packed", "binary"))
    joined = everything.join(by_row, "row_key", "left").select("doc_id", "packed", "stretches")
    schema = docs.select("doc_id").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary")
    return joined.mapInArrow(_finish, schema)

