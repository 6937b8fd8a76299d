"""Near duplicates: one-permutation MinHash, banded buckets, stars of candidates.

1. Every text becomes its set of word shingles; texts with equal sets are one
   class, carried on by the smallest id.
2. The set is sketched by one-permutation hashing: the hash range is cut into
   equal bins and each keeps its smallest hash; an empty bin borrows from the bin
   that its own random probe sequence meets first (optimal densification).
3. Bands of the sketch are bucket keys.  A bucket of k classes gives k - 1
   candidates, a star around its hub, the member that shares most with all
   others, never k * k.
4. A star's edges are confirmed on the full sets.
5. Where a star falls into several components, members outside the hub's
   component are compared with the star in tiles of bounded size; a tile gives at
   most a spanning forest.  So no link between two components is lost to the
   star shape, whatever the size of a bucket.
6. Components of the confirmed links.

With the default 32 bands of 4, two sets at similarity 0.8 miss each other with
probability below 1e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.components import connected_components
from tidelog.llm.scratch import Scratch, copies
from tidelog.llm.shingles import U64, mix, multiplier, shingle_set

BANDS, ROWS, TILE = 32, 4, 192


class Sketcher:
    """One-permutation sketches with optimal densification, as band keys."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 7):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        rng = np.random.default_rng(seed)
        probes = rng.integers(0, self.bins, (self.bins, 64))
        rest = np.array([rng.permutation(self.bins) for _ in range(self.bins)])
        self.probes = np.concatenate([probes, rest], axis=1)
        self.edges = np.array([(b << 64) // self.bins for b in range(self.bins)], U64)
        self.salt = mix(np.arange(1, bands + 1, dtype=U64))

    def sketch(self, hashes: np.ndarray) -> np.ndarray:
        """The smallest hash of each bin, borrowed where the bin is empty; ``hashes`` sorted, not empty."""
        at = np.searchsorted(hashes, self.edges)
        full = np.diff(at, append=len(hashes)) > 0
        smallest = hashes[np.minimum(at, len(hashes) - 1)] - self.edges
        if full.all():
            return smallest
        empty = np.flatnonzero(~full)
        first = full[self.probes[empty]].argmax(axis=1)
        smallest[empty] = smallest[self.probes[empty, first]]
        return smallest

    def band_keys(self, hashes: np.ndarray) -> np.ndarray:
        rows = self.sketch(hashes).reshape(self.bands, self.rows)
        key = self.salt.copy()
        for i in range(self.rows):
            key += mix(rows[:, i] * multiplier(i) + U64(i + 1))
            key = mix(key)
        return key.view(np.int64)


def _features(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(bands, rows)
        for batch in batches:
            sizes, keys, sketches = [], [], []
            for text in batch.column("text"):
                hashes = shingle_set(text.as_py(), width)
                sizes.append(len(hashes))
                keys.append(xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None)
                sketches.append(sketcher.band_keys(hashes) if len(hashes) else None)
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set_key", "bands"],
            )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text.as_py(), width).tobytes() for text in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), pa.array(sets, pa.binary())], names=["rep", "hashes"])

    return run


def _as_set(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), U64)


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets, by looking the smaller up in the larger."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = zip(batch.column("set_a"), batch.column("set_b"), strict=True)
        shared, total = [], []
        for x, y in both:
            a, b = _as_set(x), _as_set(y)
            shared.append(_shared(a, b))
            total.append(len(a) + len(b) - shared[-1])
        yield pa.record_batch(
            [batch.column("center"), batch.column("rep"), pa.array(shared, pa.int64()), pa.array(total, pa.int64())],
            names=["center", "rep", "shared", "total"],
        )


def _tile_links(percent: int):
    """Links across components between the two sides of a tile, as a spanning forest."""

    def run(rows: pa.Table) -> pa.Table:
        left = np.flatnonzero(rows.column("outside").to_numpy())
        right = np.flatnonzero(~rows.column("outside").to_numpy())
        ids, comps = rows.column("rep").to_numpy(), rows.column("component").to_numpy()
        sets = [_as_set(v) for v in rows.column("hashes")]
        shared = _cooccurrence([sets[i] for i in left], [sets[j] for j in right])
        sizes = np.array([len(s) for s in sets], np.int64)
        union = sizes[left][:, None] + sizes[right][None, :] - shared
        linked = (100 * shared >= percent * union) & (comps[left][:, None] != comps[right][None, :])
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        out_a, out_b = [], []
        for i, j in zip(*np.nonzero(linked), strict=True):
            x, y = int(comps[left[i]]), int(comps[right[j]])
            rx, ry = root(x), root(y)
            if rx != ry:
                parent[max(rx, ry)] = min(rx, ry)
                out_a.append(int(ids[left[i]]))
                out_b.append(int(ids[right[j]]))
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return run


def _cooccurrence(left: list[np.ndarray], right: list[np.ndarray], block: int = 4096) -> np.ndarray:
    """Intersection sizes of every left with every right set: products of 0/1 blocks over shared hashes."""
    out = np.zeros((len(left), len(right)), np.float32)
    if not left or not right:
        return out.astype(np.int64)
    common = np.intersect1d(np.concatenate(left), np.concatenate(right))
    for start in range(0, len(common), block):
        words = common[start : start + block]

        def marks(sets: list[np.ndarray], words: np.ndarray = words) -> np.ndarray:
            m = np.zeros((len(sets), len(words)), np.float32)
            for i, s in enumerate(sets):
                part = s[np.searchsorted(s, words[0]) : np.searchsorted(s, words[-1], "right")]
                at = np.searchsorted(words, part)
                m[i, at[words[np.minimum(at, len(words) - 1)] == part]] = 1
            return m

        out += marks(left) @ marks(right).T
    return np.rint(out).astype(np.int64)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, tile: int = TILE) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs (doc_id, text, ...)``.

    Two documents are linked when ``100 * |A n B| >= percent * |A u B|`` for their
    sets of ``width``-word shingles.  ``component_id`` is the smallest id
    reachable over links.  A null or empty text, or one without words, has an
    empty set and is linked with nothing.  Rows that share an id are one node.  A
    row without an id is compared with nothing: its component is null and it is
    kept.  Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    feats = texts.mapInArrow(_features(width, bands, rows), "doc_id long, n_shingles long, set_key binary, bands array<long>")
    feats = scratch.write(feats, "features")

    known = feats.where("doc_id is not null and set_key is not null")
    classes = scratch.write(known.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "classes")
    reps = known.join(classes, [known.set_key == classes.set_key, known.doc_id == classes.rep], "left_semi")
    members = reps.select(F.explode(F.array_distinct("bands")).alias("bucket"), F.col("doc_id").alias("rep")).distinct()
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = scratch.write(members.join(sizes, "bucket"), "members")

    degree = shared.groupBy("rep").agg(F.sum("size").alias("degree"))
    hub = shared.join(degree, "rep").groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("rep")).alias("low"))).alias("top"))
    star = shared.join(hub.select("bucket", (-F.col("top.low")).alias("center")), "bucket").where("center != rep").select("center", "rep").distinct()
    star = scratch.write(star, "star")
    needed = star.select(F.col("rep").alias("doc_id")).union(star.select("center")).distinct()
    wanted = texts.join(known.join(classes, "set_key").where("doc_id = rep").select("doc_id").join(needed, "doc_id", "left_semi"), "doc_id", "left_semi")
    sets = wanted.mapInArrow(_sets(width), "rep long, hashes binary")
    sets = scratch.write(sets.dropDuplicates(["rep"]), "sets")

    pairs = star.join(sets.select("rep", F.col("hashes").alias("set_b")), "rep")
    pairs = pairs.join(sets.select(F.col("rep").alias("center"), F.col("hashes").alias("set_a")), "center")
    checked = pairs.select("center", "rep", "set_a", "set_b").mapInArrow(_confirm, "center long, rep long, shared long, total long")
    checked = scratch.write(checked.withColumn("linked", F.expr(f"100 * shared >= {percent} * total")), "checked")
    links = checked.where("linked").select(F.col("center").alias("a"), F.col("rep").alias("b"))
    first = scratch.write(connected_components(links, scratch, "cc-star"), "components-star")

    more = _residue(checked.select("center", "rep"), first, sets, percent, tile)
    more = scratch.write(more, "links-rest")
    joined = scratch.write(connected_components(links.unionByName(more), scratch, "cc-all"), "components")
    scratch.drop("members", "star", "sets", "checked", "components-star", "links-rest")

    found = classes.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select(
        "set_key", F.coalesce("component", "rep").alias("component_id")
    )
    out = feats.select("doc_id", "n_shingles", "set_key").join(found, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    kept = F.coalesce(component == F.col("doc_id"), F.lit(True))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def _residue(star: DataFrame, components: DataFrame, sets: DataFrame, percent: int, tile: int) -> DataFrame:
    """Links between members of one star that the hub has not joined.

    Members outside the hub's component meet all members in tiles; their sets
    travel once per tile of the other side.
    """
    label = components.select(F.col("node").alias("rep"), "component")
    own = star.unionByName(star.select("center", F.col("center").alias("rep")).distinct())
    own = own.join(label, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    home = label.select(F.col("rep").alias("center"), F.col("component").alias("home"))
    own = own.join(home, "center", "left").withColumn("outside", F.col("component") != F.coalesce("home", "center"))
    counts = own.groupBy("center").agg(F.count("*").alias("n"), F.count_if("outside").alias("n_out")).where("n_out > 0 and n > 2")
    own = own.join(counts, "center").join(sets, "rep")
    all_tiles, out_tiles = copies("n", tile), copies("n_out", tile)
    spread = F.xxhash64("rep", F.lit(5))
    left = own.where("outside").select(
        "center", "rep", "component", F.lit(True).alias("outside"), "hashes",
        F.pmod(spread, out_tiles).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), all_tiles - 1)).alias("j"),
    )
    right = own.select(
        "center", "rep", "component", F.lit(False).alias("outside"), "hashes",
        F.explode(F.sequence(F.lit(0), out_tiles - 1)).alias("i"), F.pmod(spread, all_tiles).cast("int").alias("j"),
    )
    tiles = left.unionByName(right)
    return tiles.groupBy("center", "i", "j").applyInArrow(_tile_links(percent), "a long, b long")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without all but the first of each group of near duplicates.

    Columns are those of ``docs``.  Of rows that share an id one stays; rows
    without an id all stay.
    """
    verdict = near_duplicates(docs, **options).where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(verdict, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(docs.columns).unionByName(docs.where("doc_id is null"))
