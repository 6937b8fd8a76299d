"""Exact nearest binary codes by multi-index hashing with growing radii.

A vector becomes the code of its signs.  The code is cut into segments, each
segment's value is an index key.  Two codes that differ in fewer than
``m * (r + 1)`` bits differ in at most ``r`` bits in one of their ``m`` segments; so
once all segments were probed up to radius ``r``, every code within
``m * (r + 1) - 1`` has been met.  A query is done when its k-th verified distance
is within that bound; the others go on with ``r + 1``.  Equal codes are one index
entry with the smallest ids it needs, so a code that half the table shares costs
what any other does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.scratch import Scratch
from tidelog.operators.ranking import first_per_group

SEGMENT_BITS = 16


def sign_code(vector: str) -> Column:
    """Signs of a vector as segment values of 16 bits, the first element in the lowest bit; 1 is positive."""
    return F.expr(f"""transform(sequence(0, (size({vector}) - 1) div {SEGMENT_BITS}), g ->
        aggregate(transform(slice({vector}, g * {SEGMENT_BITS} + 1, {SEGMENT_BITS}), (x, i) -> if(x > 0, shiftleft(1, i), 0)), 0, (a, b) -> a | b))""")


def _distance(a: str, b: str) -> Column:
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (total, n) -> total + n)")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``(query_id, rank, vec_id, distance)``: the ``k`` codes nearest to each query's.

    ``vectors`` and ``queries`` have ``vec_id`` and ``embedding``.  Distance is the number of
    differing signs; ties go to the smaller id; a query does not find its own id.
    Ranks begin at 1.  Fewer than ``k`` rows come out only where there are no more
    ids.  Vectors that are null, empty or hold nulls have no code and are neither
    found nor answered; only vectors of one length are compared.  Rows that repeat
    an id with one code count once.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "hamming")
    wanted = k + 1  # its own id may be among them

    def coded(df: DataFrame) -> DataFrame:
        df = df.where("vec_id is not null and embedding is not null and size(embedding) > 0 and not exists(embedding, x -> x is null)")
        return df.select("vec_id", F.size("embedding").alias("bits"), sign_code("embedding").alias("code")).distinct()

    members = first_per_group(coded(vectors), ["bits", "code"], [F.col("vec_id")], wanted, spread=["vec_id"])
    index = members.groupBy("bits", "code").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    index = scratch.write(index, "index")
    of_code = [F.get("ids", F.lit(0)).alias("first"), F.size("ids").alias("n")]
    entries = scratch.write(index.select("bits", F.posexplode("code").alias("seg", "val"), "code", *of_code), "entries")
    asked = scratch.write(coded(queries), "queries")
    open_codes = scratch.write(asked.select("bits", F.col("code").alias("q")).distinct(), "open-0")

    done: list[DataFrame] = []
    best: DataFrame | None = None
    found_columns = ["bits", "q", "code", "first", "n", "distance"]
    for radius in range(SEGMENT_BITS + 1):
        width = f"least({SEGMENT_BITS}, bits - seg * {SEGMENT_BITS})"
        masks = f"filter(sequence(0, shiftleft(1, {SEGMENT_BITS}) - 1), x -> bit_count(x) = {radius})"
        probes = open_codes.select("bits", "q", F.posexplode("q").alias("seg", "own"))
        probes = probes.select("bits", "q", "seg", "own", F.explode(F.expr(masks)).alias("mask")).where(f"mask < shiftleft(1, {width})")
        probes = probes.select("bits", "q", "seg", F.expr("own ^ mask").alias("val"))
        # A few queries become very many probes, which no size estimate sees: never to be broadcast.
        hits = probes.hint("merge").join(entries, ["bits", "seg", "val"]).select("bits", "q", "code", "first", "n").distinct()
        found = hits.withColumn("distance", _distance("q", "code")).select(found_columns)
        if best is not None:
            found = found.unionByName(best).distinct()
        # Of the nearest codes as many as ids are wanted: each has one id at least, and its smallest decides among ties.
        ranked = first_per_group(found, ["bits", "q"], [F.col("distance"), F.col("first")], wanted, spread=["first"])
        ranked = scratch.write(ranked, f"best-{radius}")
        so_far = F.sum("n").over(Window.partitionBy("bits", "q").orderBy("rank"))
        state = ranked.withColumn("so_far", so_far).groupBy("bits", "q").agg(F.min(F.when(F.col("so_far") >= wanted, F.col("distance"))).alias("far"))
        covered = f"((bits + {SEGMENT_BITS - 1}) div {SEGMENT_BITS}) * {radius + 1} - 1"
        closed = F.expr(f"coalesce(far <= {covered}, false)") if radius < SEGMENT_BITS else F.lit(True)
        state = scratch.write(open_codes.join(state, ["bits", "q"], "left").select("bits", "q", closed.alias("closed")), f"state-{radius}")
        done.append(ranked.join(state.where("closed"), ["bits", "q"], "left_semi"))
        open_codes = state.where("not closed").select("bits", "q")
        best = ranked.join(open_codes, ["bits", "q"], "left_semi").select(found_columns)
        if open_codes.isEmpty():
            break
    answers = done[0]
    for part in done[1:]:
        answers = answers.unionByName(part)
    answers = answers.select("bits", "q", "code", "distance").join(index, ["bits", "code"])
    answers = answers.select("bits", "q", "distance", F.explode("ids").alias("vec_id"))
    out = asked.select(F.col("vec_id").alias("query_id"), "bits", F.col("code").alias("q")).join(answers, ["bits", "q"])
    out = first_per_group(out.where("vec_id != query_id"), ["query_id", "bits", "q"], [F.col("distance"), F.col("vec_id")], k, spread=["vec_id"])
    return out.select("query_id", "rank", "vec_id", "distance")
