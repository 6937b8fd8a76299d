"""Whitening of embeddings with distributed block matrices.

Entries go to a fixed grid as long integers, so that counts, sums and deviations are
exact.  Rows are numbered, centred on the exact mean and laid out as a
``BlockMatrix`` of row blocks; its transpose times itself, the middle dimension
split over many tasks, is the scatter matrix.  Only that matrix (dimension by
dimension) reaches the driver, where ``eigh`` decomposes it, and the whitening matrix
goes back as one block that every row block is multiplied with.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.scratch import Scratch

GRID, SHIFT = 1024, 100_000
#: Beyond this an entry has no exact place on the grid and counts as not finite.
LARGEST = 2.0**42
#: Rows of a block: so many that there are about ``BLOCKS`` blocks, within these limits.
BLOCKS, LEAST_ROWS, MOST_ROWS = 8_192, 1_024, 32_768
#: Blocks multiplied in one task when the scatter matrix is made.
BLOCKS_A_TASK = 8
_ROW = "monotonically_increasing_id()"


def on_grid(vectors: DataFrame, shift: int = SHIFT) -> DataFrame:
    """``vec_id, x``: the usable rows with their entries as ``floor(1024 c) + shift``."""
    rows = vectors.select("vec_id", F.expr("transform(embedding, c -> cast(c as double))").alias("c"))
    rows = rows.where(f"c is not null and forall(c, v -> v is not null and not isnan(v) and abs(v) <= {LARGEST!r})")
    return rows.select("vec_id", F.expr(f"transform(c, v -> cast(floor({GRID} * v) as bigint) + {shift})").alias("x"))


def usual_size(rows: DataFrame) -> int:
    """The most frequent number of dimensions, the larger one of two; 0 without rows."""
    first = rows.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    return first["size"] if first else 0


def numbered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows`` with ``index``, from 0 without gaps; no task sees more than its own rows.

    A row is numbered within its task when it is written; what is read again has the number
    in it, so repeated tasks cannot renumber.  Only one count per writing task is summed up.
    """
    written = scratch.write(rows.withColumn("at", F.expr(_ROW)), "rows")
    counts = written.groupBy(F.expr("shiftright(at, 33)").alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    starts, total = [], 0
    for r in counts:
        starts.append((r["part"], total))
        total += r["n"]
    offsets = rows.sparkSession.createDataFrame(starts, "part long, start long")
    placed = written.withColumn("part", F.expr("shiftright(at, 33)")).join(F.broadcast(offsets), "part")
    return placed.withColumn("index", F.expr("start + (at & 8589934591L)")).drop("part", "start", "at")


def sums(rows: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of rows and exact sums per dimension, combined before the shuffle."""
    n = rows.count()
    per = rows.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(19,0)")).alias("s")).collect()
    found = {r["at"]: int(r["s"]) for r in per}
    return n, [found.get(i, 0) for i in range(size)]


def block_matrix(rows: DataFrame, n: int, size: int, column: str) -> BlockMatrix:
    """Rows with ``index`` and an array of doubles in ``column`` as row blocks."""
    vectors = rows.select("index", array_to_vector(F.col(column)).alias("vector"))
    indexed = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector"), n, size)
    return indexed.toBlockMatrix(min(MOST_ROWS, max(LEAST_ROWS, -(-n // BLOCKS))), size)


def multiply(left: BlockMatrix, right: BlockMatrix, tasks: int = 1) -> BlockMatrix:
    """Product with the middle dimension dealt over ``tasks`` tasks."""
    java = left._java_matrix_wrapper._java_model.multiply(right._java_matrix_wrapper._java_model, tasks)
    return BlockMatrix(java, left.rowsPerBlock, right.colsPerBlock)


def local(matrix: BlockMatrix) -> np.ndarray:
    return matrix.toLocalMatrix().toArray()


def whitening(scatter: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues of the covariance, their shares, and the whitening columns of the first ``most`` components.

    A component whose eigenvalue is zero up to rounding has no whitening: its column is NaN.
    """
    covariance = (scatter + scatter.T) / (2 * n)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    total = float(np.trace(covariance))
    floor = len(covariance) * np.finfo(float).eps * max(float(values[0]), 0.0)
    usable = values > floor
    share = np.where(usable, values, 0.0) / total if total > 0 else np.full(len(values), np.nan)
    columns = np.where(usable, vectors / np.sqrt(np.where(usable, values, 1.0)), np.nan)
    return values, share, columns


def one_block(spark: SparkSession, columns: np.ndarray) -> BlockMatrix:
    rows, cols = columns.shape
    block = Matrices.dense(rows, cols, columns.ravel(order="F").tolist())
    return BlockMatrix(spark.sparkContext.parallelize([((0, 0), block)], 1), rows, cols, rows, cols)


def _identity_error(rows: DataFrame, n: int, size: int) -> float:
    """Largest entry of the projected rows' covariance minus the identity, centred on their own mean."""
    means = rows.select(F.posexplode("w").alias("at", "v")).groupBy("at").agg((F.sum("v") / n).alias("m")).collect()
    centre = [r["m"] for r in sorted(means)]
    shifted = rows.select("index", F.expr(f"transform(w, (v, i) -> v - element_at(array({', '.join(f'{c!r}d' for c in centre)}), i + 1))").alias("w"))
    moved = block_matrix(shifted, n, size, "w").persist(StorageLevel.MEMORY_AND_DISK)
    again = local(multiply(moved.transpose(), moved, _tasks(n)))
    moved._java_matrix_wrapper._java_model.blocks().unpersist(False)
    return float(np.abs(again / n - np.eye(size)).max())


def _tasks(n: int) -> int:
    return max(1, -(-n // max(LEAST_ROWS, -(-n // BLOCKS)) // BLOCKS_A_TASK))


def whiten(vectors: DataFrame, components: int = 8, shift: int = SHIFT) -> DataFrame:
    """One row per usable row of ``vectors (vec_id, embedding, ...)`` and component.

    ``vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact``.
    Every entry becomes ``x = floor(1024 c) + shift``; ``n`` vectors with the
    per-dimension sums S are fitted.  ``deviation`` is the sum of ``(n x - S)^2``
    over the dimensions as a long, null where it does not fit in one;
    ``deviation_exact`` has it as a decimal (null beyond 38 digits).  ``whitened`` is ``x - S / n`` projected on
    the component's unit eigenvector, over the root of its eigenvalue; ``explained``
    the eigenvalue's share of the trace; ``identity_error`` the largest absolute entry
    of the covariance of ``whitened`` minus the identity.

    Rows go whose vector is null, holds null, NaN, infinite or entries above
    ``LARGEST``, or has another number of dimensions than most vectors have (the larger
    of two equally frequent ones).  A component without variance has ``explained`` 0 (null if
    there is no variance at all) and ``whitened`` null, and does not count in
    ``identity_error`` (null if none counts).  Vectors without dimensions and empty
    tables give no rows.  Repeated rows and ids count as often as they stand; other
    columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "whitening")
    usable = on_grid(vectors, shift)
    size = usual_size(usable)
    schema = "component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
    if not size:
        return spark.createDataFrame([], vectors.select("vec_id").schema).selectExpr("vec_id", *(f"cast(null as {c.split(' ')[1]}) as {c.split(' ')[0]}" for c in schema.split(", ")))
    rows = numbered(usable.where(F.size("x") == size), scratch)
    n, total = sums(rows, size)

    # n x - S is whole; dividing it by n rounds once, however far the entries are from zero.
    exact = ", ".join(f"{s}BD" for s in total)
    apart = f"transform(x, (v, i) -> cast(cast(v as decimal(19,0)) * {n}BD as decimal(38,0)) - element_at(cast(array({exact}) as array<decimal(38,0)>), i + 1))"
    rows = rows.withColumn("apart", F.expr(f"transform({apart}, v -> cast(v as decimal(38,0)))"))
    centred = rows.select("index", F.expr(f"transform(apart, v -> cast(v as double) / {n})").alias("c"))
    blocks = block_matrix(centred, n, size, "c").persist(StorageLevel.MEMORY_AND_DISK)
    most = min(components, size)
    _, share, columns = whitening(local(multiply(blocks.transpose(), blocks, _tasks(n))), n, most)

    live = [k for k in range(most) if not np.isnan(columns[0, k])]
    if live:
        projected = multiply(blocks, one_block(spark, columns[:, live])).toIndexedRowMatrix()
        found = callMLlibFunc("getIndexedRows", projected._java_matrix_wrapper._java_model)
        found = found.select("index", vector_to_array(F.col("vector")).alias("w"))
        found = scratch.write(found, "whitened")
        error = _identity_error(found, n, len(live))
        rows = rows.join(found, "index")
    blocks._java_matrix_wrapper._java_model.blocks().unpersist(False)
    places = {k: f"w[{live.index(k)}]" if k in live else "cast(null as double)" for k in range(most)}
    each = ", ".join(f"named_struct('component', {k + 1}, 'whitened', {places[k]}, 'explained', {_double(share[k])})" for k in range(most))
    squares = "aggregate(apart, cast(0 as decimal(38,0)), (t, v) -> try_add(t, try_multiply(v, v)))"
    rows = rows.select("vec_id", F.expr(squares).alias("deviation_exact"), F.inline(F.expr(f"array({each})")))
    return rows.select(
        "vec_id", "component", F.lit(n).cast("long").alias("n"), F.expr("try_cast(deviation_exact as bigint)").alias("deviation"),
        "whitened", "explained", F.expr(_double(error if live else np.nan)).alias("identity_error"), "deviation_exact",
    )


def _double(value: float) -> str:
    return "cast(null as double)" if np.isnan(value) else f"{float(value)!r}d"
