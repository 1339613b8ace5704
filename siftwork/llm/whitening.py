"""Embedding whitening with distributed block matrices.

The distinct vectors are numbered, centred and put into blocks of rows of a ``BlockMatrix``. Its transpose times itself is the
scatter matrix, cut along the rows into so many products that no task holds more than a few blocks. The eigenvectors of the
small covariance come from a local ``eigh``; a second block product with the whitening matrix projects the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession, functions as F

from siftwork.llm.common import Scratch, map_runs, text_session
from siftwork.llm.vector_codes import clean
from siftwork.plans.lookup import lookup

SCALE = 256
COMPONENTS = 4
BLOCK_ROWS, BLOCK_COLS = 4096, 1024
TASK_BLOCKS = 16  # blocks that one partial product holds


def numbered(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """The rows with ``at``, whole numbers from 0 without gaps, and how many there are.

    The numbers inside a partition are written first, so they stay when an executor is lost; the partitions' counts, one
    number each, then give every partition its start.
    """
    marked = scratch.keep(rows.withColumn("_m", F.monotonically_increasing_id()), "marked")
    part = F.shiftright("_m", 33)
    counts = sorted((r[0], r[1]) for r in marked.groupBy(part.alias("part")).count().collect())
    starts, n = [], 0
    for p, c in counts:
        starts.append((p, n))
        n += c
    start = rows.sparkSession.createDataFrame(starts, "_part long, _start long")
    out = marked.withColumn("_part", part).join(F.broadcast(start), "_part")  # a row per partition
    return out.withColumn("at", F.col("_start") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m", "_part", "_start"), n


def block_matrix(blocks: DataFrame, n: int, width: int, rows: int = BLOCK_ROWS, cols: int = BLOCK_COLS) -> BlockMatrix:
    """A matrix out of (block, body): float64 rows of each block of rows."""
    cuts = list(range(0, width, cols))

    def cut(r):
        body = np.frombuffer(r.body, np.float64).reshape(-1, width)
        return [((r.block, k), DenseMatrix(len(body), min(cols, width - c), body[:, c : c + cols].ravel(order="F"))) for k, c in enumerate(cuts)]

    return BlockMatrix(blocks.rdd.flatMap(cut), rows, cols, n, width)


def _times(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """The product; ``splits`` cuts the shared dimension, else all blocks that make one block of the result meet in one task."""
    product = left._java_matrix_wrapper._java_model.multiply(right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, left.rowsPerBlock, right.colsPerBlock)


def scatter(matrix: BlockMatrix, task_blocks: int = TASK_BLOCKS) -> np.ndarray:
    """The transpose times the matrix, small and square."""
    splits = max(1, -(-matrix.numRowBlocks // task_blocks))
    return _times(matrix.transpose(), matrix, splits).toLocalMatrix().toArray()


def projected(matrix: BlockMatrix, by: np.ndarray, spark: SparkSession) -> DataFrame:
    """(at, values): each row of the matrix times ``by``."""
    size, k = matrix.colsPerBlock, by.shape[1]
    parts = [((j, 0), DenseMatrix(len(x), k, x.ravel(order="F"))) for j in range(0, -(-len(by) // size)) for x in [by[j * size : (j + 1) * size]]]
    small = BlockMatrix(spark.sparkContext.parallelize(parts, 1), size, k, len(by), k)
    rows = matrix.rowsPerBlock
    out = _times(matrix, small, 1).blocks.map(lambda b: (b[0][0], np.ascontiguousarray(b[1].toArray()).tobytes()))

    def spread(batches):
        for b in batches:
            for block, body in zip(b.column("block").to_pylist(), b.column("body").to_pylist()):
                x = np.frombuffer(body, np.float64)
                n = len(x) // k
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1, k), pa.int32()), pa.array(x))
                yield pa.RecordBatch.from_arrays([pa.array(block * rows + np.arange(n), pa.int64()), values], ["at", "values"])

    return spark.createDataFrame(out, "block long, body binary").mapInArrow(spread, "at long, values array<double>")


def blocked(table: DataFrame, column: str, shift: np.ndarray, rows: int = BLOCK_ROWS) -> DataFrame:
    """(block, body) of the rows (at, ``column``), each less ``shift``."""

    def body(run: pa.Table) -> pa.Table:
        t = run.combine_chunks().sort_by("at")
        x = t.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1)
        return pa.table({"block": pa.array([t.column("block")[0].as_py()], pa.int64()), "body": pa.array([(x - shift).tobytes()], pa.binary())})

    return map_runs(table.select(F.floor(F.col("at") / rows).cast("long").alias("block"), "at", column), ["block"], body, "block long, body binary")


def deviations(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """The sum over dimensions of (n x - total)**2, exact; None where 64 bits do not hold it."""
    most = max((abs(s) for s in total), default=0) + n * (int(np.abs(x).max()) if x.size else 0)
    if most**2 * max(1, len(total)) < 1 << 63:
        d = n * x - np.array(total, np.int64)
        return (d * d).sum(axis=1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, total)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def whitened(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, rows: int = BLOCK_ROWS, cols: int = BLOCK_COLS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each vector of finite components (vec_id, embedding).

    Rows whose vector is null or holds a null or non-finite component give nothing; other rows, repeated ones and those
    without id too, give one row per component, as many as there are dimensions if these are fewer. Mean and covariance count
    each distinct vector once. A component without variance has a null value, and explains 0 (null if nothing varies); then
    ``identity_error`` is that of the others. A deviation beyond 64 bits is null. An empty table gives no row. All vectors
    must have one length, else a ValueError says so. Other columns are not read.
    """
    spark = text_session(vectors.sparkSession)
    scratch = Scratch(spark, "white")
    x = F.transform(F.col("embedding").cast("array<double>"), lambda c: F.floor(c * scale).cast("long"))
    all_rows = scratch.keep(vectors.filter(clean(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")), "rows")
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    low, high = all_rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if not high:
        return spark.createDataFrame([], schema)
    if low != high:
        raise ValueError(f"vectors of {low} to {high} components")
    width = low
    # Copies of a very common vector are put together before the shuffle.
    table, n = numbered(all_rows.select("x").distinct(), scratch)
    table = scratch.keep(table, "table")
    sums = {r[0]: r[1] for r in table.select(F.posexplode("x").alias("d", "v")).groupBy("d").agg(F.sum("v")).collect()}
    total = [sums[d] for d in range(width)]
    mean = np.array(total, np.float64) / n

    matrix = block_matrix(scratch.keep(blocked(table, "x", mean, rows), "blocks"), n, width, rows, cols)
    covariance = scatter(matrix) / n
    value, vector = np.linalg.eigh((covariance + covariance.T) / 2)
    k = min(components, width)
    value, vector = value[::-1][:k], vector[:, ::-1][:, :k]
    trace = float(np.trace(covariance))
    varies = value > width * np.finfo(float).eps * max(float(value[0]), 0.0)
    by = vector / np.sqrt(np.where(varies, value, 1.0))
    white = scratch.keep(projected(matrix, by, spark), "white")
    # The covariance of the result, by the same means.
    own = scatter(block_matrix(scratch.keep(blocked(white, "values", np.zeros(k), rows), "again"), n, k, rows, cols)) / n
    off = np.abs(own - np.eye(k))[np.ix_(varies, varies)]
    error = float(off.max()) if off.size else None

    @F.arrow_udf("bigint")
    def deviation(x: pa.Array) -> pa.Array:
        values = x.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(x), width)
        return pa.array(deviations(values, n, total), pa.int64())

    known = table.withColumn("deviation", deviation("x")).join(white, "at").select("x", "deviation", "values")
    out = lookup(all_rows, known, ["x"], "inner")
    each = F.posexplode(F.arrays_zip("values", F.array(*[F.lit(bool(v)) for v in varies]).alias("varies"), F.array(*[F.lit(max(float(v), 0.0) / trace if trace > 0 else None).cast("double") for v in value]).alias("explained")))
    out = out.select("vec_id", "deviation", each.alias("place", "each"))
    return out.select(
        "vec_id",
        (F.col("place") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.when(F.col("each.varies"), F.col("each.values")).alias("whitened"),
        F.col("each.explained").alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
