"""Whitening of embeddings with MLlib's BlockMatrix.

``store`` keeps the usable vectors, as exact integers x = floor(SCALE * c) + SHIFT,
in the shared folder: one row is a block of consecutive rows of one task, with the
rows' ids and their sums. ``fit`` numbers the blocks, centres each to (n * x - S) / n
and forms a tall BlockMatrix of them; its transpose times itself, with the middle
dimension split over all tasks, is the scatter, whose d x d entries are the only thing
that the driver sees, for eigh. ``project`` multiplies the centred blocks by the
whitening matrix: MLlib deals a product over the square root of the tasks in each
direction, so the tall matrix is laid out as a square grid of blocks, C of them side
by side, and the whitening matrix as a C-fold block diagonal. Nothing but counts, sums
and d x d matrices leaves the executors.

Defined cases: vectors that are null, empty, or hold null or non-finite entries are
dropped, and so are those of another length than the most frequent one (of equally
frequent ones the longest); components of an eigenvalue that is zero to double
precision are left out, so equal vectors give no row, and the numbering stays; an
empty table gives an empty result; a null or repeated vec_id is answered row by row;
other columns are ignored; entries of ``SCALE * c`` beyond 2^40, and deviations
beyond a long, are refused.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from docstrata.session import stored_path, table

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
#: Entries of one block of the matrix.
BLOCK_ENTRIES = 1 << 18
#: Largest size of SCALE * c that is taken.
LARGEST = 1 << 40

_BLOCK = StructType([StructField("at", StructType([StructField("row", LongType()), StructField("column", LongType())])), StructField("block", MatrixUDT())])


@dataclass
class Stored:
    """Blocks of integer vectors in the shared folder."""

    frame: DataFrame
    length: int
    per_block: int
    n: int
    sums: np.ndarray
    #: First block number of each task that wrote blocks, and the number of all.
    first: dict[int, int] = field(default_factory=dict)
    blocks: int = 0


@dataclass
class Fitted:
    #: d x k: columns are unit eigenvectors over the root of their eigenvalue, by falling eigenvalue.
    matrix: np.ndarray
    explained: np.ndarray


def usable(vectors: DataFrame) -> DataFrame:
    """The rows whose vector has entries, none of them null or non-finite, as vec_id and c."""
    c = F.col("c")
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("c"))
    return rows.where(F.size(c) > 0).where(F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))


def _blocks(length: int, per_block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held, waiting = TaskContext.get().partitionId(), 0, [], 0
        ids: list[pa.Array] = []

        def block(size: int) -> pa.RecordBatch:
            nonlocal k, held, ids, waiting
            x, every = np.concatenate(held), pa.concat_arrays(ids)
            held, ids, waiting = [x[size:]], [every.slice(size)], waiting - size
            k += 1
            one = lambda values: pa.ListArray.from_arrays([0, len(values)], values)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([k - 1], pa.int64()), one(every.slice(0, size)), one(pa.array(x[:size].ravel())), one(pa.array(x[:size].sum(axis=0)))], ["part", "k", "vec_ids", "x", "sums"])

        for batch in batches:
            c = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
            scaled = np.floor(SCALE * c)
            if len(scaled) and np.abs(scaled).max() > LARGEST:
                raise OverflowError("an entry is too large for exact integers")
            held.append(scaled.astype(np.int64) + SHIFT)
            ids.append(batch.column(0))
            waiting += batch.num_rows
            while waiting >= per_block:
                yield block(per_block)
        if waiting:
            yield block(waiting)

    return run


def store(vectors: DataFrame) -> Stored | None:
    """The usable vectors as stored blocks; None without any."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    sizes = rows.groupBy(F.size("c").alias("length"), F.spark_partition_id().alias("part")).count().groupBy("length").agg(F.sum("count").alias("n"), F.max("count").alias("most"))
    top = sizes.orderBy(F.desc("n"), F.desc("length")).limit(1).collect()
    if not top:
        return None
    length = top[0]["length"]
    per_block = max(1, min(BLOCK_ENTRIES // length, top[0]["most"]))
    kind = rows.schema["vec_id"].dataType.simpleString()
    at = stored_path(spark, "vectors")
    rows.where(F.size("c") == length).mapInArrow(_blocks(length, per_block), f"part bigint, k bigint, vec_ids array<{kind}>, x array<bigint>, sums array<bigint>").write.parquet(at)
    frame = spark.read.parquet(at)
    sums = frame.select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
    # A row a task: how many blocks and vectors it wrote.
    parts = frame.groupBy("part").agg(F.count("*").alias("blocks"), F.sum(F.size("vec_ids")).alias("n")).orderBy("part").collect()
    stored = Stored(frame, length, per_block, sum(r["n"] for r in parts), np.array([r["s"] for r in sums], np.int64))
    for r in parts:
        stored.first[r["part"]] = stored.blocks
        stored.blocks += r["blocks"]
    return stored


def _deviations(x: np.ndarray, stored_n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exact."""
    most = int(np.abs(x).max()) * stored_n + int(np.abs(sums).max())
    if most >= 1 << 63:
        raise OverflowError("n * x is beyond a long")
    return stored_n * x - sums


def _centred(stored: Stored, columns: int):
    n, sums, length, per_block, first = stored.n, stored.sums, stored.length, stored.per_block, stored.first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = batch.column(2)[i].values.to_numpy(zero_copy_only=False).reshape(-1, length)
                number = first[batch.column(0)[i].as_py()] + batch.column(1)[i].as_py()
                # A task's last block is filled up with rows of zeros, which add nothing to the scatter.
                full = np.zeros((per_block, length))
                full[: len(x)] = _deviations(x, n, sums) / n
                block = {"type": 1, "numRows": per_block, "numCols": length, "colPtrs": None, "rowIndices": None, "values": pa.array(full.ravel()), "isTransposed": True}
                kinds = {"type": pa.int8(), "numRows": pa.int32(), "numCols": pa.int32(), "colPtrs": pa.list_(pa.int32()), "rowIndices": pa.list_(pa.int32()), "values": pa.list_(pa.float64()), "isTransposed": pa.bool_()}
                made = pa.StructArray.from_arrays([pa.ListArray.from_arrays([0, full.size], block[k]) if k == "values" else pa.array([block[k]], kind) for k, kind in kinds.items()], list(kinds))
                at = pa.StructArray.from_arrays([pa.array([number // columns], pa.int64()), pa.array([number % columns], pa.int64())], ["row", "column"])
                yield pa.RecordBatch.from_arrays([at, made], ["at", "block"])

    return run


def _matrix(stored: Stored, columns: int) -> BlockMatrix:
    """The centred blocks, ``columns`` of them side by side."""
    frame = stored.frame.select("part", "k", "x").mapInArrow(_centred(stored, columns), _BLOCK)
    rows = -(-stored.blocks // columns) * stored.per_block
    return BlockMatrix(callMLlibFunc("createBlockMatrix", frame, stored.per_block, stored.length, rows, columns * stored.length), stored.per_block, stored.length)


def _scatter(matrix: BlockMatrix, splits: int) -> np.ndarray:
    turned = matrix.transpose()
    # PySpark's multiply has no number of splits of the middle dimension; without them one task would get all blocks.
    product = turned._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, turned.rowsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def fit(stored: Stored, components: int = COMPONENTS) -> Fitted:
    spark = stored.frame.sparkSession
    splits = max(1, min(stored.blocks, max(spark.sparkContext.defaultParallelism, stored.frame.rdd.getNumPartitions())))
    covariance = _scatter(_matrix(stored, 1), splits) / stored.n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = values[:components] > max(values[0], 0) * len(values) * np.finfo(float).eps
    chosen, vectors = values[:components][keep], vectors[:, :components][:, keep]
    return Fitted(vectors / np.sqrt(chosen), chosen / np.trace(covariance))


def _projected(blocks: DataFrame, columns: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at, block = batch.column(0)[i].as_py(), batch.column(1)[i]
                values = block["values"].values.to_numpy(zero_copy_only=False)
                shape = (block["numRows"].as_py(), k)
                y = values.reshape(shape) if block["isTransposed"].as_py() else values.reshape(shape[::-1]).T
                yield pa.RecordBatch.from_arrays([pa.array([at["row"] * columns + at["column"]], pa.int64()), pa.ListArray.from_arrays([0, y.size], pa.array(np.ascontiguousarray(y).ravel()))], ["number", "y"])

    first, second = blocks.columns
    return blocks.select(F.struct(F.col(first)["_1"].cast("bigint").alias("row"), F.col(first)["_2"].cast("bigint").alias("column")).alias("at"), second).mapInArrow(run, "number bigint, y array<double>")


def project(stored: Stored, fitted: Fitted) -> DataFrame:
    """vec_ids, x and y (row after row) of every block, stored in the shared folder."""
    spark = stored.frame.sparkSession
    columns, k = math.isqrt(max(1, stored.blocks - 1)) + 1, fitted.matrix.shape[1]
    flat = fitted.matrix.ravel().tolist()
    diagonal = spark.createDataFrame([((c, c), DenseMatrix(stored.length, k, flat, True)) for c in range(columns)], StructType([_BLOCK["at"], _BLOCK["block"]]))
    right = BlockMatrix(callMLlibFunc("createBlockMatrix", diagonal, stored.length, k, columns * stored.length, columns * k), stored.length, k)
    product = _matrix(stored, columns).multiply(right)
    blocks = _projected(callMLlibFunc("getMatrixBlocks", product._java_matrix_wrapper._java_model), columns, k)
    firsts = spark.createDataFrame(list(stored.first.items()), "part bigint, first bigint")
    rows = stored.frame.join(firsts, "part").select((F.col("first") + F.col("k")).alias("number"), "vec_ids", "x")
    at = stored_path(spark, "whitened")
    rows.join(blocks, "number").select("vec_ids", "x", "y").write.parquet(at)
    return spark.read.parquet(at)


def _sums(k: int, mean: np.ndarray | None):
    """Of y: its column sums, or the sums of products of its centred columns; a task's are one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k if mean is None else (k, k))
        for batch in batches:
            for y in batch.column(0):
                rows = y.values.to_numpy(zero_copy_only=False).reshape(-1, k)
                total += rows.sum(axis=0) if mean is None else (rows - mean).T @ (rows - mean)
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, total.size], pa.array(total.ravel()))], ["s"])

    return run


def identity_error(projected: DataFrame, n: int, k: int) -> float:
    """The largest entry, in size, of the covariance of y less the identity."""
    # The rows that fill a block up are left out.
    y = projected.select(F.slice("y", F.lit(1), F.size("vec_ids") * k).alias("y"))

    def summed(mean: np.ndarray | None) -> np.ndarray:
        rows = y.mapInArrow(_sums(k, mean), "s array<double>").select(F.posexplode("s").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
        return np.array([r["s"] for r in rows]) / n

    return float(np.abs(summed(summed(None)).reshape(k, k) - np.eye(k)).max())


def _rows(n: int, sums: np.ndarray, explained: np.ndarray, error: float, most: int = 4096):
    k, length = len(explained), len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, y = batch.column(0)[i].values, batch.column(2)[i].values.to_numpy(zero_copy_only=False).reshape(-1, k)
                apart = _deviations(batch.column(1)[i].values.to_numpy(zero_copy_only=False).reshape(-1, length), n, sums)
                if float(np.square(apart.astype(float)).sum(axis=1).max()) >= 2.0**63:
                    raise OverflowError("a deviation is beyond a long")
                deviation = np.square(apart).sum(axis=1)
                for lo in range(0, len(ids), most):
                    m = min(most, len(ids) - lo)
                    each = np.repeat(np.arange(lo, lo + m), k)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array(deviation[each]), pa.array(y[lo : lo + m].ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                        ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                    )

    return run


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    stored = store(vectors)
    fitted = fit(stored, components) if stored else None
    if not stored or not len(fitted.explained):
        return vectors.sparkSession.createDataFrame([], schema)
    projected = project(stored, fitted)
    error = identity_error(projected, stored.n, len(fitted.explained))
    return projected.mapInArrow(_rows(stored.n, stored.sums, fitted.explained, error), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
