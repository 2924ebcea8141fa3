"""Whitened principal components of embeddings by distributed block matrices.

Rows are dealt into blocks, written once, and centred. The blocks form MLlib
block matrices of two layouts: a block of index k stands in column s = k mod q*q
of the one and in column t(s) of the other, where t swaps the two digits of s to
the base q. The product of the one, transposed, with the other then holds the
partial scatters in blocks (s, t(s)), one in every part of the grid by which
MLlib deals a product; plain columns would all lie on its diagonal, or in its
first column, and so in few tasks. The sum of the partial scatters, as many
numbers as the square of the dimension, goes through a local eigendecomposition.
A product with a whitening matrix in each diagonal block projects all rows.

Entries become whole numbers x = floor(1024 * c) + 100000 first, so that sums
and deviations are exact.

Defined results: vectors that are null, empty or hold null or non-finite
entries are dropped, and so are those shorter than the longest, as they lack
entries; entries beyond 2**40 count as 2**40; a deviation that no long holds is
null; components without variance have no rows, so equal vectors give none;
repeated rows and rows without an id stay rows of their own; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.mllib.linalg import DenseMatrix, Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from . import blocks

BLOCK_ROWS = 1024
COMPONENTS = 8
SCALE, SHIFT, LARGEST = 1024, 100_000, 1 << 40

RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): rows of finite vectors as whole numbers."""
    c = F.col("embedding").cast("array<double>")
    finite = F.forall(c, lambda v: F.coalesce((v > -math.inf) & (v < math.inf), F.lit(False)))
    whole = F.transform(c, lambda v: F.floor(F.greatest(F.least(v * SCALE, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))) + SHIFT)
    return vectors.where(F.size("embedding") > 0).where(finite).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x"))


def _matrix(x: pa.Array) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = None, 0
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column(1))
            total, n = x.sum(0) + (0 if total is None else total), n + len(x)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total), pa.array([n] * len(total), pa.int64())], ["dim", "total", "n"])


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sums over dimensions of (n * x - S)**2; whole numbers of any size where 64 bits might not do."""
    widest = max(int(x.max()), -int(x.min())) * n + max(abs(int(s)) for s in sums)
    if widest >= 1 << 62:
        away = x.astype(object) * n - sums
    else:
        away = x * np.int64(n) - sums.astype(np.int64)
        if int(np.abs(away).max()) ** 2 * x.shape[1] < 1 << 63:
            return (away * away).sum(1).tolist()
        away = away.astype(object)
    return [v if v < 1 << 63 else None for v in (away * away).sum(1)]


def _gather(n: int, sums: np.ndarray, rows: int):
    """A function that turns rows (vec_id, x) into blocks (part, seq, ids, deviation, centred); `centred` goes column by column, short blocks end in zeros."""
    mean = np.array([int(s) / n for s in sums])

    def block(part: int, seq: int, ids: list, x: np.ndarray) -> pa.RecordBatch:
        centred = np.zeros((rows, x.shape[1]))
        centred[: len(x)] = x - mean
        columns = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([_deviations(x, n, sums)], pa.list_(pa.int64())), pa.array([centred.ravel("F")], pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(columns, ["part", "seq", "ids", "deviation", "centred"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, ids, held = TaskContext.get().partitionId(), 0, [], []
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, rows - len(ids))
                ids += piece.column(0).to_pylist()
                held.append(_matrix(piece.column(1)))
                at += piece.num_rows
                if len(ids) == rows:
                    yield block(part, seq, ids, np.concatenate(held))
                    seq, ids, held = seq + 1, [], []
        if ids:
            yield block(part, seq, ids, np.concatenate(held))

    return run


def _indexed(pieces: DataFrame) -> tuple[DataFrame, int]:
    """(k, ids, deviation, centred) with k from 0 without gaps, and how many; one number for each part goes through the driver."""
    sizes = pieces.groupBy("part").agg(F.count(F.lit(1)).alias("size")).orderBy("part").collect()
    before, total = [], 0
    for r in sizes:
        before.append((r.part, total))
        total += r["size"]
    starts = pieces.sparkSession.createDataFrame(before, "part int, before int")
    return pieces.join(F.broadcast(starts), "part").select((F.col("before") + F.col("seq")).alias("k"), "ids", "deviation", "centred"), total


def _layout(matrices, column, rows: int, dims: int, total: int, columns: int) -> BlockMatrix:
    """A block matrix with block k in block column `column(k mod columns)`."""
    return BlockMatrix(matrices.map(lambda r: ((r[0], column(r[0] % columns)), r[1])), rows, dims, rows * total, dims * columns)


def _scatter(spark: SparkSession, product: BlockMatrix, dims: int) -> np.ndarray:
    """Sum of all blocks of a product, entry by entry in tasks; a matrix of dims x dims comes back."""
    pieces = product.blocks.map(lambda b: (b[1].toArray().ravel().tolist(),))
    entries = spark.createDataFrame(pieces, "v array<double>").select(F.posexplode("v").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"))
    out = np.zeros(dims * dims)
    for r in entries.collect():  # dims x dims rows
        out[r["at"]] = r.v
    return out.reshape(dims, dims)


def eigen(covariance: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors as columns, of components that have variance; at most `most`."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    has = values > max(values[0], 0) * len(values) * np.finfo(float).eps
    return values[has][:most], vectors[:, has][:, :most]


def whiten(vectors: DataFrame, components: int = COMPONENTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable row and component."""
    spark = vectors.sparkSession
    tables = blocks.Tables(spark)
    nothing = spark.createDataFrame([], RESULT)
    rows = usable(vectors)
    longest = rows.agg(F.max(F.size("x")).alias("d")).first().d
    if not longest:
        return nothing
    rows = rows.where(F.size("x") == longest)
    sums = rows.mapInArrow(_partial_sums, "dim int, total long, n long").groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()  # a row for each dimension
    n, dims = sums[0].n, len(sums)
    total = np.zeros(dims, object)
    for r in sums:
        total[r.dim] = int(r.total)

    at_once = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(math.ceil(n / (0.9 * block_rows)), max(at_once, math.ceil(n / (64 * block_rows)))))
    pieces = tables.keep(rows.repartition(parts).mapInArrow(_gather(n, total, block_rows), "part int, seq int, ids array<long>, deviation array<long>, centred array<double>"), "pieces")
    indexed, n_blocks = _indexed(pieces)
    indexed = tables.keep(indexed, "blocks")

    matrices = indexed.select("k", "centred").rdd.map(lambda r: (r.k, DenseMatrix(block_rows, dims, r.centred)))
    q = max(1, math.isqrt(min(matrices.getNumPartitions(), n_blocks)))
    columns = q * q
    plain = _layout(matrices, lambda s: s, block_rows, dims, n_blocks, columns)
    swapped = _layout(matrices, lambda s: s % q * q + s // q, block_rows, dims, n_blocks, columns)
    plain.persist(StorageLevel.MEMORY_AND_DISK)
    covariance = _scatter(spark, plain.transpose().multiply(swapped), dims) / n
    values, axes = eigen(covariance, components)
    if not len(values):
        return nothing
    kept, whitening = len(values), axes / np.sqrt(values)
    weights = Matrices.dense(dims, kept, whitening.ravel("F"))
    diagonal = BlockMatrix(spark.sparkContext.parallelize([((s, s), weights) for s in range(columns)], columns), dims, kept, dims * columns, kept * columns)
    projected = plain.multiply(diagonal).blocks.map(lambda b: (b[0][0], b[1].toArray().tolist()))
    projected = tables.keep(spark.createDataFrame(projected, "k int, y array<array<double>>"), "projected")
    plain._java_matrix_wrapper.call("blocks").unpersist()

    both = indexed.select("k", "ids", "deviation").join(projected, "k")
    each = both.select(F.explode(F.arrays_zip("ids", "deviation", F.slice("y", F.lit(1), F.size("ids")).alias("y"))).alias("r")).select("r.*")
    each = tables.keep(each.select(F.col("ids").alias("vec_id"), "deviation", "y"), "rows")
    pairs = [(a, b) for a in range(kept) for b in range(a, kept)]
    found = each.agg(*[F.covar_pop(F.get("y", F.lit(a)), F.get("y", F.lit(b))).alias(f"c{a}_{b}") for a, b in pairs]).first()
    error = float(max(abs(found[f"c{a}_{b}"] - (a == b)) for a, b in pairs))
    shares = F.array(*[F.lit(float(v / np.trace(covariance))) for v in values])
    each = each.select("vec_id", "deviation", F.posexplode("y").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
