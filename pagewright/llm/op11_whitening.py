"""Whitening of embeddings by Chebyshev-filtered subspace iteration over distributed passes.

The covariance is never formed: a pass over blocks of centred rows gives its product with a narrow
matrix, sum of XᵀXQ. A polynomial recurrence of such passes damps the unwanted end of the spectrum,
QR makes the columns orthonormal again and Rayleigh-Ritz turns them into eigenvector estimates,
until the residuals certify them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, table

#: Columns that the iteration carries besides the wanted ones: they widen the gap that it works with.
GUARD = 24
#: Degree of the first filter; a round that gains too little doubles it.
DEGREE = 10
#: Residual, relative to the largest eigenvalue, below which a component is certified, and below which one more round that gains nothing ends the search.
TOLERANCE, STALLED = 1e-13, 1e-11
#: Passes over the data after which the search gives up with an error.
MOST_PASSES = 2_000
#: Eigenvalues below this share of the largest count as none.
RANK = 1e-12
#: Bytes of a block of rows.
BLOCK = 1 << 20
#: x = floor(SCALE * c) + SHIFT makes whole numbers of entries.
SCALE, SHIFT = 1024, 100_000


def blocks_of(vectors: DataFrame, id_col: str, vector_col: str, dims: int) -> DataFrame:
    """(ids, x, sums): blocks of up to 1 MB of the valid rows' whole numbers as int64, with their sums."""
    rows = max(1, BLOCK // (8 * max(dims, 1)))
    kind = vectors.schema[id_col].dataType

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                c = part["vector"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, dims)
                if np.abs(c).max() >= 1 << 50:
                    raise ValueError("entries must be below 2^50")
                x = np.floor(SCALE * c).astype(np.int64) + SHIFT
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part["id"])
                yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes()], pa.binary()), pa.array([x.sum(axis=0).tolist()], pa.list_(pa.int64()))], ["ids", "x", "sums"])

    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    valid = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).filter(F.col("vector").isNotNull() & (F.size("vector") == dims) & finite)
    return valid.mapInArrow(pack, f"ids array<{kind.simpleString()}>, x binary, sums array<long>")


def usual_length(vectors: DataFrame, vector_col: str) -> int:
    """The number of entries that most vectors have; the larger of equally frequent ones, 0 if there is none."""
    top = vectors.filter(F.size(vector_col) > 0).groupBy(F.size(vector_col).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return top["d"] if top else 0


def summed(blocks: DataFrame, dims: int, mean: np.ndarray, of: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum over blocks of of(centred rows), a matrix of the given small shape: a task adds its blocks up, Spark adds the tasks'."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for x in batch["x"]:
                total += of(np.frombuffer(x.as_buffer(), np.int64).reshape(-1, dims) - mean)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["cell", "value"])

    cells = blocks.select("x").mapInArrow(part, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros(shape[0] * shape[1])
    out[cells["cell"]] = cells["value"]
    return out.reshape(shape)


def chebyshev(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray, degree: int, low: float, cut: float, top: float) -> np.ndarray:
    """p(V)q for the polynomial that is small on [low, cut] and grows fastest beyond, scaled to 1 at `top`."""
    half, mid = (cut - low) / 2, (cut + low) / 2
    first = sigma = half / (top - mid)
    y = (times(q) - mid * q) * (sigma / half)
    for _ in range(degree - 1):
        new = 1 / (2 / first - sigma)
        q, y = y, 2 * (new / half) * (times(y) - mid * y) - sigma * new * q
        sigma = new
    return y


def leading(times: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(values, vectors, residual): the `wanted` leading eigenpairs of the operator, certified by their residuals.

    The residual of a unit vector bounds its value's distance from an eigenvalue. It is an error if
    MOST_PASSES passes don't certify all.
    """
    width, passes = min(dims, wanted + GUARD), 0

    def counted(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        if passes > MOST_PASSES:
            raise RuntimeError(f"{MOST_PASSES} passes don't certify {wanted} components")
        return times(q)

    def ritz(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q = np.linalg.qr(q)[0]
        vq = counted(q)
        theta, turn = np.linalg.eigh((q.T @ vq + vq.T @ q) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        return theta, q @ turn, np.linalg.norm(vq @ turn - (q @ turn) * theta, axis=0)

    theta, q, error = ritz(np.random.default_rng(11).standard_normal((dims, width)))
    # The lowest Ritz value less its residual is near or below the lowest eigenvalue.
    low, degree, before = max(0.0, theta[-1] - error[-1]), DEGREE, np.inf
    while True:
        live = wanted if theta[0] <= 0 else max(1, int((theta[:wanted] > RANK * theta[0]).sum()))
        worst = float(error[:live].max() / theta[0]) if theta[0] > 0 else 0.0
        if worst <= TOLERANCE or (worst <= STALLED and worst > before / 2) or width == dims:
            return theta[:wanted], q[:, :wanted], worst
        if worst > before / 100:
            degree *= 2
        before, cut = worst, float(theta[-1])
        low = min(low, max(0.0, cut - error[-1]))
        if cut - low < RANK * theta[0]:  # the data have no more than `width` dimensions
            low = cut - RANK * theta[0]
        theta, q, error = ritz(chebyshev(counted, q, degree, low, cut, float(theta[0])))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8) -> DataFrame:
    """Project each vector on the leading components of all, scaled to unit variance.

    Returns (id, component, n, deviation, whitened, explained, identity_error), a row for each valid
    vector and component. Vectors that are null or hold a null, NaN or infinite entry are left out,
    as are vectors of another length than most have and empty ones. Entries c count as
    x = floor(1024 c) + 100000, so |c| must be below 2^50; larger ones raise an error. `deviation`, decimal(38, 0), is the sum of
    the squares of n x - S, exactly. Components whose eigenvalue is none (as of equal or few vectors)
    are left out too, so a table of one vector gives no rows; equal eigenvalues have some orthonormal
    components. Null and repeated ids are rows of their own; other columns don't enter.
    """
    dims = usual_length(vectors, vector_col)
    spark, kind = vectors.sparkSession, vectors.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not dims:
        return spark.createDataFrame([], schema)
    blocks = keep(blocks_of(vectors, id_col, vector_col, dims), "whiten-blocks")
    n = blocks.agg(F.sum(F.size("ids"))).first()[0] or 0
    if not n:
        return spark.createDataFrame([], schema)
    by_dim = blocks.select(F.posexplode("sums").alias("d", "s")).groupBy("d").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("d").collect()
    sums = [int(r["s"]) for r in by_dim]
    mean = np.array([s / n for s in sums])
    trace = float(summed(blocks, dims, mean, lambda x: np.array([[np.einsum("ij,ij->", x, x)]]), (1, 1))[0, 0]) / n
    if trace <= 0:
        return spark.createDataFrame([], schema)

    def times(q: np.ndarray) -> np.ndarray:
        return summed(blocks, dims, mean, lambda x: x.T @ (x @ q), q.shape) / n

    values, basis, _ = leading(times, dims, min(components, dims))
    real = values > RANK * values[0]
    values, basis = values[real], basis[:, real]
    scaled, k = basis / np.sqrt(values), len(values)
    ones = summed(blocks, dims, mean, lambda x: np.ones((1, len(x))) @ (x @ scaled), (1, k)) / n
    again = summed(blocks, dims, mean, lambda x: (x @ scaled - ones).T @ (x @ scaled - ones), (k, k)) / n
    off, explained = float(np.abs(again - np.eye(k)).max()), values / trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, block in zip(batch["ids"], batch["x"], strict=True):
                x = np.frombuffer(block.as_buffer(), np.int64).reshape(-1, dims)
                m = len(x)
                repeat = lambda a: np.repeat(a, k)
                cols = [ids.values.take(pa.array(repeat(np.arange(m)))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), deviations(x, n, sums).take(pa.array(repeat(np.arange(m)))), pa.array(((x - mean) @ scaled).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, off))]
                yield pa.RecordBatch.from_arrays(cols, [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return blocks.select("ids", "x").mapInArrow(project, schema)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """The sum over dimensions of (n x - S)^2 of each row: in int64 where it fits, else in Python's whole numbers."""
    reach = max(n * max(abs(int(x[:, j].min())), abs(int(x[:, j].max()))) + abs(s) for j, s in enumerate(sums))
    if reach < 1 << 62:
        far = n * x - np.array(sums, np.int64)
        if int(np.abs(far).max()) ** 2 * x.shape[1] < 1 << 63:
            return pa.array(np.einsum("ij,ij->i", far, far)).cast(pa.decimal128(38, 0))
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    return pa.array([Decimal(v) for v in exact], pa.decimal128(38, 0))


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on their 8 leading components; a deviation beyond a long is null."""
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
