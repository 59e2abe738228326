"""Embedding whitening: the leading principal components by matrix-free block Lanczos, and every vector in them.

Components become whole numbers x. The fit list is every distinct x once: n vectors whose sums by dimension are S. Their
covariance V is never made. A step sends a block of directions Q to the tasks, each of which multiplies its centred
vectors twice, X'(XQ), and the summed products are the next block. On the driver, which holds directions and products
(dimensions x basis, whatever the number of rows), a block is orthogonalised against all earlier ones, twice; where it
breaks down, because what is left of a direction is nothing, the search restarts there with a random direction that is
orthogonal to all. It ends when the residuals |Vq - eq| of the wanted eigenpairs, taken from the products themselves,
are below a share of the largest eigenvalue, or when the basis spans the whole space. The trace comes from the
deviations of the vectors, so explained shares need no other eigenvalues.

Defined cases: a vector that is null or holds null or non-finite components gets no row. A shorter vector is filled up
with zeros to the longest one's length. x is at most LARGEST from OFFSET. Components without variance (fewer distinct
vectors than components, or dimensions that depend on each other) have no whitened value and get no row; a table whose
vectors are all equal, or that is empty, has no rows. A deviation that exceeds a long is null. Rows that repeat an id or
a vector get their rows each, a null id too. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm.common import checkpointed, table
from tallyline.llm.vectors import dimensions, finite, floored

FACTOR, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Whole numbers go as far as this from the offset, which 32 bits hold.
LARGEST = (1 << 31) - 1
#: Directions in a block; residuals, as a share of the largest eigenvalue, at which the search ends; what is left of a
#: direction, as a share of it, below which it breaks down; eigenvalues below this share of the largest one are zero.
BLOCK, RESIDUAL, BREAKDOWN, ZERO = 16, 1e-13, 1e-14, 1e-12


@dataclass
class Whitening:
    n: int
    sums: np.ndarray
    values: np.ndarray  # falling
    vectors: np.ndarray  # a column for each value
    explained: np.ndarray
    passes: int


def whole(rows: DataFrame, vector: str, width: int, factor: int = FACTOR) -> DataFrame:
    """(x): each vector's whole numbers without the offset, 32 bits each, as one binary value."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = floored(batch.column(0), width, factor, LARGEST).astype("<i4")
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], names=["x"])

    return rows.select(vector).mapInArrow(run, "x binary")


def numbers(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype="<i4").astype(np.int64).reshape(-1, width)


def summed(fit: DataFrame, width: int, columns: int, product, kind: str) -> np.ndarray:
    """The sum of product(x) over all blocks x of vectors; it has width x columns numbers. Tasks send one row a dimension."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = product(numbers(batch, width))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int64()), *map(pa.array, total.T)], names=["i", *(f"c{k}" for k in range(columns))])

    names = [f"c{k}" for k in range(columns)]
    rows = fit.mapInArrow(run, ", ".join(["i long", *(f"{c} {kind}" for c in names)])).groupBy("i").agg(*[F.sum(c).alias(c) for c in names])
    found = sorted(rows.collect(), key=lambda r: r["i"])  # a row for each dimension
    return np.array([r[1:] for r in found])


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """Exactly sum((n * x - sums)^2) of each row; in Python's whole numbers if 64 bits might not hold it."""
    far = max((int(np.abs(x).max(initial=0))) * n + int(np.abs(sums).max(initial=0)), 1)
    if far * far * x.shape[1] < 1 << 63:
        return ((n * x - sums) ** 2).sum(axis=1).tolist()
    return [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]


def orthonormal(block: np.ndarray, basis: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Orthonormal columns that are orthogonal to the basis, from the block's; a column of which nothing is left is
    replaced by a random one. There are fewer columns where the space ends."""
    for v in block.T:
        if basis.shape[1] == len(block):
            break
        size = np.linalg.norm(v)
        for _ in range(20):
            left = v / size if size else v
            for _ in range(2):
                left = left - basis @ (basis.T @ left)
            if (rest := np.linalg.norm(left)) > BREAKDOWN:
                for _ in range(2):  # what was left may be little, so rounding left it less orthogonal
                    left = left / np.linalg.norm(left)
                    left = left - basis @ (basis.T @ left)
                basis = np.column_stack([basis, left / np.linalg.norm(left)])
                break
            v = random.standard_normal(len(v))  # breakdown: go on elsewhere
            size = np.linalg.norm(v)
    return basis


def lanczos(times, width: int, wanted: int, block: int = BLOCK, residual: float = RESIDUAL, seed: int = 42) -> tuple[np.ndarray, np.ndarray, int]:
    """The largest `wanted` eigenvalues of a symmetric operator, their vectors and the number of passes.

    times(Q) is the operator applied to the columns of Q, in one pass. A block has at least `wanted` directions: a narrower
    one could converge without having met an eigenvalue as often as it occurs.
    """
    block = max(block, wanted)
    random = np.random.default_rng(seed)
    basis, images, passes = np.zeros((width, 0)), np.zeros((width, 0)), 0
    following = random.standard_normal((width, min(block, width)))
    while True:
        done = images.shape[1]
        basis = orthonormal(following, basis, random)
        images = np.column_stack([images, times(basis[:, done:])])
        passes += 1
        small = basis.T @ images
        values, s = np.linalg.eigh((small + small.T) / 2)
        top = np.argsort(-values)[:wanted]
        values, s = values[top], s[:, top]
        vectors = basis @ s
        rest = np.linalg.norm(images @ s - vectors * values, axis=0)
        if basis.shape[1] == width or len(values) == wanted and rest.max() <= residual * max(values[0], 0):
            return values, vectors / np.linalg.norm(vectors, axis=0), passes
        following = images[:, done:]


def fitted(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS, factor: int = FACTOR, block: int = BLOCK) -> tuple[DataFrame, Whitening] | None:
    """The fit list (x), written once, and the whitening of rows whose vectors are finite; None if there is nothing to whiten.

    Equal vectors are met within tasks before they are shuffled, so a vector that many rows share is no hot key.
    """
    width = dimensions(rows, vector)
    if not width:
        return None
    fit = checkpointed(whole(rows, vector, width, factor).distinct())
    first = summed(fit, width, 2, lambda x: np.stack([x.sum(axis=0), np.full(width, len(x))], axis=1), "long")
    n, sums = int(first[0, 1]), first[:, 0]

    def centred(x: np.ndarray) -> np.ndarray:
        return (n * x - sums) / n  # exact before the division

    trace = summed(fit, width, 1, lambda x: np.full((width, 1), math.fsum(deviations(x, n, sums))), "double")[0, 0] / n**3

    def times(q: np.ndarray) -> np.ndarray:
        def product(x: np.ndarray) -> np.ndarray:
            c = centred(x)
            return c.T @ (c @ q)

        return summed(fit, width, q.shape[1], product, "double") / n

    values, vectors, passes = lanczos(times, width, min(components, width), min(block, width))
    some = values > ZERO * max(values[0], 0)
    if not some.any():
        return None
    return fit, Whitening(n, sums, values[some], vectors[:, some], values[some] / trace, passes)


def whitened(x: np.ndarray, w: Whitening) -> np.ndarray:
    return ((w.n * x - w.sums) / w.n) @ w.vectors / np.sqrt(w.values)


def identity_error(fit: DataFrame, w: Whitening) -> float:
    """How far the covariance of the whitened fit list is from the identity, at most, over its entries."""

    def product(x: np.ndarray) -> np.ndarray:
        y = whitened(x, w)
        return np.pad(y.T @ y, ((0, len(w.sums) - y.shape[1]), (0, 0)))

    k = len(w.values)
    return float(np.abs(summed(fit, len(w.sums), k, product, "double")[:k] / w.n - np.eye(k)).max())


def projected(rows: DataFrame, w: Whitening, vector: str = "embedding", vec_id: str = "vec_id", factor: int = FACTOR) -> DataFrame:
    """(vec_id, deviation, whitened): for each row an array of as many numbers as there are components."""
    width = len(w.sums)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = floored(batch.column(1), width, factor, LARGEST)
            deviation = [d if d < 1 << 63 else None for d in deviations(x, w.n, w.sums)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.int64()), pa.array(list(whitened(x, w)), pa.list_(pa.float64()))], names=["vec_id", "deviation", "whitened"])

    return rows.select(vec_id, vector).mapInArrow(run, f"vec_id {dict(rows.dtypes)[vec_id]}, deviation long, whitened array<double>")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = finite(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding")
    found = fitted(rows)
    if found is None:
        return spark.createDataFrame([], f"vec_id {dict(rows.dtypes)['vec_id']}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    fit, w = found
    explained = F.array(*map(F.lit, w.explained.tolist()))
    long = projected(rows, w).select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return long.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("k")).alias("explained"), F.lit(identity_error(fit, w)).alias("identity_error"))


QUERIES = {"op12_whitening": op12_whitening}

ORACLE_SQL: dict[str, str] = {}  # SQL has no eigenvectors; tests hold it against a full decomposition
