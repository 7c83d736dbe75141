"""Whitening of embeddings by a matrix-free block subspace iteration.

A vector's entries c become whole numbers x = floor(256 c).  The model is fitted
on each distinct x vector once: n of them, with sums S.  No covariance matrix is
ever formed: a pass of Spark over the centred rows multiplies a block of columns,

    Q -> X'(XQ) / n,

in numpy within the tasks, and sums the tasks' blocks by a shuffle, so that the driver
sees one block (dimension times ``BLOCK`` doubles) however many rows there are.
The driver orthonormalises (QR) and takes the Rayleigh-Ritz values of the subspace.  The
subspace keeps the blocks of earlier passes, up to ``KEEP`` columns: spectra of
embeddings are flat, and from a single block they would take hundreds of passes.  The residuals of the
leading Ritz vectors are the next block.  It ends when the residuals certify all k
components: that of each is at the level of rounding, or small against the gap
to the nearest other value, which bounds the error of the vector.

Every pass reads a table written to the shared folder; a lost executor costs
its tasks of one pass.

Defined cases: rows whose vector is null, or holds null or non-finite entries,
go, as do empty vectors and those whose length is not that of most rows (ties:
the longer); a number beyond the range of a long stays at its end; repeated rows are fitted
once and all returned; components whose variance is zero (to rounding) are left
out, so few distinct or flat rows give fewer than k, and a table without rows, or with one
distinct vector, gives none; a deviation beyond a long is null; among equal
eigenvalues any orthonormal basis serves; extra columns pass through, and a
column named as a result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

from contentlens.llm.common import free, materialise

SCALE = 256
#: Columns of a pass's block at least (twice the components otherwise); columns that the subspace holds at most, beside the block to come.
BLOCK, KEEP = 16, 192
PASSES = 400
#: A residual is at the level of rounding below this share of the largest value; a vector's error bound must be below the other.
ROUNDING, VECTOR_ERROR = 1e-13, 1e-10
_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Model:
    """n distinct vectors, their exact sums, unit eigenvectors (rows) and eigenvalues by falling value, trace and residual norms."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    trace: float
    residuals: np.ndarray
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def sound(vector: Column) -> Column:
    """Whether a vector has entries, all of them finite."""
    v = vector.cast("array<double>")
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def codes(vector: Column) -> Column:
    """floor(256 c) of every entry, as longs."""
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(c * SCALE))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length, none null."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _sums(fit: DataFrame) -> list[int]:
    """The exact sum of each dimension, added as halves of 32 bits so that no batch overflows."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0))
                high, low = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)
                now = [(int(h) << 32) + int(s) for h, s in zip(high, low)]
                total = now if total is None else [a + c for a, c in zip(total, now)]
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array(map(Decimal, total), pa.decimal128(38, 0))], ["j", "s"]
            )

    rows = fit.select("x").mapInArrow(part, "j int, s decimal(38,0)").groupBy("j").agg(F.sum("s").cast("decimal(38,0)").alias("s"))
    return [int(r.s) for r in sorted(rows.collect(), key=lambda r: r.j)]  # as many rows as dimensions


def _summed(rows: DataFrame, width: int, height: int) -> np.ndarray:
    """Adds up the blocks (j, y) of all tasks: a matrix of ``height`` rows."""
    out = np.zeros((height, width))
    for r in rows.groupBy("j").agg(F.array(*[F.sum(F.get("y", F.lit(i))) for i in range(width)]).alias("y")).collect():
        out[r.j] = r.y
    return out


def _emit(block: np.ndarray) -> pa.RecordBatch:
    y = pa.ListArray.from_arrays(np.arange(len(block) + 1, dtype=np.int32) * block.shape[1], pa.array(block.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(block), dtype=np.int32)), y], ["j", "y"])


def _pass(fit: DataFrame, mean: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The sums over all rows of (x - mean)'((x - mean) q), with those of |x - mean|^2 as one more row."""
    shared = fit.sparkSession.sparkContext.broadcast((mean, q))  # dimension times block

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, q = shared.value
        total = np.zeros((len(mean) + 1, q.shape[1]))
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0)) - mean
                total[:-1] += x.T @ (x @ q)
                total[-1] += np.einsum("ij,ij->", x, x)
        yield _emit(total)

    return _summed(fit.select("x").mapInArrow(part, "j int, y array<double>"), q.shape[1], len(mean) + 1)


def _orthonormal(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """An orthonormal block for what block adds to an orthonormal basis; directions that add nothing are left out."""
    room = basis.shape[0] - basis.shape[1]
    norms = np.linalg.norm(block, axis=0)
    block = block[:, norms > 0] / norms[norms > 0]
    for _ in range(3):  # again, against rounding
        block = block - basis @ (basis.T @ block)
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-8 * max(s.max(initial=0.0), 1e-300)][:, :room]
    return np.linalg.qr(block)[0]


def _certified(values: np.ndarray, residuals: np.ndarray, k: int) -> bool:
    """Whether the first k residuals are those of rounding, or bound the error of their vectors."""
    top = max(values[0], 0.0)
    for i in range(k):
        gap = min((abs(values[i] - v) for j, v in enumerate(values) if j != i), default=top)
        if residuals[i] > ROUNDING * top and residuals[i] > VECTOR_ERROR * gap:
            return False
    return True


def fit(vectors: DataFrame, k: int = 4, vector: str = "embedding", block: int | None = None, passes: int = PASSES, seed: int = 0) -> Model:
    """The k leading components of the distinct code vectors."""
    return _fit(distinct_codes(vectors, vector), k, block, passes, seed)


def most_common_length(vectors: DataFrame, vector: str = "embedding") -> int:
    sizes = vectors.where(sound(F.col(vector))).groupBy(F.size(vector).alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    top = sizes.orderBy(F.desc("n"), F.desc("dim")).first()
    return top.dim if top else 0


def distinct_codes(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """x, each distinct code vector of the common length once, written to the shared folder."""
    rows = vectors.where(sound(F.col(vector)) & (F.size(vector) == most_common_length(vectors, vector)))
    return materialise(rows.select(codes(F.col(vector)).alias("x")).distinct())


def _fit(rows: DataFrame, k: int, block: int | None, passes: int, seed: int) -> Model:
    n, sums = rows.count(), _sums(rows)
    d = len(sums)
    mean = np.array([s / n for s in sums])
    if not n or not d:
        return Model(n, tuple(sums), np.zeros((0, d)), np.zeros(0), 0.0, np.zeros(0), 0)
    width = min(d, block or max(BLOCK, 2 * k))
    keep = max(KEEP, 4 * width)
    basis = images = np.zeros((d, 0))
    new = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0]
    for done in range(1, passes + 1):
        got = _pass(rows, mean, new) / n
        trace = float(got[-1, 0])
        basis, images = np.hstack([basis, new]), np.hstack([images, got[:-1]])
        ritz = basis.T @ images
        values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        lead = min(width, len(values))
        q, off = basis @ turn[:, :lead], images @ turn[:, :lead]
        off = off - q * values[:lead]
        norms = np.linalg.norm(off, axis=0)
        many = min(k, lead)
        if _certified(values, norms, many):
            break
        if basis.shape[1] + width > keep:  # start anew from the leading half
            turn = turn[:, : keep // 2]
            basis, images = basis @ turn, images @ turn
        new = _orthonormal(off, basis)
        if not new.shape[1]:
            break  # the subspace holds all that rows span: what is left of the residuals is rounding
    else:
        raise RuntimeError("the residuals did not certify the components")
    real = [i for i in range(many) if values[i] > max(len(mean), 16) * np.finfo(float).eps * values[0]]
    return Model(n, tuple(sums), q[:, real].T, values[real], trace, norms[real], done)


def project(x: np.ndarray, model: Model) -> np.ndarray:
    """Whitened rows: centred codes on each component, over the root of its value."""
    return (x - model.mean) @ model.components.T / np.sqrt(model.values)


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Exact sums over the dimensions of (n x - S)^2; null beyond a long."""
    if not len(x):
        return []
    most = n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, sums))
    if most * most * x.shape[1] <= _LONG:
        off = n * x - np.array(sums, np.int64)
        return (off * off).sum(1).tolist()
    exact = (sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist())
    return [v if v <= _LONG else None for v in exact]


def whiten(vectors: DataFrame, model: Model, vector: str = "embedding", out: str = "whitened", deviation: str = "deviation") -> DataFrame:
    """Rows with a sound vector of the model's length; adds the whitened vector and the deviation."""
    x = free(vectors, "__x")
    rows = vectors.drop(out, deviation).where(sound(F.col(vector)) & (F.size(vector) == len(model.sums))).withColumn(x, codes(F.col(vector)))
    kept = [f for f in rows.schema.fields if f.name != x]
    schema = StructType(kept).add(out, ArrayType(DoubleType())).add(deviation, LongType())
    shared = vectors.sparkSession.sparkContext.broadcast(model)  # k times dimension

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            codes = _matrix(b.column(b.num_columns - 1))
            white = project(codes, m)
            lists = pa.ListArray.from_arrays(np.arange(len(white) + 1, dtype=np.int32) * white.shape[1], pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], lists, pa.array(deviations(codes, m.n, m.sums), pa.int64())], [*b.schema.names[:-1], out, deviation]
            )

    return rows.mapInArrow(part, schema)


def identity_error(rows: DataFrame, model: Model) -> float:
    """The largest absolute entry of the covariance of the whitened fit list minus the identity; 0 without components."""
    k = len(model.values)
    if not k:
        return 0.0
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, total = shared.value, np.zeros((k, k))
        for b in batches:
            if b.num_rows:
                white = project(_matrix(b.column(0)), m)
                total += white.T @ white
        yield _emit(total)

    got = _summed(rows.select("x").mapInArrow(part, "j int, y array<double>"), k, k)
    return float(np.abs(got / model.n - np.eye(k)).max())


def whitened(vectors: DataFrame, k: int = 4, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """A row for each remaining row and component: id, component, n, deviation, whitened, explained, identity_error."""
    rows = distinct_codes(vectors, vector)
    model = _fit(rows, k, None, PASSES, 0)
    error = identity_error(rows, model)
    share = F.array(*[F.lit(float(v / model.trace)) for v in model.values]).cast("array<double>")
    out = whiten(vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v")), model, "v")
    out = out.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
