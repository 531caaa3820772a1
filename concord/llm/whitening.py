"""Embedding whitening by QDWH spectral divide and conquer.

Entries become integers, floor(1024 * c) + 100000, so their sums are exact.  One pass over the vectors sums
each dimension, a second one accumulates the covariance of the centred vectors as one partial matrix per task,
summed in Spark.  The covariance (dimension x dimension, whatever the number of rows) is split on the
driver: the polar factor of V - shift * I, by QR-based dynamically weighted Halley iterations, is the matrix sign,
which gives the projector on the invariant subspace of the eigenvalues above the shift; V restricted to that
subspace and to its complement is split again, until single components are left.  Only subspaces that hold wanted
components are followed.  The components are broadcast, and a third pass projects and scales every vector.

Defined results: rows with a null vector or with a null or non-finite entry are dropped; vectors of another length than
the most frequent one (the longest of those, at a tie) are dropped too, as they have no place in the covariance; null and
repeated ids are kept, repeated rows count each; entries beyond 2**52 stay there; components without variance
(eigenvalue below 1e-13 of the trace) cannot be scaled to 1 and are left out, so equal vectors, a single
vector and an empty table give no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import discard, materialise, prepare

SCALE, SHIFT = 1024, 100_000
LARGEST = 2.0 ** 52  # entries beyond are set to it, so that integers stay exact
#: components below this part of the trace have no variance to speak of
NO_VARIANCE = 1e-13
SLICE_ROWS = 4096
#: partial matrices are first summed over so many groups of tasks
GROUPS = 64


# --- spectral divide and conquer of a symmetric matrix ---------------------------------

def polar_factor(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix without zero eigenvalues (its matrix sign),
    by QR-based dynamically weighted Halley iterations."""
    n = len(a)
    eps = np.finfo(float).eps
    x = a / np.abs(a).sum(axis=1).max()  # the row-sum norm bounds the spectral norm
    try:
        low = 1.0 / np.abs(np.linalg.inv(x)).sum(axis=1).max()  # below the smallest singular value
    except np.linalg.LinAlgError:
        low = eps
    low = min(max(low, eps), 1.0)
    for _ in range(60):
        sq = low * low
        d = np.cbrt(4 * (1 - sq) / (sq * sq))
        root = np.sqrt(1 + d)
        wa = root + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - sq) / (sq * root), 0.0))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(n)]))[0]
        new = (wb / wc) * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        x = new
        low = min(low * (wa + wb * sq) / (1 + wc * sq), 1.0)
        if abs(low - 1) < 10 * eps and moved < np.cbrt(5 * eps):
            return x
    return x


def split(a: np.ndarray, shift: float) -> tuple[np.ndarray, int]:
    """(basis, k): an orthonormal basis whose first k vectors span the invariant subspace of the
    eigenvalues above ``shift``."""
    n = len(a)
    projector = (polar_factor(a - shift * np.eye(n)) + np.eye(n)) / 2
    k = int(round(float(np.trace(projector))))
    if not 0 < k < n:
        return np.eye(n), k
    rng = np.random.Generator(np.random.Philox(key=n))
    basis = np.linalg.qr(projector @ rng.standard_normal((n, k)))[0]
    for _ in range(2):  # one step of subspace iteration settles it, the second costs little
        basis = np.linalg.qr(projector @ basis)[0]
    return np.linalg.qr(basis, mode="complete")[0], k


def leading_components(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of the ``wanted`` largest eigenvalues of a
    symmetric matrix, falling."""
    scale = float(np.abs(v).max()) if v.size else 0.0
    values, vectors = [], []

    def descend(a: np.ndarray, basis: np.ndarray) -> None:
        n = len(a)
        if not n or len(values) >= wanted:
            return
        rest = a - np.diag(np.diag(a))
        if n == 1 or np.abs(rest).max() <= 4 * np.finfo(float).eps * scale:
            for k in np.argsort(-np.diag(a), kind="stable"):
                values.append(float(a[k, k]))
                vectors.append(basis[:, k])
            return
        diagonal = np.sort(np.diag(a))
        for shift in (float(np.trace(a)) / n, float(np.median(diagonal)), float(diagonal[-1] + diagonal[0]) / 2,
                      *(float(x) for x in np.linspace(*_gershgorin(a), 18)[1:-1])):
            full, k = split(a, shift)
            if 0 < k < n:
                break
        else:  # eigenvalues that no shift tells apart: any basis of their subspace is one of eigenvectors
            descend(np.diag(np.diag(a)), basis)
            return
        turned = full.T @ a @ full
        turned = (turned + turned.T) / 2
        descend(turned[:k, :k], basis @ full[:, :k])
        descend(turned[k:, k:], basis @ full[:, k:])

    descend((v + v.T) / 2, np.eye(len(v)))
    return np.array(values[:wanted]), np.array(vectors[:wanted]).reshape(-1, len(v)).T


def _gershgorin(a: np.ndarray) -> tuple[float, float]:
    radius = np.abs(a).sum(axis=1) - np.abs(np.diag(a))
    return float((np.diag(a) - radius).min()), float((np.diag(a) + radius).max())


# --- moments ---------------------------------------------------------------------------

def _slices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(slice of a batch, integer entries as int64 matrix)."""
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(lo, SLICE_ROWS)
            flat = part.column("vec").flatten().to_numpy(zero_copy_only=False)
            whole = np.clip(np.floor(flat * SCALE) + SHIFT, -LARGEST, LARGEST)
            yield part, whole.astype(np.int64).reshape(part.num_rows, dim)


def _exact(x: np.ndarray, n: int, sums: np.ndarray, high: int) -> np.ndarray:
    """n * x - S, as int64 where that holds every entry, else as Python integers."""
    if n * max(high, 1) + max(abs(int(s)) for s in sums) < 1 << 62:
        return x * n - sums.astype(np.int64)
    return x.astype(object) * n - sums


class Fit:
    """Sums of a fit list and its leading components."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float):
        self.n, self.sums, self.values, self.vectors, self.trace = n, sums, values, vectors, trace

    @property
    def dim(self) -> int:
        return len(self.sums)


def usable_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the rows whose vector holds finite values only."""
    vec = F.col(vec_col).cast("array<double>")
    fine = vec.isNotNull() & F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return df.where(fine).select(F.col(id_col).alias("id"), vec.alias("vec"))


def fit(vectors: DataFrame, components: int) -> Fit | None:
    """Components of all ``vectors`` (id, vec) of the most frequent length; None without any."""
    spark = vectors.sparkSession
    prepare(spark)
    dims = vectors.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    most = dims.agg(F.max(F.struct("n", "dim")).alias("m")).first()["m"]
    if most is None or not most["dim"]:
        return None
    n, dim = int(most["n"]), int(most["dim"])
    same = vectors.where(F.size("vec") == dim).select("vec")

    def total(batches):
        acc = np.zeros(dim, object)
        for _, x in _slices(batches, dim):
            acc += x.sum(axis=0) if np.abs(x).max() < 1 << 49 else x.astype(object).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([str(int(s)) for s in acc])], names=["i", "s"])

    parts = same.mapInArrow(total, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    sums = np.array([int(r["s"]) for r in sorted(parts, key=lambda r: r["i"])], object)

    def spread(batches):
        """One partial matrix per task, row by row."""
        from pyspark import TaskContext

        acc, seen = np.zeros((dim, dim)), False
        for _, x in _slices(batches, dim):
            centred = (_exact(x, n, sums, int(np.abs(x).max())) / n).astype(np.float64)
            acc += centred.T @ centred
            seen = True
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(dim), pa.int32()), pa.array(np.full(dim, TaskContext.get().partitionId() % GROUPS), pa.int32()),
                 pa.array([line.tobytes() for line in acc], pa.binary())], names=["i", "slot", "line"])

    def add(table: pa.Table) -> pa.Table:
        acc = np.zeros(dim)
        for line in table.column("line").to_pylist():
            acc += np.frombuffer(line)
        return pa.table({"i": table.column("i").slice(0, 1), "slot": table.column("slot").slice(0, 1), "line": pa.array([acc.tobytes()], pa.binary())})

    kind = "i int, slot int, line binary"
    lines = same.mapInArrow(spread, kind).groupBy("i", "slot").applyInArrow(add, kind).groupBy("i").applyInArrow(add, kind)
    v = np.array([np.frombuffer(r["line"]) for r in sorted(lines.select("i", "line").collect(), key=lambda r: r["i"])]) / n
    trace = float(np.trace(v))
    values, columns = leading_components(v, min(components, dim))
    held = values > NO_VARIANCE * trace
    return Fit(n, [int(s) for s in sums], values[held], columns[:, held], trace)


def whiten(vectors: DataFrame, model: Fit) -> DataFrame:
    """(id, deviation decimal, whitened array<double>) per vector: the exact sum of (n * x - S)^2,
    and the centred vector projected on the components and scaled to variance 1."""
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast((model.n, np.array(model.sums, object), model.vectors / np.sqrt(model.values)))
    kind = vectors.schema["id"].dataType.simpleString()
    dim = model.dim

    def project(batches):
        n, sums, scaled = shared.value
        for part, x in _slices(batches, dim):
            off = _exact(x, n, sums, int(np.abs(x).max()))
            low = off.dtype != object and float(np.abs(off).max()) ** 2 * dim < 1 << 62
            wide = off if low else off.astype(object)
            white = (off / n).astype(np.float64) @ scaled
            flat = pa.array(white.reshape(-1))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array([str(s) for s in (wide * wide).sum(axis=1)], pa.string()),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(white) + 1) * white.shape[1], pa.int32()), flat)], names=["id", "deviation", "whitened"])

    same = vectors.where(F.size("vec") == dim)
    out = same.mapInArrow(project, f"id {kind}, deviation string, whitened array<double>")
    # beyond 38 digits there is no exact column type
    return out.withColumn("deviation", F.expr("try_cast(deviation AS decimal(38,0))"))


def identity_error(white: DataFrame, components: int) -> float:
    """Largest absolute entry of the covariance of ``whitened`` (divisor n, centred) minus the identity."""
    if not components:
        return 0.0
    entry = [F.col("whitened")[k] for k in range(components)]
    errors = [F.abs(F.covar_pop(entry[i], entry[j]) - F.lit(float(i == j))) for i in range(components) for j in range(i + 1)]
    return float(white.agg(F.greatest(*errors, F.lit(0.0)).alias("e")).first()["e"] or 0.0)


def whitened_components(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 8) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) per vector and component."""
    vectors = usable_vectors(df, id_col, vec_col)
    model = fit(vectors, components)
    names = f"`{id_col}` {vectors.schema['id'].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return df.sparkSession.createDataFrame([], names)
    white = materialise(whiten(vectors, model))
    error = identity_error(white, len(model.values))
    explained = F.lit([float(e) / model.trace for e in model.values])
    return (white.select("id", "deviation", F.posexplode("whitened").alias("k", "w"))
            .select(F.col("id").alias(id_col), (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
                    F.col("w").alias("whitened"), F.element_at(explained, F.col("k") + 1).alias("explained"), F.lit(error).alias("identity_error")))
