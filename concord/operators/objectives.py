"""Block objectives, gradients, Newton Hessians and Hessian-vector products.

Each evaluates, for every block i, the augmented subproblem at w = x_i:

    f_i(w) + rho/2 ||w - z + y_i/rho||^2

from dense rows ``(block_id, label 0/1, features)`` or sparse ones ``(block_id, label, indices, values)`` and a
state table ``(block_id, x, y)``.

Rows are summed where they lie: a task stacks its rows by block (a matrix, or sparse rows
without a dense copy), evaluates the loss on each stack at the block's weights, and sends one record per block
that it met.  Records are as wide as the sum (loss and gradient: p + 2 values) and their number
does not depend on the rows, nor does the shuffle.  The weights reach the tasks as a broadcast
while all blocks' weights are below STATE_VALUES numbers; beyond, the stacked rows meet them block by block in a cogroup.
The proximal terms are joins of the small state and consensus tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.operators import solvers as S
from concord.operators.consensus import explode_state
from concord.session import ensure_importable

#: weights of all blocks up to which every task gets all of them (64 MB)
STATE_VALUES = 8_000_000
#: a task emits its sums before they hold more numbers than this (128 MB)
HELD_VALUES = 16_000_000

#: (rows of a block, labels 0/1, weights of the block) -> summands of a fixed length
Part = Callable[[object, np.ndarray, np.ndarray], np.ndarray]

_PARTIAL = "block_id int, s binary"
_SUMS = "block_id int, s array<double>"


def _records(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())],
                                      names=["block_id", "s"])


def _add(sums: dict[int, np.ndarray], block: int, values: np.ndarray) -> None:
    if block in sums:
        sums[block] += values
    else:
        sums[block] = np.array(values, dtype=np.float64)


def _stacks(batches: Iterator[pa.RecordBatch], kind: str, p: int):
    """(block, rows, labels) of the stacks of a task's rows."""
    for table in S.buffered(batches):
        packed = S.pack_rows(table, kind, p)
        for i in range(packed.num_rows):
            yield packed.column("block_id")[i].as_py(), *S.unpack_block(packed.slice(i, 1), kind, p)


def sum_partials(partials: DataFrame, parts: int) -> DataFrame:
    """(block_id, s) sums of partial records (block_id, s binary); a task adds them as they come."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, s in zip(batch.column("block_id").to_pylist(), batch.column("s").to_pylist()):
                _add(sums, block, np.frombuffer(s))
        for block, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), S.list_column(s)], names=["block_id", "s"])

    return partials.repartition(max(1, parts), "block_id").mapInArrow(add, _SUMS)


def block_sums(rows: DataFrame, state: DataFrame, part: Part, state_values: int = STATE_VALUES) -> DataFrame:
    """(block_id, s): ``part`` summed over the rows of every block that has a state."""
    spark = rows.sparkSession
    ensure_importable(spark)
    kind = S.features_kind(rows.columns)
    rows = rows.select(*S.row_columns(kind))
    at = state.select("block_id", "x")
    shape = at.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("p")).first()
    n, p = int(shape["n"]), int(shape["p"] or 0)
    if n * p <= state_values:
        weights = spark.sparkContext.broadcast({r["block_id"]: np.array(r["x"], dtype=np.float64) for r in at.collect()})

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            held = 0
            for block, X, y in _stacks(batches, kind, p):
                w = weights.value.get(block)
                if w is None:
                    continue
                values = part(X, y, w)
                held += 0 if block in sums else len(values)
                _add(sums, block, values)
                if held > HELD_VALUES:
                    yield _records(sums)
                    sums, held = {}, 0
            if sums:
                yield _records(sums)

        return sum_partials(rows.mapInArrow(partial, _PARTIAL), min(n, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))))

    def stack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in S.buffered(batches):
            yield S.pack_rows(table, kind, p)

    def meet(payload: pa.Table, own: pa.Table) -> pa.Table:
        if not payload.num_rows or not own.num_rows:
            return pa.table({"block_id": pa.array([], pa.int32()), "s": pa.array([], pa.list_(pa.float64()))})
        X, y = S.unpack_block(payload, kind, p)
        w = np.array(own.column("x")[0].as_py(), dtype=np.float64)
        return pa.table({"block_id": own.column("block_id").slice(0, 1), "s": S.list_column(part(X, y, w))})

    packed = rows.mapInArrow(stack, S.PACK_SCHEMA)
    own = at.select(F.col("block_id").alias("b"), F.col("x").alias("w")).select(F.col("b").alias("block_id"), F.col("w").alias("x"))
    return packed.groupBy("block_id").cogroup(own.groupBy("block_id")).applyInArrow(meet, _SUMS)


# ------------------------------------------------------------------ proximal terms


def _prox_long(state: DataFrame, z: DataFrame, rho: float) -> DataFrame:
    """(block_id, j, d = w_j - z_j + y_j / rho)."""
    return explode_state(state).join(z, "j").select(
        "block_id", "j", (F.col("x") - F.col("z") + F.col("y") / F.lit(rho)).alias("d"))


def _prox_value(state: DataFrame, z: DataFrame, rho: float) -> DataFrame:
    d = _prox_long(state, z, rho)
    return d.groupBy("block_id").agg((F.lit(rho / 2.0) * F.sum(F.col("d") * F.col("d"))).alias("prox"))


# ------------------------------------------------------------------ losses


def _logistic(X, y01: np.ndarray, w: np.ndarray) -> np.ndarray:
    f, g = S.logistic_sum(X, 2.0 * y01 - 1.0)(w)
    return np.concatenate([[f], g])


def _squared_hinge(cee: float) -> Part:
    def part(X, y01, w):
        f, g = S.squared_hinge_sum(X, 2.0 * y01 - 1.0, cee)(w)
        return np.concatenate([[f], g])

    return part


def _curvature(X, w: np.ndarray) -> np.ndarray:
    mu = S.sigmoid(S.as_operator(X).matvec(w))
    return mu * (1.0 - mu)


def _objective(rows: DataFrame, state: DataFrame, z: DataFrame, rho: float, part: Part) -> DataFrame:
    sums = block_sums(rows, state, part).select("block_id", F.element_at("s", 1).alias("loss"))
    return (sums.join(_prox_value(state, z, rho), "block_id")
                .select("block_id", (F.col("loss") + F.col("prox")).alias("objective")))


def _gradient(rows: DataFrame, state: DataFrame, z: DataFrame, rho: float, part: Part) -> DataFrame:
    sums = block_sums(rows, state, part).select("block_id", F.posexplode("s").alias("k", "g")).where("k > 0")
    g = sums.select("block_id", (F.col("k") - 1).alias("j"), "g")
    return (g.join(_prox_long(state, z, rho), ["block_id", "j"])
             .select("block_id", F.col("j").cast("int").alias("j"), (F.col("g") + F.lit(rho) * F.col("d")).alias("gradient")))


def lr_objective(rows: DataFrame, state: DataFrame, z: DataFrame, rho: float) -> DataFrame:
    """sum log(1 + exp(-y w.x)) + rho/2 ||w - z + y_i/rho||^2 per block (y in {-1,1})."""
    return _objective(rows, state, z, rho, _logistic)


def lr_gradient(rows: DataFrame, state: DataFrame, z: DataFrame, rho: float) -> DataFrame:
    """sum y (sigma(y w.x) - 1) x + rho (w - z + y_i/rho) per block and coordinate."""
    return _gradient(rows, state, z, rho, _logistic)


def svm_objective(rows: DataFrame, state: DataFrame, z: DataFrame, rho: float, cee: float) -> DataFrame:
    """C sum max(1 - y w.x, 0)^2 + rho/2 ||w - v||^2 with y in {-1,+1} (both terms)."""
    return _objective(rows, state, z, rho, _squared_hinge(cee))


def svm_gradient(rows: DataFrame, state: DataFrame, z: DataFrame, rho: float, cee: float) -> DataFrame:
    """2C sum_{1 - y w.x > 0} (w.x - y) x + rho (w - v)."""
    return _gradient(rows, state, z, rho, _squared_hinge(cee))


def lr_newton_hessian(rows: DataFrame, state: DataFrame, rho: float) -> DataFrame:
    """X^T W X / m + rho I per block at w = x_i, W = mu (1 - mu), mu = sigma(X w): p x p values per
    block, for narrow models; ``lr_hessian_product`` serves wide ones."""

    def part(X, y01, w):
        return np.concatenate([[len(y01)], S.gram_of(S.scaled_rows(X, np.sqrt(_curvature(X, w)))).ravel()])

    p = F.sqrt(F.size("s") - 1).cast("int")
    h = (block_sums(rows, state, part).select("block_id", F.element_at("s", 1).alias("m"), p.alias("p"), F.posexplode("s").alias("k", "v"))
         .where("k > 0").select("block_id", "m", "v", F.floor((F.col("k") - 1) / F.col("p")).cast("int").alias("r"), ((F.col("k") - 1) % F.col("p")).alias("c")))
    return h.select("block_id", "r", "c", (F.col("v") / F.col("m") + F.when(F.col("r") == F.col("c"), F.lit(rho)).otherwise(F.lit(0.0))).alias("h"))


def lr_hessian_product(rows: DataFrame, state: DataFrame, direction: np.ndarray, rho: float) -> DataFrame:
    """(block_id, j, hd): H_i d = X^T W X d / m + rho d per block at w = x_i, without a p x p matrix."""
    d = np.asarray(direction, dtype=np.float64)

    def part(X, y01, w):
        A = S.as_operator(X)
        return np.concatenate([[len(y01)], A.rmatvec(_curvature(X, w) * A.matvec(d))])

    h = block_sums(rows, state, part).select("block_id", F.element_at("s", 1).alias("m"), F.posexplode("s").alias("k", "v")).where("k > 0")
    own = F.element_at(F.lit([float(v) for v in d]), F.col("k"))
    return h.select("block_id", (F.col("k") - 1).cast("int").alias("j"), (F.col("v") / F.col("m") + F.lit(rho) * own).alias("hd"))
