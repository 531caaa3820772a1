"""Trainers: logistic regression (L-BFGS, sum loss; Newton, mean loss), squared-hinge
SVM, ridge / lasso regression -- each one ADMM run over explicit row blocks -- plus
the lambda grid and regularisation paths.

Input rows: ``block_id int, label double`` and either ``features array<double>``
(dense) or ``indices array<int>, values array<double>`` (sparse, 0-based), with the
model width ``p`` given.  Training never brings rows to the driver.  Every trainer
checks its input first (blocks and labels present) and that exactly the counted rows
were placed.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concord.functions.losses import label_01
from concord.operators import solvers as S
from concord.operators.blocks import BLOCK_BYTES, check_rows
from concord.operators.objectives import HELD_VALUES, sum_partials
from concord.plans.admm import ADMMConfig, ADMMResult, LocalUpdate, list_column, part_share, run_admm, trace_frame, weights_frame
from concord.session import delete_path, ensure_importable, scratch_path

GRAM_SCHEMA = "block_id int, n long, gram array<double>, xty array<double>"
PARTIAL_SCHEMA = "block_id int, n int, gram binary, xty binary"
#: a block's packed records; ``m`` counts the rows of the whole block where a record belongs to a part of it
PAYLOAD_SCHEMA = f"{S.PACK_SCHEMA}, m long"
#: a split block is cut into records of this part of a block's limits, so that parts are filled well
PIECE = 1 / 16

#: Up to this width a least-squares block is kept as its p x p Gram (8 p^2 bytes per
#: block); wider ones keep their packed rows and solve by conjugate gradients.
GRAM_MAX_P = 512


@dataclass
class LinearModel:
    """Weights (intercept 0) plus how they were found."""

    weights: np.ndarray
    kind: str  # "logistic" | "svm" | "regression"
    n_blocks: int
    trace: pd.DataFrame = field(repr=False)
    rho: float = 0.0
    iterations: int = 0
    threshold: float | None = None
    #: violation of the optimality conditions, where it was certified
    gap: float | None = None

    def weights_frame(self, spark: SparkSession) -> DataFrame:
        return weights_frame(spark, self.weights)

    def trace_frame(self, spark: SparkSession) -> DataFrame:
        return trace_frame(spark, self.trace)

    def score_column(self, features: str = "features", indices: str | None = None, values: str | None = None) -> Column:
        from concord.operators.evaluate import linear_score
        return linear_score(self.weights, features=features, indices=indices, values=values)


# ------------------------------------------------------------------ placement


def check_binary_labels(df: DataFrame, label: str = "label") -> None:
    """Fail unless every label is 0 or 1 (one aggregate)."""
    bad = df.agg(F.count_if(~F.col(label).isin(0.0, 1.0) | F.col(label).isNull()).alias("bad")).first()["bad"]
    if bad:
        raise ValueError(f"{bad} rows have a label other than 0/1")


@dataclass
class Placed:
    """A payload with all records of a block in one partition, cached."""

    payload: DataFrame
    kind: str  # "dense" | "sparse" packed rows, "gram"
    n_rows: int
    n_blocks: int
    p: int
    path: str | None = None
    total: tuple[np.ndarray, np.ndarray] | None = field(default=None, repr=False)

    def release(self) -> None:
        self.payload.unpersist()
        if self.path:
            delete_path(self.payload.sparkSession, self.path)
            self.path = None


def _own_partitions(spark: SparkSession, n: int) -> DataFrame:
    """(number, id): for each of n numbers an id that hash partitioning over n partitions sends to a partition of its own."""
    tries = n * (n.bit_length() + 8)  # a number is left without one with a chance below exp(-8) / n
    found = spark.range(tries).groupBy(F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("number")).agg(F.min("id").alias("id"))
    return (spark.range(n).select(F.col("id").cast("int").alias("number")).join(found, "number", "left")
            .select("number", F.coalesce("id", F.lit(tries) + F.col("number")).cast("int").alias("id")))


def _split_blocks(rows: DataFrame, kind: str, p: int, max_rows: int, max_bytes: int) -> tuple[DataFrame, int, str]:
    """(records, parts, their folder): blocks cut into parts of at most ``max_rows`` rows and ``max_bytes`` bytes.

    Tasks pack their rows into small records, which are written once.  Sums over the records of a block, by place, deal
    them to parts: rows are never moved one by one, and a part's load follows from what its records hold, however
    unlike the rows are.  Every record keeps the number of rows of its whole block."""
    spark = rows.sparkSession
    limit = (max(1, int(max_rows * PIECE)), max(1, int(max_bytes * PIECE)))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in S.buffered(batches):
            yield S.pack_rows(table, kind, p, piece=limit)

    path = scratch_path(spark, "concord-parts")
    rows.mapInArrow(pieces, S.PACK_SCHEMA).withColumn("piece", F.monotonically_increasing_id()).write.parquet(path)
    written = spark.read.schema(f"{S.PACK_SCHEMA}, piece long").parquet(path)
    held = F.octet_length("x") + F.octet_length("idx") + F.octet_length("val") + F.lit(S.ROW_BYTES) * F.col("n")
    load = F.greatest(F.col("n") / F.lit(max_rows), held / F.lit(max_bytes))
    loads = written.select("block_id", "piece", "n", load.alias("load"))
    # a few records per part: the table is small, and one block's records are summed in order of place
    upto = Window.partitionBy("block_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("block_id")
    dealt = (loads.withColumn("part", F.floor((F.sum("load").over(upto) - F.col("load")) / F.lit(1 - 2 * PIECE)))
             .withColumn("m", F.sum("n").over(whole)).select("block_id", "piece", "part", "m"))
    numbers = dealt.select("block_id", "part").distinct().withColumn(
        "number", F.row_number().over(Window.orderBy("block_id", "part")) - 1)  # one row per part
    parts = numbers.count()
    numbers = numbers.join(_own_partitions(spark, parts), "number")
    placed = F.broadcast(dealt.join(numbers, ["block_id", "part"]).select("piece", "id", "m"))
    records = (written.join(placed, "piece").drop("block_id", "piece")
               .select(F.col("id").alias("block_id"), *[c for c in written.columns if c not in ("block_id", "piece")], "m"))
    return records, parts, path


def place(df: DataFrame, p: int, binary: bool = False, max_block_rows: int | None = None, gram: bool = False,
          max_block_bytes: int = BLOCK_BYTES) -> Placed:
    """Check the rows, stack the rows of each block map-side (packed rows, or their partial Gram), and move only those
    records, once: hash-partitioned on ``block_id`` and cached.  Two partitions per block keep blocks
    that meet by hash few; parts of split blocks are numbered so that each has a partition, and so a task, of its own.  Fails unless exactly the counted rows were placed.

    A block of more than ``max_block_bytes`` (or ``max_block_rows``, if given) is solved in parts, each with the row
    count of the whole block and so with its share of it (``part_share``): the objective, and with it the
    model, is the same however blocks are split.  A Gram is p x p whatever the rows, so with ``gram`` no block is split."""
    ensure_importable(df.sparkSession)
    kind = S.features_kind(df.columns)
    rows = df.select(*S.row_columns(kind))
    checked = check_rows(rows, binary=binary)
    n_blocks, path = checked.blocks, None

    def stack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in S.buffered(batches):
            yield S.pack_rows(table, kind, p)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partial Grams of a task's rows, sent on before they hold more than HELD_VALUES numbers."""
        def records() -> pa.RecordBatch:
            n, G, q = zip(*held.values())
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(n, pa.int32()), pa.array([g.tobytes() for g in G], pa.binary()),
                                               pa.array([v.tobytes() for v in q], pa.binary())], names=["block_id", "n", "gram", "xty"])

        held: dict[int, list] = {}
        for packed in stack(batches):
            for i in range(packed.num_rows):
                X, b = S.unpack_block(packed.slice(i, 1), kind, p)
                s = held.setdefault(packed.column("block_id")[i].as_py(), [0, np.zeros((p, p)), np.zeros(p)])
                s[0] += len(b)
                s[1] += S.gram_of(X)
                s[2] += S.as_operator(X).rmatvec(b)
                if len(held) * p * p > HELD_VALUES:
                    yield records()
                    held.clear()
        if held:
            yield records()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partial Grams of a partition summed as they come; one Gram per block is held."""
        sums: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                s = sums.setdefault(r["block_id"], [0, np.zeros(p * p), np.zeros(p)])
                s[0] += r["n"]
                s[1] += np.frombuffer(r["gram"], dtype=np.float64)
                s[2] += np.frombuffer(r["xty"], dtype=np.float64)
        for block, (n, G, q) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([n], pa.int64()), list_column(G), list_column(q)],
                                             names=["block_id", "n", "gram", "xty"])

    if gram:
        records = rows.mapInArrow(grams, PARTIAL_SCHEMA).repartition(2 * n_blocks, "block_id").mapInArrow(finish, GRAM_SCHEMA)
    elif checked.most_bytes > max_block_bytes or checked.most_rows > (max_block_rows or checked.most_rows):
        records, n_blocks, path = _split_blocks(rows, kind, p, max_block_rows or checked.rows, max_block_bytes)
    else:
        records = rows.mapInArrow(stack, S.PACK_SCHEMA).withColumn("m", F.lit(None).cast("long"))
    payload = records.repartition(n_blocks if path else 2 * n_blocks, "block_id").sortWithinPartitions("block_id").persist()
    placed = Placed(payload, "gram" if gram else kind, checked.rows, n_blocks, p, path)
    got = payload.agg(F.sum("n").alias("n"), F.countDistinct("block_id").alias("b")).first()
    if got["n"] != checked.rows or got["b"] != n_blocks:
        placed.release()
        raise RuntimeError(f"{checked.rows} rows in {n_blocks} blocks were counted, {got['n']} in {got['b']} were placed: "
                           "the input gives other rows when it is read again")
    return placed


# ------------------------------------------------------------------ block updates


def ls_update(p: int, kind: str) -> LocalUpdate:
    """Least squares: a solve on the block's Gram, or conjugate gradients on its rows."""

    def from_gram(payload: pa.Table, x: np.ndarray, v: np.ndarray, rho: float) -> np.ndarray:
        payload = payload.combine_chunks()
        G = payload.column("gram").chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(p, p)
        q = payload.column("xty").chunk(0).flatten().to_numpy(zero_copy_only=False)
        return S.least_squares_update(G, q, float(payload.column("n")[0].as_py()), v, rho)

    def from_rows(payload: pa.Table, x: np.ndarray, v: np.ndarray, rho: float) -> np.ndarray:
        X, b = S.unpack_block(payload, kind, p)
        return S.least_squares_cg(X, b, v, rho, x)

    return from_gram if kind == "gram" else from_rows


def _loss_update(p: int, kind: str, loss: Callable, curvature: Callable, max_iter: int, history: int, tol: float) -> LocalUpdate:
    """L-BFGS on ``loss(X, labels -1/+1)``, a sum, plus the proximal term; begun with the curvature at the last x."""

    def update(payload: pa.Table, x: np.ndarray, v: np.ndarray, rho: float) -> np.ndarray:
        X, y01 = S.unpack_block(payload, kind, p)
        ypm, own = 2.0 * y01 - 1.0, rho * part_share(payload)
        return S.lbfgs(S.with_prox(loss(X, ypm), v, own), x, max_iter=max_iter, history=history, tol=tol,
                       metric=S.inverse_curvature(X, curvature(X, ypm, x), own))

    return update


def _newton_update(p: int, kind: str) -> LocalUpdate:
    def update(payload: pa.Table, x: np.ndarray, v: np.ndarray, rho: float) -> np.ndarray:
        X, y01 = S.unpack_block(payload, kind, p)
        return S.newton_logistic_mean(X, y01, v, rho, x)

    return update


def _logistic_mean_gradient(p: int, kind: str) -> Callable[[pa.Table, np.ndarray], np.ndarray]:
    def gradient(payload: pa.Table, w: np.ndarray) -> np.ndarray:
        X, y01 = S.unpack_block(payload, kind, p)
        return S.logistic_sum(X, 2.0 * y01 - 1.0)(w)[1] / max(len(y01), 1)

    return gradient


# ------------------------------------------------------------------ regression


def prepare_regression(df: DataFrame, p: int, max_block_rows: int | None = None, gram_max_p: int = GRAM_MAX_P,
                       max_block_bytes: int = BLOCK_BYTES) -> Placed:
    """Read the rows once.  Up to ``gram_max_p`` features only partial Grams are
    shuffled and each block is kept as X^T X and X^T b; beyond, packed rows."""
    return place(df, p, max_block_rows=max_block_rows, gram=p <= gram_max_p, max_block_bytes=max_block_bytes)


def mean_gram(prep: Placed) -> tuple[np.ndarray, np.ndarray]:
    """(H, q): sums over the blocks of X^T X / n and X^T b / n, so that the summed block losses have the gradient
    H w - q.  Tasks add up their blocks' Grams; p x p values reach the driver, once per payload."""
    if prep.kind != "gram":
        raise ValueError("only a payload of Grams has their sum")
    if prep.total is None:
        p = prep.p

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, seen = np.zeros(p * p + p), False
            for batch in batches:
                for i in range(batch.num_rows):
                    n, seen = batch.column("n")[i].as_py(), True
                    total += np.concatenate([batch.column(c).slice(i, 1).flatten().to_numpy(zero_copy_only=False) for c in ("gram", "xty")]) / n
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block_id", "s"])

        s = np.array(sum_partials(prep.payload.mapInArrow(add, "block_id int, s binary"), 1).first()["s"])
        prep.total = s[:p * p].reshape(p, p), s[p * p:]
    return prep.total


def regression_certificate(prep: Placed, lam: float, l1: bool) -> Callable[[np.ndarray], float]:
    """How far weights are from satisfying the optimum's conditions, relative to the gradient at 0.

    Ridge: the norm of H w - q + 2 lam w.  Lasso: the norm of the smallest subgradient of
    the objective, 0 where |H w - q| <= lam at a zero weight."""
    H, q = mean_gram(prep)
    scale = max(float(np.linalg.norm(q)), 1e-300)

    def violation(w: np.ndarray) -> float:
        g = H @ w - q
        if l1:
            g = np.where(w != 0.0, g + lam * np.sign(w), np.sign(g) * np.maximum(np.abs(g) - lam, 0.0))
        else:
            g = g + 2.0 * lam * w
        return float(np.linalg.norm(g)) / scale

    return violation


def fit_regression(prep: Placed, *, certify: float | None = None, **config) -> LinearModel:
    """One ridge or lasso fit on a prepared payload (options of ``ADMMConfig``).  With ``certify``
    (Gram payloads) the run stops once the optimality conditions hold to that relative tolerance, instead of by
    the residuals, and fails if ``max_iter`` passes do not reach it."""
    if certify is not None:
        config |= {"certificate": regression_certificate(prep, config.get("lam", 1.0), config.get("l1", False)), "certify": certify}
    model = _model(run_admm(prep.payload, prep.p, ls_update(prep.p, prep.kind), ADMMConfig(**config)), "regression")
    if certify is not None and config.get("early_stop", True) and model.gap > certify:
        raise RuntimeError(f"{model.iterations} passes left a violation of {model.gap:.1e} of the optimality conditions")
    return model


def train_regression(df: DataFrame, p: int, *, max_block_rows: int | None = None, gram_max_p: int = GRAM_MAX_P,
                     max_block_bytes: int = BLOCK_BYTES, certify: float | None = None, **config) -> LinearModel:
    """Ridge (L2, penalty lam ||w||^2) or lasso (L1, lam ||w||_1) on
    sum_blocks 1/(2 n_i) ||X_i w - b_i||^2; ``config`` are ``ADMMConfig`` fields."""
    prep = prepare_regression(df, p, max_block_rows, gram_max_p, max_block_bytes)
    try:
        return fit_regression(prep, certify=certify, **config)
    finally:
        prep.release()


# ------------------------------------------------------------------ classification


def fit_logistic(prep: Placed, *, solver: str = "lbfgs", lbfgs_max_iter: int = 10, lbfgs_history: int = 5,
                 lbfgs_tol: float = 1e-4, **config) -> LinearModel:
    """One logistic fit on a placed payload."""
    if solver == "lbfgs":
        update = _loss_update(prep.p, prep.kind, S.logistic_sum, S.logistic_curvature, lbfgs_max_iter, lbfgs_history, lbfgs_tol)
    elif solver == "newton":
        update = _newton_update(prep.p, prep.kind)
        if prep.p > S.NEWTON_DIRECT_P:  # wide rows: curvatures far above the penalty, along which plain dual steps are slow
            config.setdefault("gradient", _logistic_mean_gradient(prep.p, prep.kind))
    else:
        raise ValueError(f"unknown solver {solver!r}")
    model = _model(run_admm(prep.payload, prep.p, update, ADMMConfig(**config)), "logistic")
    model.threshold = 0.5
    return model


def train_logistic(df: DataFrame, p: int, *, validate: bool = True, max_block_rows: int | None = None,
                   max_block_bytes: int = BLOCK_BYTES, **options) -> LinearModel:
    """Logistic regression, labels 0/1.

    ``solver="lbfgs"``: sum of log-losses per block.  ``solver="newton"``: mean log-loss
    per block.  Other options are those of ``fit_logistic`` and ``ADMMConfig``."""
    prep = place(df, p, binary=validate, max_block_rows=max_block_rows, max_block_bytes=max_block_bytes)
    try:
        return fit_logistic(prep, **options)
    finally:
        prep.release()


def fit_svm(prep: Placed, *, cee: float = 1.0, lbfgs_max_iter: int = 5, lbfgs_history: int = 10,
            lbfgs_tol: float = 1e-4, primal_only_stop: bool = False, **config) -> LinearModel:
    """One SVM fit on a placed payload."""
    update = _loss_update(prep.p, prep.kind, lambda X, y: S.squared_hinge_sum(X, y, cee),
                          lambda X, y, w: S.squared_hinge_curvature(X, y, cee, w), lbfgs_max_iter, lbfgs_history, lbfgs_tol)
    model = _model(run_admm(prep.payload, prep.p, update, ADMMConfig(primal_only_stop=primal_only_stop, **config)), "svm")
    model.threshold = 0.0
    return model


def train_svm(df: DataFrame, p: int, *, max_block_rows: int | None = None, max_block_bytes: int = BLOCK_BYTES,
              **options) -> LinearModel:
    """Linear SVM with the squared hinge, C * sum max(1 - y w.x, 0)^2 + lam R(w).

    Accepts 0/1 or -1/+1 labels (mapped once to 0/1; -1 -> 0)."""
    prep = place(df.withColumn("label", label_01("label")), p, binary=True, max_block_rows=max_block_rows,
                 max_block_bytes=max_block_bytes)
    try:
        return fit_svm(prep, **options)
    finally:
        prep.release()


def _model(res: ADMMResult, kind: str) -> LinearModel:
    return LinearModel(weights=res.z, kind=kind, n_blocks=res.n_parts, trace=res.trace,
                       rho=res.rho, iterations=res.iterations, gap=res.gap)


# ------------------------------------------------------------------ lambda grid, paths


def lambda_grid(spark: SparkSession, n: int, minr: float = 0.001, maxr: float = 1.0, nlambda: int = 50) -> DataFrame:
    """A geometric series of ``nlambda`` penalties falling from maxr n to minr n."""
    ratio = (minr / maxr) ** (1.0 / (nlambda - 1))
    return spark.range(nlambda).select(F.col("id").cast("int").alias("i"),
                                       (F.lit(float(maxr * n)) * F.pow(F.lit(ratio), F.col("id"))).alias("lambda"))


def regularization_path(df: DataFrame, p: int, lambdas: list[float], *, family: str = "regression",
                        warm_start: bool = True, max_block_rows: int | None = None, **options) -> list[LinearModel]:
    """One fit per penalty, in the order given (largest first is best), all on one placed
    payload.  ``warm_start`` begins each fit at the weights of the one before."""
    if family == "regression":
        prep, fit = prepare_regression(df, p, max_block_rows), fit_regression
    elif family == "logistic":
        prep, fit = place(df, p, binary=True, max_block_rows=max_block_rows), fit_logistic
    elif family == "svm":
        prep, fit = place(df.withColumn("label", label_01("label")), p, binary=True, max_block_rows=max_block_rows), fit_svm
    else:
        raise ValueError(f"unknown family {family!r}")
    try:
        models: list[LinearModel] = []
        for lam in lambdas:
            start = models[-1].weights if warm_start and models else None
            models.append(fit(prep, lam=lam, x0=start, **options))
        return models
    finally:
        prep.release()
