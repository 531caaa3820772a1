"""Mini-batch sub-gradient descent for the linear SVM (plain hinge, L2 penalty).

Step t takes a sample of the rows, averages the hinge's sub-gradient over it and moves

    w <- (1 - s lam) w - s mean_{i in batch, y_i w.x_i < 1} (-y_i x_i),     s = step / sqrt(t).

A batch is a repeatable hash sample of the row key and the step's number, so a lost
executor or another layout gives the same batch.  A step is one job: every task adds up the sub-gradients of its
rows (dense or sparse), the p-vectors are added in a tree, and one row reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions.losses import label_01
from concord.operators import solvers as S
from concord.operators.objectives import sum_partials
from concord.plans.train import LinearModel, check_binary_labels
from concord.session import ensure_importable
from concord.sources.libsvm import SPLIT_BUCKETS, bucket_of

#: partial vectors are first added over this many groups of tasks
GROUPS = 64


def in_batch(key: Column, step: int, fraction: float) -> Column:
    """Whether a row takes part in a step: its bucket of md5(key:step) is below the fraction."""
    bucket = bucket_of(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{step}")))
    return bucket < int(round(SPLIT_BUCKETS * fraction))


def svm_sgd(df: DataFrame, p: int, *, key: str | Column | None = None, iterations: int = 100, step: float = 1.0, lam: float = 0.01,
            fraction: float = 1.0, tol: float = 0.001, w0: np.ndarray | None = None) -> LinearModel:
    """Fit on rows with ``label`` (0/1 or -1/+1) and dense or sparse features.

    ``fraction`` below 1 needs ``key``, a column (or expression) that tells rows apart; rows of one key are
    sampled together.  An empty batch leaves the weights.  Stops after ``iterations`` steps, or when a step moves the
    weights by less than ``tol * max(||w||, 1)`` (0: never)."""
    spark = df.sparkSession
    ensure_importable(spark)
    if not 0 < fraction <= 1:
        raise ValueError("fraction must lie in (0, 1]")
    if fraction < 1 and key is None:
        raise ValueError("a fraction below 1 needs a key")
    kind = S.features_kind(df.columns)
    tag = (F.lit(None) if key is None else F.col(key) if isinstance(key, str) else key).cast("string").alias("key")
    rows = df.select(tag, label_01("label").alias("label"), *S.row_columns(kind)[2:]).persist()
    try:
        check_binary_labels(rows)
        w = np.zeros(p) if w0 is None else np.array(w0, dtype=np.float64)
        trace = []
        for t in range(1, iterations + 1):
            batch = rows if fraction == 1 else rows.where(in_batch(F.col("key"), t, fraction))
            n, loss, g = _hinge_sums(batch.drop("key"), kind, p, w)
            if n:
                s = step / math.sqrt(t)
                new = (1.0 - s * lam) * w - s * (g / n)
            else:
                new = w
            moved = float(np.linalg.norm(new - w))
            trace.append((t, int(n), loss / n if n else 0.0, moved))
            w = new
            if n and moved < tol * max(float(np.linalg.norm(w)), 1.0):
                break
    finally:
        rows.unpersist()
    return LinearModel(weights=w, kind="svm", n_blocks=1, iterations=len(trace), threshold=0.0,
                       trace=pd.DataFrame(trace, columns=["iter", "rows", "loss", "moved"]))


def _hinge_sums(batch: DataFrame, kind: str, p: int, w: np.ndarray) -> tuple[float, float, np.ndarray]:
    """(rows, hinge loss, sub-gradient) summed over a batch."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(p + 2)
        for table in S.buffered(batches):
            X = S.dense_block(table, p=p) if kind == "dense" else S.sparse_block(table, p)
            A, y = S.as_operator(X), 2.0 * S.labels_of(table) - 1.0
            gap = 1.0 - y * A.matvec(w)
            hit = gap > 0
            total += np.concatenate([[len(y), gap[hit].sum()], A.rmatvec(np.where(hit, -y, 0.0))])
        if total[0]:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % GROUPS], pa.int32()),
                                              pa.array([total.tobytes()], pa.binary())], names=["block_id", "s"])

    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.column("s").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([np.array(s).tobytes()], pa.binary())], names=["block_id", "s"])

    schema = "block_id int, s binary"
    groups = sum_partials(batch.mapInArrow(partial, schema), int(math.sqrt(GROUPS)))
    got = sum_partials(groups.mapInArrow(wrap, schema), 1).first()
    total = np.zeros(p + 2) if got is None else np.array(got["s"])
    return float(total[0]), float(total[1]), total[2:]
