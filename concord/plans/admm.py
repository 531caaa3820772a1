"""The ADMM loop as Spark jobs.

Per pass:

1. x-update: ``payload.groupBy(block_id).cogroup(state.groupBy(block_id)).applyInArrow``.
   The payload (the block's packed rows, or its Gram) is hash-partitioned on
   ``block_id`` and persisted, so only the N state rows are shuffled to it.  The
   function first applies the previous pass's dual update y_i += rho_prev (x_i - z),
   then solves the block subproblem warm-started at x_i.
2. Moments of the new state per coordinate j: sums of x + y/rho and
   mean and variance of x and y + rho x over the blocks (p rows).  Narrow models observe them
   while the state is written (no further job); wider ones take one pass over it.  The driver turns
   these into z, both residuals and both tolerances (``consensus_from_moments``),
   applies the stop rule and the penalty update.  Rows and the N x p state never reach
   the driver, whatever N and p are.

A part of a split block takes part with its share s_i of the block's rows: loss, penalty and dual of the block are
divided among its parts, as f_i(x) + s_i rho/2 ||x - z + y_i/rho||^2 with y_i the dual of a whole block, and every sum over blocks
weighs a part by s_i.  The penalty thus stays in proportion to the curvature of the loss, and a run
takes about the passes of the whole blocks however many parts there are.

3. With ``gradient`` (the block loss's own) the duals are renewed where they lag, that is where the copies x_i are much
   further from z than z moves.  Plain steps bring y_i to -grad f_i(z), its value at the optimum, by a factor h / (h + rho) a pass
   in a direction of curvature h: slowly where h is large.  A renewal sets y_i = -grad f_i(z) plus one vector for all blocks, which
   leaves the sum of the duals as it was; one job sums the gradients (p values reach the driver).  Steps, stop rule and
   optimum are those of plain ADMM; a renewal that did not bring the run on is followed by ever longer plain runs.

z and rho travel to the next pass as values in the function's closure (Spark ships a
large closure as a broadcast), so a recomputed task always sees the values of *its*
pass.  The new state (N rows) is written to the checkpoint folder every pass and the
one before it is deleted: this cuts the plan, and a lost executor costs at most one
pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from concord.functions.vectors import zeros
from concord.operators.consensus import ABS_TOL, REL_TOL, PassStats, consensus_from_moments, converged, update_rho, z_from_sum
from concord.operators.objectives import sum_partials
from concord.operators.solvers import list_column
from concord.session import delete_path, scratch_path

STATE_SCHEMA = "block_id int, x array<double>, y array<double>"
#: the loop's own state: y is the dual of a whole block, ``share`` the part's share of its block's rows
SHARED_SCHEMA = f"{STATE_SCHEMA}, share double"

#: (payload of the block, x_i, v_i = z - y_i / rho, rho) -> new x_i.  A part of a split block gets the rho of the whole
#: block: a loss that is a mean over the payload's rows needs nothing more, one that is a sum takes rho * part_share(payload)
LocalUpdate = Callable[[pa.Table, np.ndarray, np.ndarray, float], np.ndarray]
#: (sum over blocks of x_i + y_i / rho, N, lam, rho) -> z
ZUpdate = Callable[[np.ndarray, int, float, float], np.ndarray]


@dataclass
class ADMMConfig:
    lam: float = 1.0
    rho: float = 2.0
    max_iter: int = 100
    l1: bool = False
    adaptive_rho: bool = False
    primal_only_stop: bool = True
    early_stop: bool = True
    abs_tol: float = ABS_TOL
    rel_tol: float = REL_TOL
    #: start weights of every block and of z (zeros by default)
    x0: np.ndarray | None = None
    #: replaces the L2 / L1 consensus step
    z_update: ZUpdate | None = None
    #: distance of z from the optimum's conditions; the run goes on until it is at most ``certify``
    certificate: Callable[[np.ndarray], float] | None = None
    certify: float = 1e-6
    #: gradient of a block's loss at given weights; with it lagging duals are renewed
    gradient: Callable[[pa.Table, np.ndarray], np.ndarray] | None = None


@dataclass
class ADMMResult:
    z: np.ndarray
    trace: pd.DataFrame
    #: whole blocks, however they are split
    n_blocks: int
    rho: float
    iterations: int
    state: DataFrame | None = field(default=None, repr=False)
    #: the certificate at z, if one was asked for
    gap: float | None = None
    #: blocks and parts of blocks that were solved
    n_parts: int = 0


def part_share(payload: pa.Table) -> float:
    """The payload's rows as a share of its whole block's (column ``m``; without it the payload is a whole block)."""
    whole = payload.column("m")[0].as_py() if "m" in payload.column_names else None
    return sum(payload.column("n").to_pylist()) / whole if whole else 1.0


def _vector(col: pa.ChunkedArray) -> np.ndarray:
    """The one list of a one-row column, without a copy through Python objects."""
    arr = col.combine_chunks()
    arr = arr.chunk(0) if isinstance(arr, pa.ChunkedArray) else arr
    return arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)


def make_pass_function(local_update: LocalUpdate, p: int, z: np.ndarray, rho: float,
                       pending: tuple[np.ndarray, float] | None, shares: bool = False, renew: tuple[Callable, np.ndarray] | None = None):
    """The cogroup function of one pass: (payload rows, state row) -> new state row, with ``shares`` of SHARED_SCHEMA.

    ``renew`` (gradient of the block's loss, common part of the duals) takes the place of the dual update."""

    def run(payload: pa.Table, state: pa.Table) -> pa.Table:
        if payload.num_rows == 0 or state.num_rows != 1:
            raise RuntimeError(f"a block has {payload.num_rows} payload rows and {state.num_rows} state rows")
        x, y = _vector(state.column("x")), _vector(state.column("y"))
        if len(x) != p or len(y) != p:
            raise ValueError(f"state of width {len(x)}, model of width {p}")
        if renew is not None:
            gradient, common = renew
            x, y = z, common - gradient(payload, z)
        elif pending is not None:
            z_new, rho_prev = pending
            y = y + rho_prev * (x - z_new)
        x_new = np.asarray(local_update(payload, x, z - y / rho, rho), dtype=np.float64)
        out = {"block_id": state.column("block_id"), "x": list_column(x_new), "y": list_column(y)}
        return pa.table(out | {"share": pa.array([part_share(payload)])} if shares else out)

    return run


#: up to this width the moments are observed while the state is written
OBSERVED_P = 16
MOMENTS = ("u", "mx", "sx", "mw", "sw")


def moments_frame(parts: float, n: float, sums: np.ndarray, rho: float, centre: np.ndarray) -> pd.DataFrame:
    """Moments from sums over the blocks, weighted by their shares, of u = x + y/rho, d, d^2, e and e^2
    (one row each), d = x - centre and e = y + rho x - rho centre: the centre is the consensus before the pass, so that
    the squares are as small as the spread asked for and nothing cancels."""
    u, d, dd, e, ee = sums
    return pd.DataFrame({"j": np.arange(len(u)), "u": u, "n": n, "parts": parts, "mx": centre + d / n, "sx": np.maximum(dd - d * d / n, 0.0),
                         "mw": rho * centre + e / n, "sw": np.maximum(ee - e * e / n, 0.0)})


def pass_moments(state: DataFrame, rho: float, p: int, centre: np.ndarray | None = None) -> pd.DataFrame:
    """Per coordinate: sum of u = x + y/rho, and mean and sum of squared deviations of x and w = y + rho x over the
    blocks.  Tasks add up their states; 5 p sums reach the driver."""
    at = np.zeros(p) if centre is None else centre

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + 5 * p)
        for batch in batches:
            for i in range(batch.num_rows):
                x, y = (batch.column(c).slice(i, 1).flatten().to_numpy(zero_copy_only=False) for c in ("x", "y"))
                if len(x) != p or len(y) != p:
                    raise ValueError(f"state of width {len(x)}, model of width {p}")
                share = batch.column("share")[i].as_py() if "share" in batch.schema.names else 1.0
                d, e = x - at, y + rho * (x - at)
                total += np.concatenate([[1.0, share], share * (x + y / rho), share * d, share * d * d, share * e, share * e * e])
        if total[0]:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block_id", "s"])

    s = np.array(sum_partials(state.mapInArrow(add, "block_id int, s binary"), 1).first()["s"])
    return moments_frame(s[0], s[1], s[2:].reshape(5, p), rho, at)


def moment_columns(rho: float, p: int, centre: np.ndarray | None = None, share: str = "1D") -> list[Column]:
    """The sums of ``pass_moments`` as one row: five per coordinate, the blocks and their shares."""
    out = ["count(1) AS parts", f"sum({share}) AS n"]
    for j in range(p):
        c = f"{0.0 if centre is None else float(centre[j])!r}D"
        x, y = f"x[{j}]", f"y[{j}]"
        d, e = f"({x} - {c})", f"({y} + {float(rho)!r}D * ({x} - {c}))"
        values = (f"{x} + {y} / {float(rho)!r}D", d, f"{d} * {d}", e, f"{e} * {e}")
        out += [f"sum({share} * ({v})) AS s{k}_{j}" for k, v in enumerate(values)]
    return [F.expr(e) for e in out]


def observed_moments(row: dict, p: int, rho: float = 1.0, centre: np.ndarray | None = None) -> pd.DataFrame:
    sums = np.array([[row[f"s{k}_{j}"] for j in range(p)] for k in range(5)], dtype=np.float64)
    return moments_frame(row["parts"], row["n"], sums, rho, np.zeros(p) if centre is None else centre)


def mean_gradient(payload: DataFrame, gradient: Callable[[pa.Table, np.ndarray], np.ndarray], z: np.ndarray, n_blocks: int) -> np.ndarray:
    """Mean over the blocks of their losses' gradients at z, parts weighed by their shares."""

    def own(table: pa.Table) -> pa.Table:
        return pa.table({"block_id": pa.array([0], pa.int32()), "s": pa.array([(part_share(table) * gradient(table, z)).tobytes()], pa.binary())})

    sums = payload.groupBy("block_id").applyInArrow(own, "block_id int, s binary")
    return np.array(sum_partials(sums, 1).first()["s"]) / n_blocks


#: duals lag when the primal residual is this many times the dual one, both by their tolerances
LAG = 10.0


class Renewals:
    """When to renew the duals: where they lag, and after a renewal that left the residuals no smaller only
    when twice as many plain passes as the last time have gone by."""

    def __init__(self) -> None:
        self.wait, self.rest, self.before = 0, 1, math.inf

    def due(self, s: PassStats) -> bool:
        primal, dual = s.resid_primal / s.eps_primal, s.resid_dual / s.eps_dual
        worst = max(primal, dual)
        if worst >= self.before:
            self.rest *= 2
            self.wait = self.rest
        self.before = math.inf
        if self.wait:
            self.wait -= 1
            return False
        if primal <= 1.0 or primal < LAG * dual:
            return False
        self.before = worst
        return True


def run_admm(payload: DataFrame, p: int, local_update: LocalUpdate, cfg: ADMMConfig) -> ADMMResult:
    """Run ADMM over a placed payload: rows with ``block_id``, hash-partitioned on it and
    persisted.  Every block of the payload takes part."""
    spark: SparkSession = payload.sparkSession
    root = scratch_path(spark, "concord-admm")
    start = np.zeros(p) if cfg.x0 is None else np.asarray(cfg.x0, dtype=np.float64)
    if len(start) != p:
        raise ValueError(f"start weights of width {len(start)}, model of width {p}")
    x0 = zeros(p) if cfg.x0 is None else F.lit([float(v) for v in start]).cast("array<double>")
    # Fresh names: the state must not share attribute ids with the payload, or the
    # cogroup of the first pass is an ambiguous self-join.
    state = (payload.select(F.col("block_id").alias("b")).distinct()
             .select(F.col("b").alias("block_id"), x0.alias("x"), zeros(p).alias("y")))
    z, rho, n_blocks, n_parts = start, float(cfg.rho), 0, 0
    gap: float | None = None
    pending: tuple[np.ndarray, float] | None = None
    renew: tuple[Callable, np.ndarray] | None = None
    renewals = Renewals()
    rows = []
    grouped = payload.groupBy("block_id")
    for it in range(cfg.max_iter):
        fn = make_pass_function(local_update, p, z, rho, pending, shares=True, renew=renew)
        path = f"{root}/pass-{it}"
        updated = grouped.cogroup(state.groupBy("block_id")).applyInArrow(fn, SHARED_SCHEMA)
        seen = Observation() if p <= OBSERVED_P else None
        (updated if seen is None else updated.observe(seen, *moment_columns(rho, p, z, "share"))).write.parquet(path)
        state = spark.read.schema(SHARED_SCHEMA).parquet(path)
        if it:
            delete_path(spark, f"{root}/pass-{it - 1}")
        m = pass_moments(state, rho, p, z) if seen is None else observed_moments(seen.get, p, rho, z)
        n_blocks, n_parts = round(m["n"].iloc[0]), int(m["parts"].iloc[0])
        u = m["u"].to_numpy()
        z_new = cfg.z_update(u, n_blocks, cfg.lam, rho) if cfg.z_update else z_from_sum(u, n_blocks, cfg.lam, rho, cfg.l1)
        stats: PassStats = consensus_from_moments(z_new, z, n_blocks, rho, m, cfg.abs_tol, cfg.rel_tol)
        rows.append((it, stats.resid_primal, stats.eps_primal, stats.resid_dual, stats.eps_dual, rho))
        pending = (stats.z, rho)
        z = stats.z
        if cfg.certificate:
            gap = cfg.certificate(z)
        if cfg.early_stop and (gap <= cfg.certify if cfg.certificate else converged(stats, cfg.primal_only_stop)):
            break
        renew = None
        if cfg.gradient and renewals.due(stats):
            duals = m["mw"].to_numpy() - rho * z  # their mean after a plain update
            renew = (cfg.gradient, duals + mean_gradient(payload, cfg.gradient, z, n_blocks))
        if cfg.adaptive_rho:
            rho = update_rho(rho, stats.resid_primal, stats.eps_primal, stats.resid_dual, stats.eps_dual)
    trace = pd.DataFrame(rows, columns=["iter", "resid_primal", "eps_primal", "resid_dual", "eps_dual", "rho"])
    return ADMMResult(z=z, trace=trace, n_blocks=n_blocks, rho=rho, iterations=len(rows), state=state, gap=gap, n_parts=n_parts)


def trace_frame(spark: SparkSession, trace: pd.DataFrame) -> DataFrame:
    schema = "iter int, resid_primal double, eps_primal double, resid_dual double, eps_dual double, rho double"
    return spark.createDataFrame(trace.astype({"iter": "int32"}), schema=schema)


def weights_frame(spark: SparkSession, z: np.ndarray) -> DataFrame:
    pdf = pd.DataFrame({"j": np.arange(len(z), dtype=np.int32), "weight": np.asarray(z, dtype=np.float64) + 0.0})
    return spark.createDataFrame(pdf, schema="j int, weight double")
