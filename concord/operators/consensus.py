"""Consensus steps across blocks: z-update (L2 / L1), dual update, residuals,
tolerances and the adaptive penalty.

Two forms of each step:

* DataFrame forms over a state table ``(block_id, x array<double>, y array<double>)``
  and a consensus table ``(j, z)`` -- the plain relational statement of the step,
  used as stand-alone operators and for the SQL checks.
* ``z_from_sum`` and ``consensus_from_moments``: the same arithmetic from the moments
  per coordinate that the loop gets in one aggregate per pass (see ``plans.admm``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.functions.losses import soft_threshold

ABS_TOL = 1e-3
REL_TOL = 1e-3


# ------------------------------------------------------------------ DataFrame forms


def explode_state(state: DataFrame) -> DataFrame:
    """(block_id, j, x, y): one row per block and coordinate."""
    return (state.select("block_id", F.posexplode(F.arrays_zip("x", "y")).alias("j", "e"))
                 .select("block_id", F.col("j").cast("int").alias("j"),
                         F.col("e.x").alias("x"), F.col("e.y").alias("y")))


def z_update(state: DataFrame, lam: float, rho: float, l1: bool, n_blocks: int | None = None) -> DataFrame:
    """Consensus z per coordinate j.

    L2: z = rho / (rho N + 2 lam) * sum_i (x_i + y_i / rho)
    L1: z = S_{lam/(rho N)}( mean_i (x_i + y_i / rho) )
    """
    long = explode_state(state)
    n = F.lit(float(n_blocks)) if n_blocks is not None else F.col("n_blocks").cast("double")
    sums = long.groupBy("j").agg(F.sum(F.col("x") + F.col("y") / F.lit(rho)).alias("u"),
                                 F.count(F.lit(1)).alias("n_blocks"))
    if l1:
        z = soft_threshold(F.col("u") / n, F.lit(lam) / (F.lit(rho) * n))
    else:
        z = F.lit(rho) / (F.lit(rho) * n + F.lit(2.0 * lam)) * F.col("u")
    return sums.select("j", z.alias("z"))


def dual_update(state: DataFrame, z: DataFrame, rho: float) -> DataFrame:
    """y_i <- y_i + rho (x_i - z), in long form (block_id, j, y)."""
    long = explode_state(state)
    return long.join(z, "j").select(
        "block_id", "j", (F.col("y") + F.lit(rho) * (F.col("x") - F.col("z"))).alias("y"))


# ------------------------------------------------------------------ scalar forms


@dataclass
class PassStats:
    z: np.ndarray
    resid_primal: float
    eps_primal: float
    resid_dual: float
    eps_dual: float


def z_from_sum(u_sum: np.ndarray, n_blocks: int, lam: float, rho: float, l1: bool) -> np.ndarray:
    if l1:
        mean = u_sum / n_blocks
        k = lam / (rho * n_blocks)
        z = np.where(mean > k, mean - k, np.where(mean < -k, mean + k, 0.0))
        return z + 0.0
    return rho / (rho * n_blocks + 2.0 * lam) * u_sum


def consensus_from_moments(z, z_prev, n_blocks: int, rho: float, m, abs_tol: float = ABS_TOL,
                           rel_tol: float = REL_TOL) -> PassStats:
    """Residuals and tolerances of one pass from per-coordinate moments over the blocks.

    ``m`` has, per coordinate, mean (mx) and sum of squared deviations (sx) of x_i, and
    the same (mw, sw) of w_i = y_i + rho x_i with y_i *before* this pass's dual update.
    With y_i' = w_i - rho z the dual after it:
    sum ||x_i - z||^2 = sx + N (mx - z)^2 and sum ||y_i'||^2 = sw + N (mw - rho z)^2,
    summed over coordinates -- sums of squares only, so nothing cancels.
    """
    z = np.asarray(z, dtype=np.float64)
    mx, sx, mw, sw = (m[c].to_numpy() for c in ("mx", "sx", "mw", "sw"))
    r2 = float(np.sum(sx + n_blocks * (mx - z) ** 2))
    y2 = float(np.sum(sw + n_blocks * (mw - rho * z) ** 2))
    x2 = float(np.sum(sx + n_blocks * mx ** 2))
    base = math.sqrt(len(z) * n_blocks) * abs_tol
    eps_primal = rel_tol * max(math.sqrt(x2), math.sqrt(n_blocks) * float(np.linalg.norm(z))) + base
    eps_dual = rel_tol * math.sqrt(y2) + base
    return PassStats(z, math.sqrt(r2), eps_primal, rho * math.sqrt(n_blocks) * float(np.linalg.norm(z - z_prev)), eps_dual)


def converged(stats: PassStats, primal_only: bool) -> bool:
    if primal_only:
        return stats.resid_primal < stats.eps_primal
    return stats.resid_primal < stats.eps_primal and stats.resid_dual < stats.eps_dual


def update_rho(rho: float, r: float, eps_r: float, s: float, eps_s: float) -> float:
    """Residual balancing: x2 / /2 on a 10x imbalance of the scaled residuals, then
    /1.2 if the primal residual is below tolerance, then x1.2 if the dual one is.
    The dual y is unscaled, so it is not rescaled when rho changes."""
    if r / eps_r > 10.0 * s / eps_s:
        rho *= 2.0
    elif s / eps_s > 10.0 * r / eps_r:
        rho /= 2.0
    if r < eps_r:
        rho /= 1.2
    if s < eps_s:
        rho *= 1.2
    return rho


def rho_update_col(rho, r, eps_r, s, eps_s):
    """The same rule as a column expression over a trace row."""
    step1 = (F.when(r / eps_r > F.lit(10.0) * s / eps_s, rho * 2.0)
              .when(s / eps_s > F.lit(10.0) * r / eps_r, rho / 2.0)
              .otherwise(rho))
    step2 = F.when(r < eps_r, step1 / 1.2).otherwise(step1)
    return F.when(s < eps_s, step2 * 1.2).otherwise(step2)


def residuals(state: DataFrame, z: DataFrame, z_prev: DataFrame, rho: float) -> DataFrame:
    """primal sqrt(sum_i ||x_i - z||^2), dual rho sqrt(N) ||z - z_prev|| (one row)."""
    long = explode_state(state).join(z, "j")
    primal = long.agg(F.sqrt(F.sum((F.col("x") - F.col("z")) ** 2)).alias("resid_primal"),
                      F.countDistinct("block_id").alias("n_blocks"))
    dz = z.join(z_prev.withColumnRenamed("z", "z_prev"), "j").agg(
        F.sqrt(F.sum((F.col("z") - F.col("z_prev")) ** 2)).alias("dz"))
    return (primal.withColumn("k", F.lit(0)).join(F.broadcast(dz.withColumn("k", F.lit(0))), "k")
                  .select("resid_primal", (F.lit(rho) * F.sqrt(F.col("n_blocks").cast("double")) * F.col("dz")).alias("resid_dual")))


def tolerances(state: DataFrame, z: DataFrame) -> DataFrame:
    """eps_primal = 1e-3 max(sqrt(sum ||x_i||^2), sqrt(N) ||z||) + 1e-3 sqrt(pN);
    eps_dual = 1e-3 sqrt(sum ||y_i||^2) + 1e-3 sqrt(pN), with y after the dual update."""
    long = explode_state(state)
    s = long.agg(F.sum(F.col("x") ** 2).alias("xx"), F.sum(F.col("y") ** 2).alias("yy"),
                 F.countDistinct("block_id").alias("n"), F.countDistinct("j").alias("p"))
    zz = z.agg(F.sum(F.col("z") ** 2).alias("zz"))
    both = s.withColumn("k", F.lit(0)).join(F.broadcast(zz.withColumn("k", F.lit(0))), "k")
    base = F.lit(ABS_TOL) * F.sqrt((F.col("p") * F.col("n")).cast("double"))
    return both.select(
        (F.lit(REL_TOL) * F.greatest(F.sqrt("xx"), F.sqrt(F.col("n").cast("double")) * F.sqrt("zz")) + base).alias("eps_primal"),
        (F.lit(REL_TOL) * F.sqrt("yy") + base).alias("eps_dual"))
