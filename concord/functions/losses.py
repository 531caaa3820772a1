"""Scalar loss, link and proximal column expressions (all built-in, codegen'd)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from concord.functions.vectors import ColumnOrName, _c


def sigmoid(t: ColumnOrName) -> Column:
    """1 / (1 + e^-t)."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(t)))


def log_loss(margin: ColumnOrName) -> Column:
    """Stable log(1 + e^-m): m>0 -> log1p(e^-m), else -m + log1p(e^m)."""
    m = _c(margin)
    return F.when(m > 0, F.log1p(F.exp(-m))).otherwise(-m + F.log1p(F.exp(m)))


def squared_hinge(margin: ColumnOrName) -> Column:
    """max(1 - m, 0)^2 for a signed margin m = y*w.x with y in {-1, +1}."""
    h = F.greatest(F.lit(1.0) - _c(margin), F.lit(0.0))
    return h * h


def label_pm1(label01: ColumnOrName) -> Column:
    """Map a {0,1} label to {-1,+1}: 2*l - 1."""
    return F.lit(2.0) * _c(label01).cast("double") - F.lit(1.0)


def label_01(raw: ColumnOrName) -> Column:
    """LIBSVM binary relabelling: -1 -> 0, anything else unchanged."""
    r = _c(raw)
    return F.when(r == -1.0, F.lit(0.0)).otherwise(r)


def soft_threshold(v: ColumnOrName, kappa: ColumnOrName | float) -> Column:
    """Strict soft threshold: v>k -> v-k, v<-k -> v+k, else exactly 0.0 (never -0.0)."""
    v = _c(v)
    k = F.lit(float(kappa)) if isinstance(kappa, (int, float)) else _c(kappa)
    return F.when(v > k, v - k).when(v < -k, v + k).otherwise(F.lit(0.0))


def soft_threshold_array(arr: ColumnOrName, kappa: ColumnOrName | float) -> Column:
    return F.transform(_c(arr), lambda v: soft_threshold(v, kappa))
