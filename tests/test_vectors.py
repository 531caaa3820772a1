"""Vector, loss and prox column functions (incl. the reference's scratch-program values)."""

import math

import pytest
from pyspark.sql import functions as F

from concord.functions import losses as L
from concord.functions import vectors as V


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_smoke_program_dot_and_axpy(spark):
    # sparse (1,0,0,0,5) . ones = 6 ; ones + 1 * x = (2,1,1,1,6)
    r = one(spark,
            V.sparse_dot(F.array(F.lit(0), F.lit(4)), F.array(F.lit(1.0), F.lit(5.0)), F.array_repeat(F.lit(1.0), 5)).alias("d"),
            V.axpy_sparse(1.0, F.array(F.lit(0), F.lit(4)), F.array(F.lit(1.0), F.lit(5.0)), F.array_repeat(F.lit(1.0), 5)).alias("y"))
    assert r["d"] == 6.0
    assert r["y"] == [2.0, 1.0, 1.0, 1.0, 6.0]


def test_dot_kinds_agree(spark):
    x_idx, x_val = F.array(F.lit(1), F.lit(3)), F.array(F.lit(2.0), F.lit(-1.0))
    y_idx, y_val = F.array(F.lit(0), F.lit(3)), F.array(F.lit(4.0), F.lit(5.0))
    dense_x = V.sparse_to_dense(F.lit(4), x_idx, x_val)
    dense_y = V.sparse_to_dense(F.lit(4), y_idx, y_val)
    r = one(spark,
            V.vector_dot(F.lit(4), None, dense_x, F.lit(4), None, dense_y).alias("dd"),
            V.vector_dot(F.lit(4), x_idx, x_val, F.lit(4), None, dense_y).alias("sd"),
            V.vector_dot(F.lit(4), None, dense_x, F.lit(4), y_idx, y_val).alias("ds"),
            V.vector_dot(F.lit(4), x_idx, x_val, F.lit(4), y_idx, y_val).alias("ss"))
    assert r["dd"] == r["sd"] == r["ds"] == r["ss"] == -5.0


def test_size_mismatch_raises(spark):
    with pytest.raises(Exception):
        one(spark, V.dense_dot(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))).alias("d"))


def test_copy_scale_norm(spark):
    r = one(spark, V.sparse_to_dense(F.lit(5), F.array(F.lit(2)), F.array(F.lit(7.0))).alias("c"),
            V.scale(3.0, F.array(F.lit(1.0), F.lit(-2.0))).alias("s"),
            V.sq_norm(F.array(F.lit(3.0), F.lit(4.0))).alias("n"))
    assert r["c"] == [0.0, 0.0, 7.0, 0.0, 0.0]
    assert r["s"] == [3.0, -6.0]
    assert r["n"] == 25.0


def test_soft_threshold_edges_are_exact_zero(spark):
    vals = [0.5, -0.5, 0.0, 0.7, -0.7]
    r = one(spark, L.soft_threshold_array(F.array(*[F.lit(v) for v in vals]), 0.5).alias("t"))
    assert r["t"][:3] == [0.0, 0.0, 0.0]
    assert all(math.copysign(1.0, v) == 1.0 for v in r["t"][:3])  # never -0.0
    assert r["t"][3] == pytest.approx(0.2) and r["t"][4] == pytest.approx(-0.2)


def test_log_loss_is_stable(spark):
    r = one(spark, L.log_loss(F.lit(800.0)).alias("a"), L.log_loss(F.lit(-800.0)).alias("b"),
            L.sigmoid(F.lit(0.0)).alias("s"))
    assert r["a"] == 0.0 and r["b"] == 800.0 and r["s"] == 0.5


def test_labels(spark):
    r = one(spark, L.label_pm1(F.lit(0.0)).alias("a"), L.label_pm1(F.lit(1.0)).alias("b"),
            L.label_01(F.lit(-1.0)).alias("c"), L.label_01(F.lit(1.0)).alias("d"))
    assert (r["a"], r["b"], r["c"], r["d"]) == (-1.0, 1.0, 0.0, 1.0)
