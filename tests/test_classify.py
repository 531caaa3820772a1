"""Logistic (L-BFGS sum loss, Newton mean loss) and squared-hinge SVM by ADMM against
independent solvers; block-count independence; the Spark ML twins."""

import numpy as np
import pytest

from concord.plans import fixtures as fx
from concord.plans.train import train_logistic, train_svm
from reference_solvers import logistic_sum_l1, logistic_sum_l2, squared_hinge_l2

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def data(spark):
    df = fx.cls_small(spark, SF_SMALL)
    pdf = df.select("block_id", "label", "features").toPandas()
    return df, np.stack(pdf.features.values), pdf.label.values, pdf.block_id.values


def test_lr_l2_sum_loss(spark, data):
    df, X, y, _ = data
    m = train_logistic(df, 3, lam=1.0, rho=1.0, max_iter=300, lbfgs_max_iter=50, lbfgs_tol=1e-10)
    np.testing.assert_allclose(m.weights, logistic_sum_l2(X, y, 1.0), rtol=2e-3, atol=2e-3)


def test_lr_l1_sparse_rows(spark, data):
    _, X, y, _ = data
    m = train_logistic(fx.cls_small_sparse(spark, SF_SMALL), 3, lam=2.0, rho=1.0, max_iter=300, l1=True,
                       lbfgs_max_iter=50, lbfgs_tol=1e-10)
    np.testing.assert_allclose(m.weights, logistic_sum_l1(X, y, 2.0), rtol=2e-3, atol=2e-3)


def test_lr_newton_mean_loss(spark, data):
    df, X, y, blocks = data
    counts = {b: (blocks == b).sum() for b in np.unique(blocks)}
    weights = np.array([1.0 / counts[b] for b in blocks])
    m = train_logistic(df, 3, lam=0.1, rho=0.2, max_iter=60, solver="newton", early_stop=False)
    np.testing.assert_allclose(m.weights, logistic_sum_l2(X, y, 0.1, weights=weights), rtol=1e-5, atol=1e-5)


def test_svm_squared_hinge(spark, data):
    df, X, y, _ = data
    m = train_svm(df, 3, lam=1.0, rho=1.0, cee=1.0, max_iter=300, lbfgs_max_iter=50, lbfgs_tol=1e-10)
    np.testing.assert_allclose(m.weights, squared_hinge_l2(X, y, 1.0), rtol=2e-3, atol=2e-3)


def test_svm_accepts_pm1_labels(spark, data):
    from pyspark.sql import functions as F

    df = data[0].withColumn("label", F.when(F.col("label") == 0.0, -1.0).otherwise(1.0))
    m = train_svm(df, 3, lam=1.0, max_iter=3, early_stop=False)
    assert m.iterations == 3


def test_sum_loss_optimum_independent_of_block_count(spark, data):
    from concord.operators.blocks import block_of_key
    from pyspark.sql import functions as F

    df = data[0]
    a = train_logistic(df.withColumn("block_id", block_of_key("l_orderkey", 2)), 3, lam=1.0, rho=1.0,
                       max_iter=300, lbfgs_max_iter=50, lbfgs_tol=1e-10).weights
    b = train_logistic(df.withColumn("block_id", block_of_key("l_orderkey", 5)), 3, lam=1.0, rho=1.0,
                       max_iter=300, lbfgs_max_iter=50, lbfgs_tol=1e-10).weights
    np.testing.assert_allclose(a, b, rtol=3e-3, atol=3e-3)


def test_spark_ml_twin_reaches_same_l2_optimum(spark, data):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    df, X, y, _ = data
    n = len(y)
    ml = LogisticRegression(regParam=2.0 / n, elasticNetParam=0.0, fitIntercept=False, standardization=False,
                            maxIter=200, tol=1e-12).fit(df.select("label", array_to_vector("features").alias("features")))
    np.testing.assert_allclose(ml.coefficients.toArray(), logistic_sum_l2(X, y, 1.0), rtol=1e-3, atol=1e-3)


def test_non_binary_labels_rejected(spark, data):
    from pyspark.sql import functions as F

    with pytest.raises(ValueError):
        train_logistic(data[0].withColumn("label", F.lit(2.0)), 3, max_iter=1)


def test_packed_layout_does_not_change_the_answer(spark, data):
    """Rows packed map-side arrive as several chunks per block when the input has many
    partitions; the pass must see the same block either way."""
    df = data[0]
    a = train_logistic(df.coalesce(1), 3, lam=1.0, max_iter=4, early_stop=False).weights
    b = train_logistic(df.repartition(7), 3, lam=1.0, max_iter=4, early_stop=False).weights
    c = train_logistic(fx.cls_small_sparse(spark, SF_SMALL).repartition(5), 3, lam=1.0, max_iter=4,
                       early_stop=False).weights
    np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-12)
    np.testing.assert_allclose(a, c, rtol=1e-9, atol=1e-12)


def test_hot_block_is_split_and_optimum_kept(spark, data):
    """One block holding most rows is split before placement; the sum-loss optimum is unchanged."""
    from pyspark.sql import functions as F

    df, X, y, _ = data
    hot = df.withColumn("block_id", F.when(F.col("l_linenumber") <= 4, F.lit(0))
                        .otherwise(F.pmod("l_orderkey", F.lit(3)) + 1).cast("int"))
    m = train_logistic(hot, 3, lam=1.0, rho=1.0, max_iter=300, lbfgs_max_iter=50, lbfgs_tol=1e-10,
                       max_block_rows=1500)
    assert m.n_blocks > 4
    np.testing.assert_allclose(m.weights, logistic_sum_l2(X, y, 1.0), rtol=2e-3, atol=2e-3)


def test_wide_newton_renews_lagging_duals(spark):
    """Curvatures far above the penalty: the copies' duals are renewed, so the run meets the plain run's stop rule at
    the optimum in a few passes (plain dual steps take more than 25)."""
    rng = np.random.default_rng(5)
    n, p, lam = 1200, 260, 0.01
    X = np.where(rng.random((n, p)) < 0.1, 1.0 + rng.random((n, p)), 0.0)
    y = (rng.random(n) < 1 / (1 + np.exp(-(X @ rng.normal(0, 0.5, p) - 0.2)))).astype(float)
    rows = [(i % 3, float(y[i]), np.flatnonzero(X[i]).tolist(), X[i][X[i] != 0].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "block_id int, label double, indices array<int>, values array<double>")
    m = train_logistic(df, p, lam=lam, rho=lam, solver="newton", max_iter=25, abs_tol=1e-5, rel_tol=1e-5, primal_only_stop=False)
    assert m.iterations < 25
    slope = 2 * lam * m.weights
    for b in range(3):
        A, t = X[b::3], y[b::3]
        slope = slope + A.T @ (1 / (1 + np.exp(-(A @ m.weights))) - t) / len(t)
    assert np.abs(slope).max() < 1e-4 and np.abs(m.weights).max() > 1e-3
