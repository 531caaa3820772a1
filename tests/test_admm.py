"""Ridge / lasso by ADMM: known answers, fixed points, invariants, stop rule."""

import numpy as np
import pytest

from concord.plans import fixtures as fx
from concord.plans.train import train_regression
from reference_solvers import lasso, ridge

from conftest import SF_CHECK, SF_SMALL


def blocks_of(df):
    pdf = df.select("block_id", "label", "features").toPandas()
    return [(np.stack(g.features.values), g.label.values) for _, g in pdf.groupby("block_id")]


@pytest.mark.parametrize("lam,l1,want", [
    (1.0, False, (0.30918535, -0.20755521)),
    (0.1, False, (0.51869137, -0.34806262)),
    (0.1, True, (0.50022587, -0.31737061)),
    (1.0, True, (0.00168840, 0.0)),
])
def test_five_passes_match_known_values(spark, lam, l1, want):
    m = train_regression(fx.reg_small(spark, SF_CHECK), 2, lam=lam, rho=2.0, max_iter=5, l1=l1, early_stop=False)
    assert m.iterations == 5
    np.testing.assert_allclose(m.weights, want, atol=1e-8)


def test_ridge_converges_to_closed_form(spark):
    df = fx.reg_small(spark, SF_SMALL)
    m = train_regression(df, 2, lam=1.0, rho=0.1, max_iter=300, early_stop=False)
    np.testing.assert_allclose(m.weights, ridge(blocks_of(df), 1.0), atol=1e-6)


def test_lasso_fixed_point_and_exact_zero(spark):
    df = fx.reg_lasso(spark, SF_SMALL)
    m = train_regression(df, 3, lam=0.05, rho=0.1, max_iter=400, l1=True, early_stop=False)
    ref = lasso(blocks_of(df), 0.05)
    np.testing.assert_allclose(m.weights, ref, atol=1e-5)
    assert m.weights[2] == 0.0 and ref[2] == 0.0


def test_l2_dual_sum_invariant(spark):
    """After any L2 pass, sum_i y_i (after the dual update) = 2 lam z, for any rho."""

    lam, rho = 0.7, 1.3
    from concord.plans.admm import ADMMConfig, run_admm
    from concord.plans.train import ls_update, prepare_regression

    prep = prepare_regression(fx.reg_small(spark, SF_SMALL), 2)
    res = run_admm(prep.payload, 2, ls_update(2, prep.kind), ADMMConfig(lam=lam, rho=rho, max_iter=4, early_stop=False))
    st = res.state.toPandas()
    x, y = np.stack(st.x.values), np.stack(st.y.values)
    y_after = y + rho * (x - res.z)
    np.testing.assert_allclose(y_after.sum(axis=0), 2 * lam * res.z, atol=1e-10)


def test_layout_does_not_change_the_answer(spark):
    df = fx.reg_small(spark, SF_SMALL)
    a = train_regression(df.repartition(3), 2, lam=1.0, max_iter=6, early_stop=False).weights
    b = train_regression(df.repartition(11, "l_linenumber"), 2, lam=1.0, max_iter=6, early_stop=False).weights
    np.testing.assert_allclose(a, b, atol=1e-12)


def test_stop_rule_and_trace(spark):
    m = train_regression(fx.reg_small(spark, SF_SMALL), 2, lam=1.0, rho=0.1, max_iter=500)
    last = m.trace.iloc[-1]
    assert m.iterations < 500 and last.resid_primal < last.eps_primal
    assert list(m.trace.columns) == ["iter", "resid_primal", "eps_primal", "resid_dual", "eps_dual", "rho"]


def test_adaptive_rho_follows_the_rule(spark):
    from concord.operators.consensus import update_rho

    m = train_regression(fx.reg_small(spark, SF_SMALL), 2, lam=1.0, rho=0.01, max_iter=8, adaptive_rho=True,
                         early_stop=False)
    t = m.trace
    for k in range(len(t) - 1):
        want = update_rho(t.rho[k], t.resid_primal[k], t.eps_primal[k], t.resid_dual[k], t.eps_dual[k])
        assert t.rho[k + 1] == pytest.approx(want, rel=1e-12)
    assert len(set(t.rho.round(12))) > 1


def test_rho_rule_cases():
    from concord.operators.consensus import update_rho

    assert update_rho(1.0, 100.0, 1.0, 1.0, 1.0) == 2.0          # primal far behind: x2
    assert update_rho(1.0, 1.0, 1.0, 100.0, 1.0) == 0.5          # dual far behind: /2
    assert update_rho(1.0, 0.5, 1.0, 2.0, 1.0) == pytest.approx(1 / 1.2)  # primal below tolerance
    assert update_rho(1.0, 2.0, 1.0, 0.5, 1.0) == pytest.approx(1.2)      # dual below tolerance


def test_regularization_path_is_monotone(spark):
    from concord.plans.train import regularization_path

    models = regularization_path(fx.reg_small(spark, SF_SMALL), 2, [5.0, 0.5, 0.05], rho=0.5, max_iter=200)
    norms = [np.abs(m.weights).sum() for m in models]
    assert norms[0] < norms[1] < norms[2]


def test_warm_start_reaches_the_same_path_in_fewer_passes(spark):
    from concord.plans.train import regularization_path

    df, lambdas = fx.reg_small(spark, SF_SMALL), [0.5, 0.45, 0.4]
    kw = dict(rho=0.2, max_iter=300, abs_tol=1e-7, rel_tol=1e-7, primal_only_stop=False)
    cold = regularization_path(df, 2, lambdas, warm_start=False, **kw)
    warm = regularization_path(df, 2, lambdas, warm_start=True, **kw)
    for a, b in zip(cold, warm):
        np.testing.assert_allclose(a.weights, b.weights, atol=1e-5)
    assert sum(m.iterations for m in warm) <= sum(m.iterations for m in cold)
    svm = regularization_path(fx.cls_small(spark, SF_SMALL), 3, [2.0, 1.0], family="svm", max_iter=3, early_stop=False)
    assert [m.iterations for m in svm] == [3, 3]


def test_wide_rows_use_conjugate_gradients_with_the_same_answer(spark):
    df = fx.reg_lasso(spark, SF_SMALL)
    a = train_regression(df, 3, lam=0.3, rho=0.5, max_iter=6, early_stop=False)
    b = train_regression(df, 3, lam=0.3, rho=0.5, max_iter=6, early_stop=False, gram_max_p=0)
    np.testing.assert_allclose(a.weights, b.weights, atol=1e-9)


def test_sparse_gram_equals_dense():
    from concord.operators.solvers import CSR, gram_of

    rng = np.random.default_rng(2)
    X = rng.normal(size=(40, 9)) * (rng.random((40, 9)) < 0.3)
    rows, cols = np.nonzero(X)
    np.testing.assert_allclose(gram_of(CSR(40, 9, rows, cols, X[rows, cols])), X.T @ X, atol=1e-12)


def test_moments_give_the_residuals_of_the_definition(spark):
    import pandas as pd

    from concord.operators.consensus import consensus_from_moments

    rng = np.random.default_rng(4)
    x, y, z, z_prev, rho = rng.normal(size=(5, 3)), rng.normal(size=(5, 3)), rng.normal(size=3), rng.normal(size=3), 1.7
    w = y + rho * x
    m = pd.DataFrame({"mx": x.mean(0), "sx": x.var(0) * 5, "mw": w.mean(0), "sw": w.var(0) * 5})
    s = consensus_from_moments(z, z_prev, 5, rho, m)
    assert s.resid_primal == pytest.approx(np.sqrt(((x - z) ** 2).sum()))
    assert s.resid_dual == pytest.approx(rho * np.sqrt(5) * np.linalg.norm(z - z_prev))
    assert s.eps_dual == pytest.approx(1e-3 * np.linalg.norm(y + rho * (x - z)) + 1e-3 * np.sqrt(15))


@pytest.mark.parametrize("rho", [2.0, 1e-5])
def test_observed_moments_equal_those_of_an_aggregate(spark, scratch, rho):
    from pyspark.sql import Observation

    from concord.plans import admm

    rng = np.random.default_rng(6)
    rows = [(b, [float(v) for v in rng.normal(size=3)], [float(v) for v in rng.normal(size=3) * 1e3]) for b in range(7)]
    state = spark.createDataFrame(rows, admm.STATE_SCHEMA)
    seen = Observation()
    state.observe(seen, *admm.moment_columns(rho, 3)).write.parquet(f"{scratch}/state")
    got, want = admm.observed_moments(seen.get, 3), admm.pass_moments(state, rho, 3)
    for c in ("n", *admm.MOMENTS):
        np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), rtol=1e-10)


def test_wide_and_narrow_models_take_the_same_passes(spark, monkeypatch):
    from concord.plans import admm

    df = fx.reg_small(spark, SF_SMALL)
    narrow = train_regression(df, 2, lam=0.5, max_iter=4, early_stop=False)
    monkeypatch.setattr(admm, "OBSERVED_P", 0)
    wide = train_regression(df, 2, lam=0.5, max_iter=4, early_stop=False)
    np.testing.assert_allclose(narrow.trace.to_numpy(), wide.trace.to_numpy(), rtol=1e-9)


def test_old_pass_files_are_deleted(spark):
    import os

    from concord.plans.admm import ADMMConfig, run_admm
    from concord.plans.train import ls_update, prepare_regression

    prep = prepare_regression(fx.reg_small(spark, SF_SMALL), 2)
    res = run_admm(prep.payload, 2, ls_update(2, prep.kind), ADMMConfig(max_iter=4, early_stop=False))
    root = os.path.dirname(os.path.dirname(res.state.inputFiles()[0].replace("file://", "")))
    assert os.listdir(root) == ["pass-3"]


def test_grams_of_many_small_input_partitions_agree(spark):
    df = fx.reg_small(spark, SF_SMALL)
    a = train_regression(df.coalesce(1), 2, lam=1.0, max_iter=5, early_stop=False).weights
    b = train_regression(df.repartition(400), 2, lam=1.0, max_iter=5, early_stop=False).weights
    np.testing.assert_allclose(a, b, rtol=1e-10, atol=1e-12)
