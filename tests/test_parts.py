"""Blocks solved in parts, byte bounds, matrix-free Newton, partial sums and mini-batch SGD."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.operators import blocks as B
from concord.operators import objectives as O
from concord.operators import solvers as S
from concord.plans import fixtures as fx
from concord.plans.train import place, train_logistic, train_regression

from conftest import SF_SMALL

TIGHT = dict(max_iter=150, abs_tol=1e-8, rel_tol=1e-8, primal_only_stop=False)


def part_sizes(placed):
    """Rows and bytes of the parts of a placed payload."""
    held = F.octet_length("x") + F.octet_length("idx") + F.octet_length("val") + F.lit(S.ROW_BYTES) * F.col("n")
    got = placed.payload.groupBy("block_id").agg(F.sum("n").alias("n"), F.sum(held).alias("b"), F.max("m").alias("m"), F.min("m").alias("m0")).collect()
    return [(r["n"], r["b"], r["m"]) for r in got if r["m"] == r["m0"]], len(got)


@pytest.mark.parametrize("family, rows_per_block", [("ridge", 400), ("newton", 400), ("newton", 1000)])
def test_the_model_does_not_depend_on_how_blocks_are_split(spark, family, rows_per_block):
    df = (fx.reg_small if family == "ridge" else fx.cls_small)(spark, SF_SMALL, n_blocks=5).where("block_id < 2").persist()

    def fit(most, rho):
        if family == "ridge":
            return train_regression(df, 2, lam=0.2, rho=rho, gram_max_p=0, max_block_rows=most, **TIGHT)
        return train_logistic(df, 3, lam=0.1, rho=rho, solver="newton", max_block_rows=most, **TIGHT)

    whole, parts = fit(None, 0.1), fit(rows_per_block, 0.2 * rows_per_block / 2400)
    assert whole.n_blocks == 2 and parts.n_blocks >= 2400 // rows_per_block
    assert max(whole.iterations, parts.iterations) < TIGHT["max_iter"]
    np.testing.assert_allclose(parts.weights, whole.weights, atol=1e-6)


def test_grams_are_never_split(spark):
    df = fx.reg_small(spark, SF_SMALL)
    a, b = (train_regression(df, 2, lam=1.0, rho=2.0, max_iter=5, early_stop=False, max_block_rows=m) for m in (None, 100))
    assert a.n_blocks == b.n_blocks == 4
    np.testing.assert_allclose(a.weights, b.weights, rtol=1e-12)


def test_parts_of_dense_blocks_stay_below_the_byte_limit(spark):
    limit = 1 << 20
    df = spark.range(6000).select(F.when(F.col("id") < 4000, 0).otherwise(1).cast("int").alias("block_id"), (F.col("id") % 2).cast("double").alias("label"),
                                  F.transform(F.sequence(F.lit(1), F.lit(512)), lambda k: k.cast("double")).alias("features"))
    placed = place(df, 512, binary=True, max_block_bytes=limit)
    sizes, n = part_sizes(placed)
    assert len(sizes) == n == placed.n_blocks and sum(s[0] for s in sizes) == 6000
    assert max(b for _, b, _ in sizes) <= limit and {m for _, _, m in sizes} == {4000, 2000}
    assert n <= 1.4 * 6000 * 512 * 8 / limit + 2  # the parts are well filled
    placed.release()


def test_parts_of_uneven_sparse_rows_stay_below_the_byte_limit(spark):
    limit = 300_000
    long = F.when(F.col("id") % 50 == 0, 1500).otherwise(3)  # a few rows hold most of the bytes
    df = spark.range(3000).select(F.lit(7).alias("block_id"), (F.col("id") % 2).cast("double").alias("label"),
                                  F.sequence(F.lit(0), long - 1).cast("array<int>").alias("indices"),
                                  F.array_repeat(F.lit(0.5), long.cast("int")).alias("values"))
    placed = place(df, 2000, binary=True, max_block_bytes=limit)
    sizes, n = part_sizes(placed)
    assert len(sizes) == n == placed.n_blocks >= 4 and sum(s[0] for s in sizes) == 3000
    assert max(b for _, b, _ in sizes) <= limit and {m for _, _, m in sizes} == {3000}
    placed.release()


def test_a_row_above_the_limit_is_a_part_of_its_own(spark):
    rows = [(0, 1.0, list(range(400)), [1.0] * 400), (0, 0.0, [1], [2.0]), (0, 1.0, [], [])]
    df = spark.createDataFrame(rows, "block_id int, label double, indices array<int>, values array<double>")
    placed = place(df, 400, binary=True, max_block_bytes=100)
    assert placed.payload.agg(F.sum("n")).first()[0] == 3 and placed.n_blocks >= 2
    placed.release()


def test_blocks_follow_the_bytes_of_joined_rows(spark):
    small = spark.range(1000).select(F.col("id"), F.array_repeat(F.lit(1.0), 100).alias("features"))
    both = small.join(small.select("id", F.lit("x" * 50).alias("t")), "id")
    assert B.blocks_for(both, block_bytes=1000 * 858) == 1 and B.blocks_for(both, block_bytes=500 * 858) == 2


def sparse_rows(rng, n, p):
    lens = rng.integers(0, 9, n)
    lens[min(5, n - 1)] = p // 2
    cols = np.concatenate([np.sort(rng.choice(p, k, replace=False)) for k in lens])
    X = S.CSR(n, p, np.repeat(np.arange(n), lens), cols, rng.standard_normal(len(cols)))
    dense = np.zeros((n, p))
    dense[X.rows, X.cols] = X.vals
    return X, dense


def test_sparse_gram_costs_a_row_its_own_square(monkeypatch):
    X, dense = sparse_rows(np.random.default_rng(0), 300, 80)
    np.testing.assert_allclose(S.gram_of(X), dense.T @ dense, atol=1e-12)
    monkeypatch.setattr(S, "GRAM_PRODUCTS", 100)  # long rows column by column
    np.testing.assert_allclose(S.gram_of(X), dense.T @ dense, atol=1e-12)


@pytest.mark.parametrize("rho", [1e-3, 0.1, 2.0])
def test_matrix_free_newton_equals_the_direct_one(rho):
    rng = np.random.default_rng(1)
    X, dense = sparse_rows(rng, 800, 60)
    y = (dense @ rng.standard_normal(60) > 0).astype(float)
    v = rng.standard_normal(60)
    for A in (X, dense):
        for rows in (None, 3000):
            direct = S.newton_logistic_mean(A, y, v, rho, np.zeros(60), rows=rows, direct_p=100)
            free = S.newton_logistic_mean(A, y, v, rho, np.zeros(60), rows=rows, direct_p=0)
            np.testing.assert_allclose(free, direct, atol=1e-5)


def test_solvers_that_reach_their_cap_say_so():
    rng = np.random.default_rng(2)
    X, dense = sparse_rows(rng, 100, 50)
    with pytest.raises(S.NotConverged):
        S.least_squares_cg(X, rng.standard_normal(100), np.zeros(50), 1e-6, np.zeros(50), max_iter=2)
    with pytest.raises(S.NotConverged):
        S.newton_logistic_mean(dense, (rng.random(100) < 0.5).astype(float), np.ones(50), 1e-3, np.zeros(50), max_iter=1)


def test_block_sums_meet_large_states_in_a_cogroup(spark):
    rows = fx.cls_small_sparse(spark, SF_SMALL).where("block_id < 3")
    state = spark.createDataFrame([(b, [0.5 * b, -1.0, 0.25]) for b in range(1, 5)], "block_id int, x array<double>")
    small, large = ({r["block_id"]: r["s"] for r in O.block_sums(rows, state, O._logistic, state_values=k).collect()} for k in (1000, 1))
    assert set(small) == set(large) == {1, 2}  # blocks with rows and a state
    for b in small:
        np.testing.assert_allclose(small[b], large[b], rtol=1e-10)


def test_objective_shuffle_does_not_grow_with_the_rows(spark):
    """One record per task and block goes through the only exchange above the rows."""
    rows = fx.cls_small(spark, SF_SMALL)
    state = spark.createDataFrame([(b, [0.5, -1.0, 0.25]) for b in range(4)], "block_id int, x array<double>")
    plan = O.block_sums(rows, state, O._logistic)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("MapInArrow") == 2 and "Generate" not in plan


def test_sgd_equals_a_plain_loop(spark):
    import hashlib

    from concord.plans.sgd import svm_sgd

    df = fx.cls_small(spark, SF_SMALL).withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    rows = df.select("key", "label", "features").collect()
    X, y = np.array([r["features"] for r in rows]), np.array([2 * r["label"] - 1 for r in rows])
    w = np.zeros(3)
    for t in range(1, 7):
        hit = np.array([int(hashlib.md5(f"{r['key']}:{t}".encode()).hexdigest()[:8], 16) % 1_000_000 < 300_000 for r in rows])
        A, b = X[hit], y[hit]
        active = b * (A @ w) < 1
        s = 2.0 / np.sqrt(t)
        w = (1 - s * 0.05) * w + s * (A[active] * b[active, None]).sum(axis=0) / len(b)
    got = svm_sgd(df, 3, key="key", iterations=6, step=2.0, lam=0.05, fraction=0.3, tol=0.0)
    np.testing.assert_allclose(got.weights, w, rtol=1e-9)
    sparse = fx.cls_small_sparse(spark, SF_SMALL).withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    again = svm_sgd(sparse.repartition(5, "key"), 3, key="key", iterations=6, step=2.0, lam=0.05, fraction=0.3, tol=0.0)
    np.testing.assert_allclose(again.weights, w, rtol=1e-9)
    full = svm_sgd(df, 3, iterations=100, step=1.0, lam=0.01, tol=0.05)
    assert full.iterations < 100  # stops when a step moves the weights little
    with pytest.raises(ValueError):
        svm_sgd(df, 3, fraction=0.5)
    with pytest.raises(ValueError):
        svm_sgd(df.withColumn("label", F.lit(3.0)), 3)


def test_sgd_leaves_the_weights_on_an_empty_batch(spark):
    from concord.plans.sgd import svm_sgd

    df = spark.createDataFrame([("a", 1.0, [1.0])], "key string, label double, features array<double>")
    got = svm_sgd(df, 1, key="key", iterations=3, fraction=0.000001, tol=0.0, w0=np.array([0.25]))
    assert got.weights.tolist() == [0.25] and got.iterations == 3


# --- line search, certificates ---------------------------------------------------------

def loss_of(rng, n, p, svm):
    X = rng.standard_normal((n, p)) * np.logspace(0, -1, p)
    y = np.where(X @ rng.standard_normal(p) + rng.standard_normal(n) > 0, 1.0, -1.0)
    return S.with_prox(S.squared_hinge_sum(X, y, 1.0) if svm else S.logistic_sum(X, y), rng.standard_normal(p), 0.1)


@pytest.mark.parametrize("svm", [False, True])
def test_line_search_meets_both_wolfe_conditions(svm):
    rng = np.random.default_rng(8)
    for p in (2, 30):
        fg = loss_of(rng, 400, p, svm)
        for first in (1e-6, 1e-3, 1.0, 1e3):
            x = rng.standard_normal(p)
            f, g = fg(x)
            slope = -float(g @ g)
            t, new, f_new, g_new = S.strong_wolfe(fg, x, -g, f, slope, first)
            np.testing.assert_allclose(new, x - t * g)
            assert f_new <= f + S.DECREASE * t * slope and abs(float(g_new @ -g)) <= S.CURVATURE * -slope


@pytest.mark.parametrize("svm", [False, True])
def test_lbfgs_reaches_the_optimum_with_few_calls(svm):
    rng = np.random.default_rng(9)
    fg, calls = loss_of(rng, 600, 40, svm), []

    def counted(w):
        calls.append(1)
        return fg(w)

    x = S.lbfgs(counted, np.zeros(40), max_iter=200, history=10, tol=1e-9)
    assert np.linalg.norm(fg(x)[1]) < 1e-4 * np.linalg.norm(fg(np.zeros(40))[1]) and len(calls) < 120


@pytest.mark.parametrize("l1", [False, True])
def test_certified_fits_satisfy_the_optimality_conditions(spark, l1):
    from concord.plans.train import fit_regression, mean_gram, prepare_regression, regression_certificate

    df = fx.reg_lasso(spark, SF_SMALL)
    prep = prepare_regression(df, 3)
    rows = df.select("block_id", "features", "label").collect()
    blocks = [(np.array([r["features"] for r in rows if r["block_id"] == b]), np.array([r["label"] for r in rows if r["block_id"] == b])) for b in range(4)]
    H, q = mean_gram(prep)
    np.testing.assert_allclose(H, sum(X.T @ X / len(b) for X, b in blocks), rtol=1e-9, atol=1e-12)
    np.testing.assert_allclose(q, sum(X.T @ b / len(b) for X, b in blocks), rtol=1e-9, atol=1e-12)
    m = fit_regression(prep, certify=1e-7, lam=0.05, rho=0.1, l1=l1, max_iter=300)
    assert m.gap <= 1e-7
    want = np.linalg.solve(H + 0.1 * np.eye(3), q)
    if l1:
        want = np.zeros(3)
        for _ in range(2000):
            for j in range(3):
                t = q[j] - H[j] @ want + H[j, j] * want[j]
                want[j] = np.sign(t) * max(abs(t) - 0.05, 0) / H[j, j]
    np.testing.assert_allclose(m.weights, want, atol=1e-5)
    assert regression_certificate(prep, 0.05, l1)(want) < 1e-10 < 1e-3 < regression_certificate(prep, 0.05, l1)(want + 0.1)
    with pytest.raises(RuntimeError):
        fit_regression(prep, certify=1e-12, lam=0.05, rho=50.0, l1=l1, max_iter=2)
    prep.release()


def test_split_blocks_take_about_the_passes_of_whole_ones(spark):
    df = fx.cls_small(spark, SF_SMALL, n_blocks=2).persist()
    opts = dict(lam=1.0, rho=2.0, max_iter=8, early_stop=False, lbfgs_max_iter=60, lbfgs_tol=1e-12)
    whole, parts = (train_logistic(df, 3, max_block_rows=most, **opts) for most in (None, 300))
    assert parts.n_blocks >= 20
    np.testing.assert_allclose(parts.weights[:2], whole.weights[:2], rtol=0.05)


def test_a_users_update_weighs_blocks_not_their_parts(spark):
    from concord.plans.admm import ADMMConfig, run_admm

    sizes = {0: 900, 1: 100}
    rows = [(b, float(b * 3 + k % 2), [1.0]) for b, n in sizes.items() for k in range(n)]
    df = spark.createDataFrame(rows, "block_id int, label double, features array<double>")
    placed = place(df, 1, max_block_rows=150)

    def block_mean(payload, x, v, rho):
        _, b = S.unpack_block(payload, "dense", 1)
        return np.array([(b.mean() + rho * v[0]) / (1.0 + rho)])

    res = run_admm(placed.payload, 1, block_mean, ADMMConfig(rho=1.0, max_iter=100, abs_tol=1e-9, rel_tol=1e-9, primal_only_stop=False,
                                                            z_update=lambda u, n, lam, rho: u / n))
    placed.release()
    assert placed.n_blocks > 2 and res.n_blocks == 2 and abs(res.z[0] - 2.0) < 1e-7


def test_a_run_begun_with_the_curvature_takes_few_evaluations():
    rng = np.random.default_rng(5)
    X = rng.uniform(-0.5, 0.5, (20_000, 3))
    y = np.sign(X @ [3.0, -2.0, 0.0] + rng.uniform(-0.5, 0.5, len(X)))
    for loss, curvature in ((S.logistic_sum, S.logistic_curvature), (lambda X, y: S.squared_hinge_sum(X, y, 1.0), lambda X, y, w: S.squared_hinge_curvature(X, y, 1.0, w))):
        calls, v = [0], np.array([4.0, -3.0, 0.1])
        fg = S.with_prox(loss(X, y), v, 7.0)

        def counted(w):
            calls[0] += 1
            return fg(w)

        start = S.lbfgs(fg, v, max_iter=200, tol=1e-14)
        x = S.lbfgs(counted, start + 1e-3, max_iter=60, tol=1e-12, metric=S.inverse_curvature(X, curvature(X, y, start), 7.0))
        assert calls[0] <= 8 and np.linalg.norm(fg(x)[1]) < 1e-5
    e = rng.random(3000)
    assert abs(S.sum_log1p(e) - np.log1p(e).sum()) < 1e-9


def test_a_task_holds_a_bounded_stack_of_rows():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"features": pa.array([[0.5] * 64] * 10_000)})
    sizes = [t.nbytes for t in S.buffered(iter([batch] * 20))]
    assert len(sizes) >= 3 and max(sizes) <= (32 << 20) + batch.nbytes


def _sparse_rows(rng, n, p):
    """Sparse rows, some without values and one with many."""
    lens = rng.integers(0, 9, n)
    lens[:3] = 0, 0, p
    cols = np.concatenate([rng.choice(p, k, replace=False) for k in lens])
    return S.CSR(n, p, np.repeat(np.arange(n), lens), cols, rng.standard_normal(len(cols)))


def test_sparse_products_equal_dense_ones(monkeypatch):
    rng = np.random.default_rng(11)
    for run in (1, 1 << 16):
        monkeypatch.setattr(S, "RUN_VALUES", run)
        for X in (_sparse_rows(rng, 300, 40), S.CSR(4, 3, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))):
            D = np.zeros((X.n, X.p))
            D[X.rows, X.cols] = X.vals
            w, r = rng.standard_normal(X.p), rng.standard_normal(X.n)
            np.testing.assert_allclose(X.matvec(w), D @ w, atol=1e-12)
            np.testing.assert_allclose(X.rmatvec(r), D.T @ r, atol=1e-12)


@pytest.mark.parametrize("svm", [False, True])
def test_a_step_on_sparse_rows_takes_one_product_each_way(svm):
    """However many trial steps a line search makes: scores are linear along a line."""
    rng = np.random.default_rng(12)
    X = _sparse_rows(rng, 400, 60)
    X.vals *= 5.0
    y = np.where(rng.random(X.n) < 0.5, 1.0, -1.0)
    v, calls = rng.standard_normal(X.p), [0, 0]

    class Counted(S.CSR):
        def matvec(self, w):
            calls[0] += 1
            return super().matvec(w)

        def rmatvec(self, r):
            calls[1] += 1
            return super().rmatvec(r)

    def loss(rows):
        return S.squared_hinge_sum(rows, y, 1.0) if svm else S.logistic_sum(rows, y)

    plain, trials = S.with_prox(loss(X), v, 0.5), [0]

    def by_points(w):
        trials[0] += 1
        return plain(w)

    metric = S.inverse_curvature(X, np.full(X.n, 0.01), 0.5)  # far from the curvature, so that first trial steps are too long
    x = S.lbfgs(S.with_prox(loss(Counted(X.n, X.p, X.rows, X.cols, X.vals)), v, 0.5), np.zeros(X.p), max_iter=10, tol=1e-12, metric=metric)
    assert calls == [11, 11] and trials[0] == 0
    np.testing.assert_allclose(x, S.lbfgs(by_points, np.zeros(X.p), max_iter=10, tol=1e-12, metric=metric), atol=1e-6)
    assert trials[0] > 15


def test_hashed_texts_equal_a_row_per_token(spark, scratch):
    """Documents and labels that occur more than once, also in several Arrow batches, nulls and texts without tokens."""
    texts = ["A b  a\tc", "b B b", None, " \n ", "x", "y z", "A\x0bb", " a İ"]
    docs = [(i % 9 if i % 11 else None, texts[i % 8]) for i in range(60)]
    labels = [(i % 10 if i % 7 else None, [0, 1, None][i % 3], 5) for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{scratch}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{scratch}/labels.parquet")
    counts = (spark.read.parquet(f"{scratch}/documents.parquet").join(spark.read.parquet(f"{scratch}/labels.parquet"), "doc_id")
              .select("doc_id", "quality", F.explode(F.split(F.lower("text"), r"\s+")).alias("tok")).where("tok <> ''")
              .groupBy("doc_id", "quality", F.pmod(F.xxhash64("tok"), F.lit(64)).cast("int").alias("j")).count())
    want = sorted((r.doc_id, str(r.quality), r.j, r["count"]) for r in counts.collect())
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    for size in ("2", before):
        spark.conf.set(key, size)
        try:
            df = fx.cls_sparse(spark, scratch, 4, 64)
            got = df.collect()
        finally:
            spark.conf.set(key, before)
        assert sorted((r.doc_id, str(None if r.label is None else int(r.label)), j, round(np.expm1(v)))
                      for r in got for j, v in zip(r.indices, r["values"])) == want
        assert all(r.indices == sorted(set(r.indices)) and r.block_id == r.doc_id % 4 for r in got)
        assert len({(r.doc_id, r.label) for r in got}) == len(got)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan  # no row per token


@pytest.mark.parametrize("rows", [400, 70])
def test_each_part_has_a_partition_of_its_own(spark, rows):
    placed = place(fx.cls_small(spark, SF_SMALL), 3, max_block_rows=rows)
    try:
        got = placed.payload.groupBy(F.spark_partition_id()).agg(F.countDistinct("block_id").alias("parts")).collect()
        assert placed.n_blocks > 15 and placed.payload.rdd.getNumPartitions() == len(got) == placed.n_blocks
        assert {r.parts for r in got} == {1}
    finally:
        placed.release()
