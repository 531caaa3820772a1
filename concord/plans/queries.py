"""Registered queries: one per operator of the inventory, each reading the driver's
tables at ``sf_dir`` (whole tables) and built from this package's operators.

Floating outputs are rounded to 6 decimals (``+ 0.0`` keeps -0.0 out) so that an
engine with a different summation order produces the same value hash.
"""

from __future__ import annotations

from typing import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions import losses as L
from concord.functions import vectors as V
from concord.operators import consensus as C
from concord.operators import evaluate as E
from concord.operators import objectives as O
from concord.operators.blocks import assign_blocks, block_sizes, split_hot_blocks
from concord.plans import fixtures as fx
from concord.plans.admm import STATE_SCHEMA, make_pass_function
from concord.sources import libsvm as io

RHO = 2.0
# Fixed parameter values of the checks (weights, consensus vectors, penalties).
W3 = [0.5, -1.25, 2.0]
W_LR = [3.0, -2.0, 0.1]
Z2 = [0.25, -0.5]
Z2_PREV = [0.1, -0.2]
Z3 = [0.5, -0.5, 0.1]
KAPPA = 0.2
CEE = 1.0
PASSES = 5


def rnd(c: Column | str, digits: int) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def r6(c: Column | str) -> Column:
    """Continuous results: 6 decimals."""
    return rnd(c, 6)


def r3(c: Column | str) -> Column:
    """Sums over a whole block or table (magnitudes up to ~1e4): 3 decimals."""
    return rnd(c, 3)


def _z_frame(spark: SparkSession, z: list[float], name: str = "z") -> DataFrame:
    return spark.createDataFrame([(j, float(v)) for j, v in enumerate(z)], f"j int, {name} double")


# ------------------------------------------------------------------ fixtures shared by the checks


def libsvm_text(spark: SparkSession, sf_dir: str, with_bad: bool = False) -> DataFrame:
    """LIBSVM lines made from lineitem: labels -1/+1, 1-based indices, blank and comment
    lines, ragged spacing, rows without features; optionally malformed rows."""
    li = fx.spread(fx.table(spark, sf_dir, "lineitem"))
    lab = F.when(fx.planted() > 0, F.lit("+1")).otherwise(F.lit("-1"))
    q = F.round(F.col("l_quantity")).cast("int").cast("string")
    d = F.round(F.col("l_discount") * 100).cast("int")
    t = F.round(F.col("l_tax") * 100).cast("int")
    tok_q = F.concat(F.lit("1:"), q)
    tok_d = F.when(d != 0, F.concat(F.lit("2:"), d.cast("string")))
    tok_t = F.when(t != 0, F.concat(F.lit("3:"), t.cast("string")))
    ln = F.col("l_linenumber")
    normal = F.concat_ws(" ", lab, tok_q, tok_d, tok_t)
    ragged = F.concat(F.lit("  "), lab, F.lit("  "), tok_q, F.lit("  "), F.coalesce(tok_t, F.lit("")), F.lit(" "))
    value = (F.when(ln == 4, ragged)
              .when(ln == 5, lab)
              .when(ln == 6, F.concat(F.lit("# order "), F.col("l_orderkey").cast("string")))
              .when(ln == 7, F.lit("   "))
              .otherwise(normal))
    if with_bad:
        small = F.col("l_quantity") < 5
        value = (F.when((ln == 1) & small, F.concat_ws(" ", lab, tok_q, tok_q))  # an index twice
                  .when((ln == 2) & small, F.concat_ws(" ", lab, q))  # no colon
                  .when((ln == 3) & small, F.concat(F.lit("\t# order "), F.col("l_orderkey").cast("string")))
                  .when((ln == 4) & small, F.concat_ws(" ", lab, F.concat(F.lit("3:"), t.cast("string")), tok_q))
                  .when((ln == 5) & small, F.concat(lab, F.lit(" 0:"), q))
                  .when((ln == 6) & small, F.concat_ws(" ", F.lit("label"), tok_q))
                  .when((ln == 7) & small, F.concat(lab, F.lit(" 1:x")))
                  .otherwise(value))
    return li.select("l_orderkey", "l_linenumber", value.alias("value"))


def dense_points_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled points: ``(label,[q,d,t])``; lines 6-7 in the legacy ``label,q d t`` form."""
    li = fx.spread(fx.table(spark, sf_dir, "lineitem"))
    lab = F.when(fx.planted() > 0, F.lit("1.0")).otherwise(F.lit("0.0"))
    q = F.round(F.col("l_quantity")).cast("int").cast("string")
    d = F.round(F.col("l_discount") * 100).cast("int").cast("string")
    t = F.round(F.col("l_tax") * 100).cast("int").cast("string")
    dense = F.concat(F.lit("("), lab, F.lit(",["), q, F.lit(","), d, F.lit(","), t, F.lit("])"))
    legacy = F.concat(lab, F.lit(","), q, F.lit(" "), d, F.lit(" "), t)
    return li.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") >= 6, legacy).otherwise(dense).alias("value"))


def state2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block state from reg_small: x = (avg(a b), avg(c b)), y = (avg(a) - avg(c), avg(a c))."""
    rows = fx.reg_small(spark, sf_dir).select("block_id", F.col("features")[0].alias("a"),
                                              F.col("features")[1].alias("c"), F.col("label").alias("b"))
    return rows.groupBy("block_id").agg(
        F.array(F.avg(F.col("a") * F.col("b")), F.avg(F.col("c") * F.col("b"))).alias("x"),
        F.array(F.avg("a") - F.avg("c"), F.avg(F.col("a") * F.col("c"))).alias("y"))


def state3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block state from cls_small: x = avg(s * f), y = avg(f) / 10, s = 2 label - 1."""
    rows = fx.cls_small(spark, sf_dir)
    s = L.label_pm1("label")
    return rows.groupBy("block_id").agg(
        F.array(*[F.avg(s * F.col("features")[k]) for k in range(3)]).alias("x"),
        F.array(*[F.avg(F.col("features")[k]) / 10.0 for k in range(3)]).alias("y"))


def _parsed(spark, sf_dir, with_bad=False, relabel=True) -> DataFrame:
    return io.parse_records(io.clean_lines(libsvm_text(spark, sf_dir, with_bad)), relabel=relabel)


def _loaded_summary(rows: DataFrame) -> DataFrame:
    return rows.select("l_orderkey", "l_linenumber", r6("label").alias("label"), F.col("size").cast("int").alias("size"),
                       F.size("indices").alias("nnz"), F.array_join("indices", ",").alias("idx"),
                       r6(V.array_sum("values")).alias("val_sum"))


# ------------------------------------------------------------------ sources


def q_libsvm_clean_lines(spark, sf_dir):
    return io.clean_lines(libsvm_text(spark, sf_dir)).select("l_orderkey", "l_linenumber", "line")


def q_libsvm_parse(spark, sf_dir):
    p = _parsed(spark, sf_dir, relabel=False)
    return p.select("l_orderkey", "l_linenumber", r6("label").alias("label"), F.size("indices").alias("nnz"),
                    F.array_join("indices", ",").alias("idx"), r6(V.array_sum("values")).alias("val_sum"))


def q_libsvm_bad_rows(spark, sf_dir):
    return io.bad_rows(_parsed(spark, sf_dir, with_bad=True)).select("l_orderkey", "l_linenumber", "line")


def q_libsvm_good_rows(spark, sf_dir):
    """Tolerant load of the lines with malformed records: the good rows."""
    rows, _, _ = io.load_libsvm_tolerant(libsvm_text(spark, sf_dir, with_bad=True), binary=True)
    return _loaded_summary(rows)


def q_libsvm_load_binary(spark, sf_dir):
    rows, _ = io.load_libsvm_lines(libsvm_text(spark, sf_dir), binary=True)
    return _loaded_summary(rows)


def q_libsvm_load_raw(spark, sf_dir):
    rows, _ = io.load_libsvm_lines(libsvm_text(spark, sf_dir), binary=False)
    return _loaded_summary(rows)


def q_libsvm_load_files(spark, sf_dir):
    """The lines written as two folders of text files and read back by path, with a path that does not
    exist: rows, labels, stored values and the width found in the files."""
    from concord.session import scratch_path
    lines = libsvm_text(spark, sf_dir)
    paths = [scratch_path(spark, "concord-lines") for _ in range(3)]
    for k in (0, 1):
        lines.where(F.col("l_linenumber") % 2 == k).select("value").write.text(paths[k])
    rows, d = io.load_libsvm(spark, paths, binary=True, min_partitions=4, ignore_missing=True)
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("label").cast("long").alias("n_positive"), F.sum(F.size("indices")).alias("nnz"),
                    r3(F.sum(V.array_sum("values"))).alias("val_sum"), F.max("size").alias("size")).withColumn("width", F.lit(d))


def q_load_datasets_width(spark, sf_dir):
    """Train and test files read with the width of the train file, and the built-in source beside them."""
    from concord.session import scratch_path
    lines = libsvm_text(spark, sf_dir)
    train_path, test_path = (scratch_path(spark, "concord-lines") for _ in range(2))
    lines.where("l_linenumber <> 1").select("value").write.text(train_path)
    lines.where("l_linenumber = 1").select("value").write.text(test_path)
    train, test, d = io.load_datasets(spark, train_path, "libsvm", test_path)
    plain = io.vectors_to_arrays(io.load_libsvm_builtin(spark, test_path, num_features=d))
    dense = plain.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("w"), F.sum(V.array_sum("features")).alias("s")).first()
    return train.agg(F.count(F.lit(1)).alias("n_train")).join(test.agg(F.count(F.lit(1)).alias("n_test")), F.lit(True)).select(
        "n_train", "n_test", F.lit(d).alias("width"), F.lit(int(dense["n"])).cast("long").alias("n_builtin"),
        F.lit(int(dense["w"])).alias("builtin_width"), r3(F.lit(float(dense["s"]))).alias("builtin_sum"))


def q_num_features(spark, sf_dir):
    return io.num_features_frame(_parsed(spark, sf_dir))


def q_dense_points_parse(spark, sf_dir):
    p = io.parse_labeled_points(dense_points_text(spark, sf_dir))
    return p.select("l_orderkey", "l_linenumber", r6("label").alias("label"), F.size("features").alias("n"),
                    r6(V.array_sum("features")).alias("f_sum"), r6(V.sq_norm("features")).alias("f_sq"))


def q_hash_split(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", io.bucket_of("o_orderkey").alias("bucket"),
                         F.when(io.bucket_of("o_orderkey") < 200_000, F.lit("test")).otherwise(F.lit("train")).alias("split"))


def q_split_counts(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders")
    train, test = io.hash_split(orders, "o_orderkey", 0.2)
    return (train.select(F.lit("train").alias("split")).unionByName(test.select(F.lit("test").alias("split")))
                 .groupBy("split").agg(F.count(F.lit(1)).alias("n")))


# ------------------------------------------------------------------ labels, vectors, scalar functions


def q_label_pm1(spark, sf_dir):
    rows = fx.cls_small(spark, sf_dir)
    return rows.select("l_orderkey", "l_linenumber", r6("label").alias("label"), r6(L.label_pm1("label")).alias("label_pm1"))


def q_label_violations(spark, sf_dir):
    rows, _ = io.load_libsvm_lines(libsvm_text(spark, sf_dir), binary=False)
    return rows.agg(F.count(F.lit(1)).alias("n_rows"),
                    F.count_if(~F.col("label").isin(0.0, 1.0)).alias("n_bad"))


def _sparse3(spark, sf_dir) -> DataFrame:
    return fx.cls_small_sparse(spark, sf_dir)


def q_sparse_dot(spark, sf_dir):
    rows = _sparse3(spark, sf_dir)
    return rows.select("l_orderkey", "l_linenumber", r6(V.sparse_dot("indices", "values", E.weights_literal(W3))).alias("dot"))


def q_dense_dot(spark, sf_dir):
    rows = fx.cls_small(spark, sf_dir)
    return rows.select("l_orderkey", "l_linenumber", r6(V.dense_dot("features", E.weights_literal(W3))).alias("dot"))


def q_sparse_sparse_dot(spark, sf_dir):
    """x = {0: a, 2: t} minus zeros, y = {1: c, 2: exp(b)} (b the planted label)."""
    li = fx.table(spark, sf_dir, "lineitem")
    xa = F.filter(F.array(F.struct(F.lit(0).alias("i"), fx.feat_a().alias("v")),
                          F.struct(F.lit(2).alias("i"), fx.feat_t().alias("v"))), lambda e: e["v"] != 0.0)
    yb = F.array(F.struct(F.lit(1).alias("i"), fx.feat_c().alias("v")), F.struct(F.lit(2).alias("i"), F.exp(fx.planted()).alias("v")))
    rows = li.select("l_orderkey", "l_linenumber", xa.alias("x"), yb.alias("y"))
    dot = V.vector_dot(F.lit(3), F.transform("x", lambda e: e["i"]), F.transform("x", lambda e: e["v"]),
                       F.lit(3), F.transform("y", lambda e: e["i"]), F.transform("y", lambda e: e["v"]))
    return rows.select("l_orderkey", "l_linenumber", r6(dot).alias("dot"))


def q_weighted_feature_sum(spark, sf_dir):
    """axpy across rows: sum over a block's rows of b * x, per coordinate."""
    rows = fx.reg_lasso(spark, sf_dir)
    long = rows.select("block_id", "label", F.posexplode("features").alias("j", "v")).where(F.col("v") != 0.0)
    return (long.groupBy("block_id", "j").agg(F.sum(F.col("label") * F.col("v")).alias("s"))
                .select("block_id", F.col("j").cast("int").alias("j"), r3("s").alias("s")))


def q_sparse_to_dense(spark, sf_dir):
    rows = _sparse3(spark, sf_dir)
    dense = V.sparse_to_dense(F.lit(3), "indices", "values")
    return rows.select("l_orderkey", "l_linenumber", F.posexplode(dense).alias("k", "v")).select(
        "l_orderkey", "l_linenumber", F.col("k").cast("int").alias("k"), r6("v").alias("v"))


def q_vector_scale(spark, sf_dir):
    rows = fx.cls_small(spark, sf_dir)
    return rows.select("l_orderkey", "l_linenumber", F.posexplode(V.scale(2.5, "features")).alias("k", "v")).select(
        "l_orderkey", "l_linenumber", F.col("k").cast("int").alias("k"), r6("v").alias("v"))


def q_vector_axpy(spark, sf_dir):
    """Per-row axpy: y + 0.5 x with x sparse (a, c, t without zeros) and y = (1, 1, 1)."""
    rows = _sparse3(spark, sf_dir)
    y = V.axpy_sparse(0.5, "indices", "values", F.array_repeat(F.lit(1.0), 3))
    return rows.select("l_orderkey", "l_linenumber", F.posexplode(y).alias("k", "v")).select(
        "l_orderkey", "l_linenumber", F.col("k").cast("int").alias("k"), r6("v").alias("v"))


def q_sigmoid_scores(spark, sf_dir):
    rows = fx.cls_small(spark, sf_dir)
    m = V.dense_dot("features", E.weights_literal(W_LR))
    return rows.select("l_orderkey", "l_linenumber", r6(L.sigmoid(m)).alias("score"), r6(L.log_loss(m)).alias("log_loss"))


def q_soft_threshold(spark, sf_dir):
    rows = fx.cls_small(spark, sf_dir)
    return rows.select("l_orderkey", "l_linenumber", F.posexplode(L.soft_threshold_array("features", KAPPA)).alias("k", "v")).select(
        "l_orderkey", "l_linenumber", F.col("k").cast("int").alias("k"), r6("v").alias("v"))


# ------------------------------------------------------------------ blocks, block-local


def q_block_sizes(spark, sf_dir):
    return block_sizes(fx.reg_small(spark, sf_dir))


def q_block_state_join(spark, sf_dir):
    """Rows joined to their block's state (broadcast, N rows): count and sum of x_i . row."""
    rows = fx.reg_small(spark, sf_dir)
    st = state2(spark, sf_dir).select("block_id", "x")
    j = rows.join(st, "block_id")
    return j.groupBy("block_id").agg(F.count(F.lit(1)).alias("n_rows"),
                                     r3(F.sum(V.dense_dot("features", "x"))).alias("sum_margin"))


def q_block_assign_counts(spark, sf_dir):
    """Blocks by place over a shuffled input: rows in, rows placed by a trainer's placement."""
    from concord.plans.train import place
    grouped = fx.reg_small(spark, sf_dir).groupBy("l_orderkey").agg(F.avg("label").alias("label"), F.first("features").alias("features"))
    placed = place(assign_blocks(grouped, 400), 2)
    try:
        return spark.createDataFrame([(placed.n_rows,)], "n_rows long")
    finally:
        placed.release()


def q_split_hot_counts(spark, sf_dir):
    """Blocks of a shuffled input split at 300 rows: rows and largest block afterwards."""
    grouped = fx.reg_small(spark, sf_dir).groupBy("l_orderkey", "l_linenumber", "block_id").agg(F.avg("label").alias("label"))
    sizes = block_sizes(split_hot_blocks(grouped, 300))
    return sizes.agg(F.sum("n_rows").alias("n_rows"), (F.max("n_rows") <= 400).alias("bounded"))


def _grams(spark, sf_dir):
    from concord.plans.train import prepare_regression
    return prepare_regression(fx.reg_small(spark, sf_dir), 2)


def q_block_gram(spark, sf_dir):
    return _grams(spark, sf_dir).payload.select("block_id", "n", F.posexplode("gram").alias("k", "g")).select(
        "block_id", "n", (F.col("k") / 2).cast("int").alias("r"), (F.col("k") % 2).cast("int").alias("c"),
        r6(F.col("g") / F.col("n")).alias("g_mean"))


def q_block_xty(spark, sf_dir):
    return _grams(spark, sf_dir).payload.select("block_id", "n", F.posexplode("xty").alias("j", "q")).select(
        "block_id", F.col("j").cast("int").alias("j"), r6(F.col("q") / F.col("n")).alias("q_mean"))


def q_ls_x_update(spark, sf_dir):
    """One least-squares x-update from state2 with consensus Z2, rho = 2."""
    import numpy as np

    from concord.plans.train import ls_update
    prep = _grams(spark, sf_dir)
    fn = make_pass_function(ls_update(2, prep.kind), 2, np.array(Z2), RHO, None)
    out = prep.payload.groupBy("block_id").cogroup(state2(spark, sf_dir).groupBy("block_id")).applyInArrow(fn, STATE_SCHEMA)
    return out.select("block_id", F.posexplode("x").alias("j", "x")).select(
        "block_id", F.col("j").cast("int").alias("j"), r6("x").alias("x"))


def q_lr_objective(spark, sf_dir):
    o = O.lr_objective(fx.cls_small(spark, sf_dir), state3(spark, sf_dir), _z_frame(spark, Z3), RHO)
    return o.select("block_id", r3("objective").alias("objective"))


def q_lr_gradient(spark, sf_dir):
    g = O.lr_gradient(fx.cls_small(spark, sf_dir), state3(spark, sf_dir), _z_frame(spark, Z3), RHO)
    return g.select("block_id", "j", r3("gradient").alias("gradient"))


def q_lr_newton_hessian(spark, sf_dir):
    h = O.lr_newton_hessian(fx.cls_small(spark, sf_dir), state3(spark, sf_dir), RHO)
    return h.select("block_id", "r", "c", r6("h").alias("h"))


def q_svm_objective(spark, sf_dir):
    o = O.svm_objective(fx.cls_small(spark, sf_dir), state3(spark, sf_dir), _z_frame(spark, Z3), RHO, CEE)
    return o.select("block_id", r3("objective").alias("objective"))


def q_svm_gradient(spark, sf_dir):
    g = O.svm_gradient(fx.cls_small(spark, sf_dir), state3(spark, sf_dir), _z_frame(spark, Z3), RHO, CEE)
    return g.select("block_id", "j", r3("gradient").alias("gradient"))


def q_lr_objective_sparse(spark, sf_dir):
    """Sparse rows: the values of the dense rows."""
    o = O.lr_objective(fx.cls_small_sparse(spark, sf_dir), state3(spark, sf_dir), _z_frame(spark, Z3), RHO)
    return o.select("block_id", r3("objective").alias("objective"))


def q_lr_gradient_sparse(spark, sf_dir):
    g = O.lr_gradient(fx.cls_small_sparse(spark, sf_dir), state3(spark, sf_dir), _z_frame(spark, Z3), RHO)
    return g.select("block_id", "j", r3("gradient").alias("gradient"))


def q_svm_objective_sparse(spark, sf_dir):
    o = O.svm_objective(fx.cls_small_sparse(spark, sf_dir), state3(spark, sf_dir), _z_frame(spark, Z3), RHO, CEE)
    return o.select("block_id", r3("objective").alias("objective"))


def q_svm_gradient_sparse(spark, sf_dir):
    g = O.svm_gradient(fx.cls_small_sparse(spark, sf_dir), state3(spark, sf_dir), _z_frame(spark, Z3), RHO, CEE)
    return g.select("block_id", "j", r3("gradient").alias("gradient"))


def q_lr_hessian_product(spark, sf_dir):
    """The Newton Hessian times a vector, without forming it (sparse rows)."""
    h = O.lr_hessian_product(fx.cls_small_sparse(spark, sf_dir), state3(spark, sf_dir), W3, RHO)
    return h.select("block_id", "j", r6("hd").alias("hd"))


# ------------------------------------------------------------------ consensus steps


def q_z_update_l2(spark, sf_dir):
    return C.z_update(state2(spark, sf_dir), lam=1.0, rho=RHO, l1=False).select("j", r6("z").alias("z"))


def q_z_update_l1(spark, sf_dir):
    return C.z_update(state2(spark, sf_dir), lam=0.1, rho=RHO, l1=True).select("j", r6("z").alias("z"))


def q_dual_update(spark, sf_dir):
    return C.dual_update(state2(spark, sf_dir), _z_frame(spark, Z2), RHO).select("block_id", "j", r6("y").alias("y"))


def q_admm_residuals(spark, sf_dir):
    r = C.residuals(state2(spark, sf_dir), _z_frame(spark, Z2), _z_frame(spark, Z2_PREV), RHO)
    return r.select(r6("resid_primal").alias("resid_primal"), r6("resid_dual").alias("resid_dual"))


def q_admm_tolerances(spark, sf_dir):
    t = C.tolerances(state2(spark, sf_dir), _z_frame(spark, Z2))
    return t.select(r6("eps_primal").alias("eps_primal"), r6("eps_dual").alias("eps_dual"))


# ------------------------------------------------------------------ whole trainers (ridge / lasso: SQL-checked)


def _trace_out(df: DataFrame) -> DataFrame:
    return df.select("iter", *[r6(c).alias(c) for c in ("resid_primal", "eps_primal", "resid_dual", "eps_dual", "rho")])


def _ridge(spark, sf_dir, l1: bool, lam: float, adaptive: bool = False):
    from concord.plans.train import train_regression
    df = fx.reg_small(spark, sf_dir)
    return train_regression(df, 2, lam=lam, rho=RHO, max_iter=PASSES, l1=l1, early_stop=False, adaptive_rho=adaptive)


def q_admm_ridge_trace(spark, sf_dir):
    return _trace_out(_ridge(spark, sf_dir, False, 1.0).trace_frame(spark))


def q_admm_ridge_weights(spark, sf_dir):
    return _ridge(spark, sf_dir, False, 1.0).weights_frame(spark).select("j", r6("weight").alias("weight"))


def q_admm_lasso_trace(spark, sf_dir):
    return _trace_out(_ridge(spark, sf_dir, True, 0.1).trace_frame(spark))


def q_admm_lasso_weights(spark, sf_dir):
    return _ridge(spark, sf_dir, True, 0.1).weights_frame(spark).select("j", r6("weight").alias("weight"))


PATH_LAMBDAS = [10.0, 1.0, 0.1]


def q_admm_ridge_path(spark, sf_dir):
    """Regularisation path: PASSES passes per lambda, every fit on the same cached Grams."""
    from concord.plans.train import regularization_path
    models = regularization_path(fx.reg_small(spark, sf_dir), 2, PATH_LAMBDAS, warm_start=False, rho=RHO, max_iter=PASSES,
                                 early_stop=False)
    rows = [(float(lam), j, float(w)) for lam, m in zip(PATH_LAMBDAS, models) for j, w in enumerate(m.weights)]
    return spark.createDataFrame(rows, "lambda double, j int, weight double").select(
        "lambda", "j", r6("weight").alias("weight"))


#: certified fits: the optimality conditions hold to this part of the gradient at 0
CERTIFIED = dict(certify=1e-6, rho=0.1, max_iter=300)
OPTIMUM_LAMBDAS = [1.0, 0.3, 0.1, 0.03]


def _certified(spark, sf_dir, lam: float, l1: bool) -> DataFrame:
    from concord.plans.train import train_regression
    m = train_regression(fx.reg_small(spark, sf_dir), 2, lam=lam, l1=l1, **CERTIFIED)
    return m.weights_frame(spark).select("j", rnd("weight", 4).alias("weight"))


def q_admm_ridge_optimum(spark, sf_dir):
    """Ridge to a certified optimum: the closed form."""
    return _certified(spark, sf_dir, 0.3, False)


def q_admm_lasso_optimum(spark, sf_dir):
    """Lasso to a certified optimum: coordinate descent to convergence."""
    return _certified(spark, sf_dir, 0.05, True)


def _warm_path(spark, sf_dir, l1: bool) -> DataFrame:
    """A path over OPTIMUM_LAMBDAS, largest first: one placement, every fit starts at the weights of the one
    before and runs to a certified optimum."""
    from concord.plans.train import regularization_path
    models = regularization_path(fx.reg_small(spark, sf_dir), 2, OPTIMUM_LAMBDAS, l1=l1, **CERTIFIED)
    rows = [(float(lam), j, float(w)) for lam, m in zip(OPTIMUM_LAMBDAS, models) for j, w in enumerate(m.weights)]
    return spark.createDataFrame(rows, "lambda double, j int, weight double").select("lambda", "j", rnd("weight", 4).alias("weight"))


def q_admm_ridge_path_warm(spark, sf_dir):
    return _warm_path(spark, sf_dir, False)


def q_admm_lasso_path_warm(spark, sf_dir):
    return _warm_path(spark, sf_dir, True)


def q_admm_ridge_sparse_weights(spark, sf_dir):
    """Ridge from sparse rows (zeros not stored): the same answer as the dense rows."""
    from concord.plans.train import train_regression
    dense = fx.reg_small(spark, sf_dir)
    pairs = F.filter(F.transform("features", lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda e: e["v"] != 0.0)
    sparse = dense.select("block_id", "label", F.transform(pairs, lambda e: e["i"]).alias("indices"),
                          F.transform(pairs, lambda e: e["v"]).alias("values"))
    m = train_regression(sparse, 2, lam=1.0, rho=RHO, max_iter=PASSES, early_stop=False)
    return m.weights_frame(spark).select("j", r6("weight").alias("weight"))


def q_admm_ridge_adaptive_trace(spark, sf_dir):
    return _trace_out(_ridge(spark, sf_dir, False, 1.0, adaptive=True).trace_frame(spark))


def q_rho_update(spark, sf_dir):
    """The penalty rule applied to each row of the ridge trace."""
    t = _ridge(spark, sf_dir, False, 1.0).trace_frame(spark)
    nxt = C.rho_update_col(F.col("rho"), F.col("resid_primal"), F.col("eps_primal"), F.col("resid_dual"), F.col("eps_dual"))
    return t.select("iter", r6(nxt).alias("rho_next"))


def q_lambda_grid(spark, sf_dir):
    from concord.plans.train import lambda_grid
    n = fx.table(spark, sf_dir, "orders").count()
    return lambda_grid(spark, int(n)).select("i", r6("lambda").alias("lambda"))


# ------------------------------------------------------------------ scoring, evaluation


def _scored_lr(spark, sf_dir):
    return E.predict(fx.cls_small(spark, sf_dir), W_LR, "logistic")


def q_predict_lr(spark, sf_dir):
    p = _scored_lr(spark, sf_dir)
    return p.select("l_orderkey", "l_linenumber", r6("label").alias("label"), r6("score").alias("score"), r6("prediction").alias("prediction"))


def q_predict_svm(spark, sf_dir):
    p = E.predict(fx.cls_small(spark, sf_dir), W_LR, "svm")
    return p.select("l_orderkey", "l_linenumber", r6("label").alias("label"), r6("score").alias("score"), r6("prediction").alias("prediction"))


def q_predict_reg(spark, sf_dir):
    p = E.predict(fx.reg_small(spark, sf_dir), [3.0, -2.0], "regression")
    return p.select("l_orderkey", "l_linenumber", rnd("label", 7).alias("label"), r6("prediction").alias("prediction"))


WIDE_P = 1_000_000


def q_predict_wide(spark, sf_dir):
    """Scores of a model of a million weights: a weight table, never a vector in the plan."""
    li = fx.table(spark, sf_dir, "lineitem")
    rows = li.select("l_orderkey", "l_linenumber", F.array(
        F.pmod(F.col("l_partkey") * 97, F.lit(WIDE_P // 2)).cast("int"),
        (F.pmod(F.col("l_orderkey") * 31 + F.col("l_linenumber"), F.lit(WIDE_P // 2)) + WIDE_P // 2).cast("int")).alias("indices"),
        F.array(F.lit(1.0) + fx.feat_a(), fx.feat_c()).alias("values"))
    weights = spark.range(WIDE_P).select(F.col("id").cast("int").alias("j"), ((F.col("id") * 7919 % 1000) / 500.0 - 1.0).alias("weight"))
    p = E.predict_wide(rows, weights, "logistic")
    return p.select("l_orderkey", "l_linenumber", r6("score").alias("score"), r6("prediction").alias("prediction"))


def q_accuracy(spark, sf_dir):
    return E.accuracy(_scored_lr(spark, sf_dir)).select("n", r6("accuracy").alias("accuracy"))


def _ranked(spark, sf_dir):
    """Scores to 12 decimals: equal scores then tie in any engine, whatever its exp()."""
    return _scored_lr(spark, sf_dir).withColumn("score", F.round("score", 12))


def q_pr_curve(spark, sf_dir):
    c = E.pr_curve(_ranked(spark, sf_dir))
    return c.select(r6("threshold").alias("threshold"), r6("recall").alias("recall"), r6("precision").alias("precision"))


def q_area_under_pr(spark, sf_dir):
    return E.area_under_pr(_ranked(spark, sf_dir)).select(r6("area_under_pr").alias("area_under_pr"))


def q_regression_metrics(spark, sf_dir):
    p = E.predict(fx.reg_small(spark, sf_dir), [3.0, -2.0], "regression")
    m = E.regression_metrics(p)
    return m.select("n", r6("mean_label").alias("mean_label"), r3("sst").alias("sst"), r3("sse").alias("sse"),
                    r6("mse").alias("mse"), r6("r2").alias("r2"))


# ------------------------------------------------------------------ trainers checked against solvers (rows-only in the driver)


#: the classifiers run to these tolerances, so their weights are the optimum's
TIGHT = dict(max_iter=300, abs_tol=1e-6, rel_tol=1e-6, primal_only_stop=False)
SOLVE = dict(lbfgs_max_iter=60, lbfgs_history=10, lbfgs_tol=1e-12)


def _weights(model, spark) -> DataFrame:
    return model.weights_frame(spark).select("j", r6("weight").alias("weight"))


def _optimum(model, spark) -> DataFrame:
    """Weights of a converged run, to three decimals."""
    if model.iterations >= TIGHT["max_iter"]:
        raise RuntimeError("the run did not converge")
    return model.weights_frame(spark).select("j", r3("weight").alias("weight"))


def _rho_for(spark, sf_dir, rows_per_unit: float) -> float:
    """A penalty parameter near the curvature of a block's summed loss, which grows with
    the rows (few logistic rows are near the boundary, more of the hinge's are active)."""
    return fx.table(spark, sf_dir, "lineitem").count() / rows_per_unit


def q_admm_lr_l2(spark, sf_dir):
    from concord.plans.train import train_logistic
    return _optimum(train_logistic(fx.cls_small(spark, sf_dir), 3, lam=1.0, rho=_rho_for(spark, sf_dir, 3000.0), **TIGHT, **SOLVE), spark)


def q_admm_lr_l1(spark, sf_dir):
    from concord.plans.train import train_logistic
    return _optimum(train_logistic(fx.cls_small_sparse(spark, sf_dir), 3, lam=1.0, rho=_rho_for(spark, sf_dir, 3000.0), l1=True,
                                   **TIGHT, **SOLVE), spark)


def q_admm_lr_newton(spark, sf_dir):
    from concord.plans.train import train_logistic
    return _optimum(train_logistic(fx.cls_small(spark, sf_dir), 3, lam=0.1, rho=0.1, solver="newton", **TIGHT), spark)


def _tenth(spark, sf_dir) -> int:
    return -(-fx.table(spark, sf_dir, "lineitem").count() // 10)


def q_admm_lr_newton_split(spark, sf_dir):
    """Blocks solved in parts of at most a tenth of all rows: the model of the whole blocks."""
    from concord.plans.train import train_logistic
    m = train_logistic(fx.cls_small(spark, sf_dir), 3, lam=0.1, rho=0.04, solver="newton", max_block_rows=_tenth(spark, sf_dir), **TIGHT)
    if m.n_blocks <= 4:
        raise RuntimeError("no block was split")
    return _optimum(m, spark)


def q_admm_ridge_split(spark, sf_dir):
    """Ridge on packed rows (no Gram), blocks in parts: the closed form of the whole blocks."""
    from concord.plans.train import train_regression
    m = train_regression(fx.reg_small(spark, sf_dir), 2, lam=1.0, rho=0.5, gram_max_p=0, max_block_rows=_tenth(spark, sf_dir), **TIGHT)
    if m.n_blocks <= 4:
        raise RuntimeError("no block was split")
    return _optimum(m, spark)


WIDE_LAMBDA = 1e-4


def q_admm_lr_newton_wide(spark, sf_dir):
    """Newton by conjugate gradients at p = 4096, sparse rows: one weight per slot of the part key."""
    from concord.plans.train import train_logistic
    m = train_logistic(fx.cls_slots(spark, sf_dir), fx.HASH_WIDTH, lam=WIDE_LAMBDA, rho=WIDE_LAMBDA / 2, solver="newton", max_iter=300,
                       abs_tol=1e-8, rel_tol=1e-6, primal_only_stop=False)
    if m.iterations >= 300:
        raise RuntimeError("the run did not converge")
    return m.weights_frame(spark).select("j", rnd("weight", 2).alias("weight"))


def q_admm_lr_docs_newton(spark, sf_dir):
    """Newton by conjugate gradients on hashed texts (p = 4096).  SQL has no such hash, so the query
    checks the fit itself: every component of the objective's gradient, summed anew over all
    rows by the relational operator, is near 0."""
    import numpy as np

    from concord.plans.train import train_logistic
    rows = fx.cls_sparse(spark, sf_dir).persist()
    lam = 0.01
    m = train_logistic(rows, fx.HASH_WIDTH, lam=lam, rho=lam, solver="newton", max_iter=300, abs_tol=1e-7, rel_tol=1e-7, primal_only_stop=False)
    at = F.lit([float(v) for v in m.weights])
    state = rows.groupBy("block_id").agg(F.count(F.lit(1)).alias("n")).select("block_id", "n", at.alias("x"))
    sums = O.block_sums(rows, state, O._logistic).select("block_id", F.posexplode("s").alias("k", "g")).where("k > 0")
    mean = (sums.join(state.select("block_id", "n"), "block_id").groupBy("k").agg(F.sum(F.col("g") / F.col("n")).alias("g"))
            .select((F.col("g") + F.lit(2 * lam) * F.element_at(at, F.col("k"))).alias("g")))
    worst = mean.agg(F.max(F.abs("g")).alias("g")).first()["g"]
    out = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("label").cast("long").alias("n_good"))
    return out.select("n_rows", "n_good", F.lit(bool(worst < 1e-5 and np.abs(m.weights).max() > 1e-3)).alias("stationary"))


def q_admm_svm(spark, sf_dir):
    from concord.plans.train import train_svm
    return _optimum(train_svm(fx.cls_small(spark, sf_dir), 3, lam=1.0, rho=_rho_for(spark, sf_dir, 300.0), cee=CEE, **TIGHT, **SOLVE), spark)


def q_admm_svm_adaptive(spark, sf_dir):
    from concord.plans.train import train_svm
    return _optimum(train_svm(fx.cls_small(spark, sf_dir), 3, lam=1.0, rho=_rho_for(spark, sf_dir, 800.0), cee=CEE, l1=True,
                              adaptive_rho=True, **TIGHT, **SOLVE), spark)


def q_admm_custom_updater(spark, sf_dir):
    """A user's own block update and consensus step on the exported loop: the mean of the
    labels (p = 1), blocks weighted equally."""
    import numpy as np

    from concord.plans.admm import ADMMConfig, run_admm
    from concord.plans.train import place
    from concord.operators.solvers import unpack_block

    rows = fx.reg_small(spark, sf_dir).select("block_id", "label", F.array(F.lit(1.0)).alias("features"))

    def block_mean(payload, x, v, rho):
        _, b = unpack_block(payload, "dense", 1)
        return np.array([(b.mean() + rho * v[0]) / (1.0 + rho)])

    placed = place(rows, 1)
    try:
        res = run_admm(placed.payload, 1, block_mean, ADMMConfig(rho=1.0, max_iter=200, abs_tol=1e-10, rel_tol=1e-10,
                                                                primal_only_stop=False, z_update=lambda u, n, lam, rho: u / n))
    finally:
        placed.release()
    return spark.createDataFrame([(res.n_blocks, float(res.z[0]))], "n_blocks int, mean double").select("n_blocks", r6("mean").alias("mean"))


def q_admm_lr_docs(spark, sf_dir):
    from concord.plans.train import train_logistic
    rows = fx.cls_sparse(spark, sf_dir).persist(StorageLevel.DISK_ONLY)  # read twice, texts are hashed once
    try:
        return _weights(train_logistic(rows, fx.HASH_WIDTH, lam=1.0, rho=RHO, max_iter=100), spark)
    finally:
        rows.unpersist()


def q_admm_lr_wide_dense(spark, sf_dir):
    from concord.plans.train import train_logistic
    m = train_logistic(fx.cls_wide_dense(spark, sf_dir), 64, lam=1.0, rho=1.0, solver="newton", **TIGHT)
    return m.weights_frame(spark).select("j", rnd("weight", 4).alias("weight"))


def q_baseline_lr(spark, sf_dir):
    from concord.plans.baselines import baseline_logistic
    return baseline_logistic(fx.cls_small(spark, sf_dir), reg=2.0 / fx.table(spark, sf_dir, "lineitem").count(), tol=1e-14).select(
        "j", r3("weight").alias("weight"))


def q_baseline_svm(spark, sf_dir):
    from concord.plans.baselines import baseline_svm
    return baseline_svm(fx.cls_small(spark, sf_dir))


SGD = dict(iterations=40, step=1.0, lam=0.01, fraction=0.25, tol=0.0)


def q_baseline_svm_sgd(spark, sf_dir):
    """Mini-batch SGD on the hinge: forty steps over repeatable quarter samples of the rows."""
    from concord.plans.sgd import svm_sgd
    rows = fx.cls_small(spark, sf_dir)
    return _weights(svm_sgd(rows, 3, key=F.concat_ws("-", "l_orderkey", "l_linenumber"), **SGD), spark)


def q_baseline_linreg(spark, sf_dir):
    from concord.plans.baselines import baseline_linear_regression
    return baseline_linear_regression(fx.reg_small(spark, sf_dir), reg=0.1).select("j", r3("weight").alias("weight"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}
