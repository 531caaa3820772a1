"""concord: consensus (ADMM) training of linear models on Spark DataFrames.

    from concord import load_libsvm, train_logistic, predict, area_under_pr
    rows, d = load_libsvm(spark, "hdfs:///data/train.libsvm")
    model = train_logistic(assign_blocks(rows, 64), d, lam=1.0, rho=2.0, l1=True)
    auc_pr = area_under_pr(predict(test, model.weights, "logistic", indices="indices", values="values"))
"""

from concord.operators.blocks import assign_blocks, block_sizes, blocks_for, split_hot_blocks
from concord.operators.evaluate import accuracy, area_under_pr, pr_curve, predict, predict_wide, regression_metrics
from concord.plans.admm import ADMMConfig, ADMMResult, LocalUpdate, ZUpdate, run_admm
from concord.plans.sgd import svm_sgd
from concord.plans.train import (
    LinearModel,
    Placed,
    check_binary_labels,
    fit_logistic,
    fit_regression,
    fit_svm,
    lambda_grid,
    place,
    prepare_regression,
    regularization_path,
    train_logistic,
    train_regression,
    train_svm,
)
from concord.sources.libsvm import (
    hash_split,
    load_data,
    load_datasets,
    load_dense_points,
    load_libsvm,
    load_libsvm_builtin,
    load_libsvm_lines,
    load_libsvm_tolerant,
)

__all__ = [
    "ADMMConfig", "ADMMResult", "LinearModel", "LocalUpdate", "Placed", "ZUpdate", "accuracy", "area_under_pr",
    "assign_blocks", "block_sizes", "blocks_for", "check_binary_labels", "fit_logistic", "fit_regression", "fit_svm",
    "hash_split", "lambda_grid", "load_data", "load_datasets", "load_dense_points", "load_libsvm",
    "load_libsvm_builtin", "load_libsvm_lines", "load_libsvm_tolerant", "place", "pr_curve", "predict",
    "predict_wide", "prepare_regression", "regression_metrics", "regularization_path", "run_admm", "split_hot_blocks",
    "svm_sgd", "train_logistic", "train_regression", "train_svm",
]
