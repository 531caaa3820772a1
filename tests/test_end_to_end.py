"""The README's usage, end to end on files: LIBSVM text -> load -> row-hash blocks ->
train -> load the test file at the model's width -> score -> AUPR."""

import os

from concord import area_under_pr, assign_blocks, load_libsvm, predict, train_logistic
from concord.plans.queries import libsvm_text

from conftest import SF_SMALL


def test_readme_flow(spark, scratch):
    path = os.path.join(scratch, "train")
    libsvm_text(spark, SF_SMALL).select("value").write.text(path)
    rows, d = load_libsvm(spark, path)
    assert d == 3
    model = train_logistic(assign_blocks(rows, 3), d, lam=1.0, rho=2.0, l1=True, max_iter=15)
    assert model.n_blocks == 3 and model.iterations >= 1
    test, _ = load_libsvm(spark, path, num_features=d)
    aupr = area_under_pr(predict(test, model.weights, "logistic", indices="indices", values="values")).first()[0]
    base_rate = test.agg({"label": "avg"}).first()[0]  # AUPR of an uninformative score
    assert base_rate + 0.2 < aupr <= 1.0
