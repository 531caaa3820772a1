"""Scoring and evaluation against Spark's own metrics classes and closed forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.operators import evaluate as E
from concord.plans import fixtures as fx

from conftest import SF_SMALL

W = [3.0, -2.0, 0.1]


@pytest.fixture(scope="module")
def scored(spark):
    return E.predict(fx.cls_small(spark, SF_SMALL), W, "logistic").cache()


def test_area_under_pr_matches_mllib(spark, scored):
    """Spark's own metric class (scores on a 0.01 grid: its Python entry point bins
    above ~1000 distinct scores, the exact form does not)."""
    from pyspark.mllib.evaluation import BinaryClassificationMetrics

    coarse = scored.withColumn("score", F.round("score", 2))
    ours = E.area_under_pr(coarse, n_ranges=7).first()["area_under_pr"]
    rdd = coarse.select("score", "label").rdd.map(lambda r: (float(r[0]), float(r[1])))
    assert ours == pytest.approx(BinaryClassificationMetrics(rdd).areaUnderPR, abs=1e-12)


def test_area_under_pr_exact_trapezoid(spark, scored):
    pdf = scored.select("score", "label").toPandas()
    g = pdf.groupby("score").label.agg(["sum", "count"]).sort_index(ascending=False)
    tp, n = g["sum"].cumsum().values, g["count"].cumsum().values
    rec = np.concatenate([[0.0], tp / pdf.label.sum()])
    prec = np.concatenate([[tp[0] / n[0]], tp / n])
    want = np.sum((rec[1:] - rec[:-1]) * (prec[1:] + prec[:-1]) / 2)
    assert E.area_under_pr(scored).first()["area_under_pr"] == pytest.approx(want, abs=1e-12)


def test_area_under_pr_independent_of_range_count(spark, scored):
    a = E.area_under_pr(scored, n_ranges=1).first()["area_under_pr"]
    b = E.area_under_pr(scored, n_ranges=64).first()["area_under_pr"]
    assert a == pytest.approx(b, abs=1e-12)


def test_hard_predictions_aupr_formula(spark, scored):
    hard = scored.withColumn("score", F.col("prediction"))
    ours = E.area_under_pr(hard).first()["area_under_pr"]
    pdf = scored.select("label", "prediction").toPandas()
    tp = ((pdf.prediction == 1) & (pdf.label == 1)).sum()
    precision = tp / (pdf.prediction == 1).sum()
    recall = tp / (pdf.label == 1).sum()
    base = (pdf.label == 1).mean()
    assert ours == pytest.approx(recall * precision + (1 - recall) * (precision + base) / 2, abs=1e-12)


def test_pr_curve_points(spark, scored):
    curve = E.pr_curve(scored).toPandas().sort_values("threshold", ascending=False)
    assert curve.recall.is_monotonic_increasing and curve.recall.iloc[-1] == pytest.approx(1.0)


def test_accuracy_and_predict_kinds(spark, scored):
    pdf = scored.select("label", "prediction").toPandas()
    assert E.accuracy(scored).first()["accuracy"] == pytest.approx((pdf.label == pdf.prediction).mean())
    svm = E.predict(fx.cls_small(spark, SF_SMALL), W, "svm").select("score", "prediction").toPandas()
    assert ((svm.score > 0) == (svm.prediction == 1)).all()


def test_regression_metrics(spark):
    df = fx.reg_small(spark, SF_SMALL)
    pred = E.predict(df, [3.0, -2.0], "regression")
    got = E.regression_metrics(pred).first()
    pdf = pred.select("label", "prediction").toPandas()
    sse = ((pdf.label - pdf.prediction) ** 2).sum()
    sst = ((pdf.label - pdf.label.mean()) ** 2).sum()
    assert got["mse"] == pytest.approx(sse / len(pdf)) and got["r2"] == pytest.approx(1 - sse / sst)


def test_sparse_scoring_equals_dense(spark):
    dense = E.predict(fx.cls_small(spark, SF_SMALL), W, "logistic").select("score").toPandas()
    sparse = E.predict(fx.cls_small_sparse(spark, SF_SMALL), W, "logistic", indices="indices",
                       values="values").select("score").toPandas()
    np.testing.assert_allclose(np.sort(dense.score.values), np.sort(sparse.score.values), atol=1e-15)


def test_no_positive_and_null_labels(spark):
    rows = spark.createDataFrame([(0.3, 0.0), (0.6, 0.0)], "score double, label double")
    assert E.area_under_pr(rows).first()[0] == 0.0
    assert [r["recall"] for r in E.pr_curve(rows).collect()] == [0.0, 0.0]
    with pytest.raises(Exception):
        E.area_under_pr(spark.createDataFrame([(0.3, None), (0.6, 1.0)], "score double, label double")).collect()


def test_curve_scans_its_input_once_and_runs_no_job_while_planned(spark, scratch):
    path = f"{scratch}/scored"
    E.predict(fx.cls_small(spark, SF_SMALL), W, "logistic").select("score", "label").write.parquet(path)
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    df = E.area_under_pr(spark.read.schema("score double, label double").parquet(path))
    assert set(tracker.getJobIdsForGroup(None)) == before
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1 and plan.count("ReusedExchange") >= 2


@pytest.mark.parametrize("kind", ["logistic", "svm", "regression"])
def test_wide_scores_equal_those_of_a_vector(spark, kind):
    rng = np.random.default_rng(3)
    w = rng.normal(size=12)
    rows = [(int(i % 7), [int(j) for j in sorted(rng.choice(14, k, replace=False))], [float(v) for v in rng.normal(size=k)])
            for i, k in enumerate([0, 1, 5, 5, 14, 3, 2, 2])]
    rows += [rows[3], (9, None, None)]  # a repeated row, a row without lists
    df = spark.createDataFrame(rows, "id int, indices array<int>, values array<double>")
    table = spark.createDataFrame([(j, float(v)) for j, v in enumerate(w)], "j int, weight double")  # no weight for 12 and 13
    got = sorted((r.id, round(r.score, 9), r.prediction) for r in E.predict_wide(df, table, kind).collect())
    margin = [sum(v * w[j] for j, v in zip(i or [], x or []) if j < 12) for _, i, x in rows]
    score = [1 / (1 + np.exp(-m)) if kind == "logistic" else m for m in margin]
    cut = {"logistic": 0.5, "svm": 0.0}.get(kind)
    want = sorted((r[0], round(s, 9), s if cut is None else float(s > cut)) for r, s in zip(rows, score))
    assert len(got) == len(want)
    for g, e in zip(got, want):
        assert g[0] == e[0] and g[1] == pytest.approx(e[1], abs=1e-8) and g[2] == pytest.approx(e[2], abs=1e-8)
    dense = spark.createDataFrame([(1, [float(v) for v in range(12)])], "id int, features array<double>")
    assert E.predict_wide(dense, table, kind, ["id"], features="features").first().score == pytest.approx(
        E.predict(dense, w, kind).first().score)
