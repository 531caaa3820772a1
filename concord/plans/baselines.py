"""The library twins the ADMM trainers are compared with: Spark ML's logistic
regression (L-BFGS), linear SVM (hinge) and elastic-net linear regression.

Output is the ``(j, weight)`` table; the fitted intercept is kept as ``j = -1``
(scoring with coefficients alone would drop it).
"""

from __future__ import annotations

from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _ml_input(df: DataFrame) -> DataFrame:
    return df.select(F.col("label").cast("double").alias("label"), array_to_vector("features").alias("features"))


def _coef_frame(df: DataFrame, coefficients, intercept: float) -> DataFrame:
    spark = df.sparkSession
    rows = [(int(j), float(w)) for j, w in enumerate(coefficients.toArray())] + [(-1, float(intercept))]
    return spark.createDataFrame(rows, "j int, weight double").select("j", (F.round("weight", 6) + 0.0).alias("weight"))


def baseline_logistic(df: DataFrame, reg: float = 0.0, elastic_net: float = 0.0, max_iter: int = 100,
                      fit_intercept: bool = False, tol: float = 1e-6) -> DataFrame:
    model = LogisticRegression(regParam=reg, elasticNetParam=elastic_net, maxIter=max_iter, tol=tol,
                               fitIntercept=fit_intercept, standardization=False).fit(_ml_input(df))
    return _coef_frame(df, model.coefficients, model.intercept)


def baseline_svm(df: DataFrame, reg: float = 0.1, max_iter: int = 100, fit_intercept: bool = False) -> DataFrame:
    model = LinearSVC(regParam=reg, maxIter=max_iter, fitIntercept=fit_intercept,
                      standardization=False).fit(_ml_input(df))
    return _coef_frame(df, model.coefficients, model.intercept)


def baseline_linear_regression(df: DataFrame, reg: float = 1.0, elastic_net: float = 1.0, max_iter: int = 100,
                               fit_intercept: bool = True) -> DataFrame:
    model = LinearRegression(regParam=reg, elasticNetParam=elastic_net, maxIter=max_iter,
                             fitIntercept=fit_intercept, standardization=False).fit(_ml_input(df))
    return _coef_frame(df, model.coefficients, model.intercept)
