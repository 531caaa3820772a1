"""Scoring and evaluation: predict, accuracy, precision-recall curve and its area,
regression fit (MSE, R^2).

All of it is DataFrame aggregation.  The PR curve needs running sums over scores in
descending order; instead of one global window (which would put every distinct score
in one task), distinct scores are cut into ranges by quantile bounds, each range is
summed, the few range totals are prefix-summed, and each range adds its offset: every
window task handles one range.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concord.functions.losses import sigmoid
from concord.functions.vectors import dense_dot, sparse_dot
from concord.session import ensure_checkpoint_dir


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Put the columns of a one-row aggregate next to every row: a broadcast hash join
    on a constant key (a single build row), not a cartesian product."""
    k = "__one__"
    return df.withColumn(k, F.lit(0)).join(F.broadcast(one_row.withColumn(k, F.lit(0))), k).drop(k)


def weights_literal(weights: Sequence[float] | np.ndarray) -> Column:
    """The model as one array literal (a single plan node, shipped with the task)."""
    return F.lit([float(w) + 0.0 for w in np.asarray(weights, dtype=float)]).cast("array<double>")


def linear_score(weights, features: str = "features", indices: str | None = None, values: str | None = None) -> Column:
    """w . x for dense ``features`` or sparse ``indices``/``values`` (intercept 0)."""
    w = weights_literal(weights)
    if indices is not None:
        return sparse_dot(indices, values, w)
    return dense_dot(F.col(features), w)


def predict(df: DataFrame, weights, kind: str, features: str = "features", indices: str | None = None,
            values: str | None = None) -> DataFrame:
    """Adds ``score`` and ``prediction``.

    logistic: score = sigmoid(w.x), prediction = score > 0.5
    svm:      score = w.x,          prediction = score > 0
    regression: score = prediction = w.x
    """
    return _scored(df, linear_score(weights, features, indices, values), kind)


def _scored(df: DataFrame, margin: Column, kind: str) -> DataFrame:
    if kind == "logistic":
        out = df.withColumn("score", sigmoid(margin))
        return out.withColumn("prediction", F.when(F.col("score") > 0.5, 1.0).otherwise(0.0))
    if kind == "svm":
        out = df.withColumn("score", margin)
        return out.withColumn("prediction", F.when(F.col("score") > 0.0, 1.0).otherwise(0.0))
    if kind == "regression":
        return df.withColumn("score", margin).withColumn("prediction", F.col("score"))
    raise ValueError(f"unknown model kind {kind!r}")


def wide_margin(df: DataFrame, weights: DataFrame, key: Sequence[str] | None = None, indices: str = "indices",
                values: str = "values", features: str | None = None) -> DataFrame:
    """``df`` with ``margin`` = w . x, for models too wide for a plan or a task: ``weights`` is a table (j, weight).

    Rows become (key, j, value), meet their weights by an equi-join on j and are summed per key, so neither the model nor a
    feature is held whole anywhere; adaptive execution broadcasts a small weight table and splits the join of a
    feature that very many rows have.  ``key`` names columns that tell all rows apart; without it rows are numbered by their
    place, written once to the checkpoint folder.  Features without a weight, and rows without stored values, add 0."""
    if key is None:
        ensure_checkpoint_dir(df.sparkSession)
        place = "__row__"
        numbered = df.withColumn(place, F.monotonically_increasing_id()).checkpoint()
        return wide_margin(numbered, weights, [place], indices, values, features).drop(place)
    if features is not None:
        stored = df.select(*key, F.posexplode(features).alias("j", "v"))
    else:
        stored = (df.select(*key, F.explode(F.arrays_zip(F.col(indices).alias("j"), F.col(values).alias("v"))).alias("e"))
                  .select(*key, F.col("e.j").alias("j"), F.col("e.v").alias("v")))
    products = (stored.where("v <> 0.0").join(weights.select("j", "weight"), "j")
                .groupBy(*key).agg(F.sum(F.col("v") * F.col("weight")).alias("margin")))
    out = df.join(products, list(key), "left")
    return out.withColumn("margin", F.coalesce("margin", F.lit(0.0)))


def predict_wide(df: DataFrame, weights: DataFrame, kind: str, key: Sequence[str] | None = None, indices: str = "indices",
                 values: str = "values", features: str | None = None) -> DataFrame:
    """``predict`` with a weight table (j, weight) instead of a vector on the driver."""
    return _scored(wide_margin(df, weights, key, indices, values, features), F.col("margin"), kind).drop("margin")


def accuracy(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Share of rows whose prediction equals the label (one row: n, accuracy)."""
    hit = (F.col(prediction) == F.col(label)).cast("double")
    return pred.agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"))


def confusion_by_score(pred: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Positives and negatives per distinct score (score first, label second).  A null
    label or score fails the job."""
    null = F.col(label).isNull() | F.col(score).isNull()
    pos = F.when(null, F.raise_error(F.lit("a scored row has a null label or score")).cast("long")).otherwise((F.col(label) > 0.5).cast("long"))
    return pred.groupBy(F.col(score).alias("score")).agg(F.sum(pos).alias("tp"), F.count(F.lit(1)).alias("n")) \
        .select("score", "tp", (F.col("n") - F.col("tp")).alias("fp"))


def cumulative_by_score(conf: DataFrame, n_ranges: int = 64) -> DataFrame:
    """Running totals of tp/fp over scores in descending order, and all positives ``P``,
    without a global window.

    Scores are cut into ranges at approximate quantiles of the distinct scores -- a
    one-row aggregate of the same plan, so no job runs while the plan is built; range
    totals (n_ranges rows) are prefix-summed and each range adds its offset to its own
    window.  The aggregation by score is shuffled once and reused by all three."""
    probs = [k / n_ranges for k in range(1, n_ranges)] or [0.5]
    # every use reads all columns of conf, so that its shuffle is one and the same
    held = F.when(F.col("tp") + F.col("fp") > 0, F.col("score").cast("double"))
    bounds = conf.agg(F.percentile_approx(held, probs, 10_000).alias("bounds"), F.sum("tp").alias("P"))
    # the range is a function of the score alone: the number of bounds above it
    above = F.size(F.filter("bounds", lambda b: b > F.col("score").cast("double"))) if n_ranges > 1 else F.lit(0)
    ranged = attach(conf, bounds).withColumn("rng", above).drop("bounds")
    totals = ranged.groupBy("rng").agg(F.sum("tp").alias("rtp"), F.sum("fp").alias("rfp"))
    w_tot = Window.orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)  # over n_ranges rows
    offsets = totals.select("rng", F.coalesce(F.sum("rtp").over(w_tot), F.lit(0)).alias("otp"),
                            F.coalesce(F.sum("rfp").over(w_tot), F.lit(0)).alias("ofp"))
    w_in = Window.partitionBy("rng").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    within = ranged.select("rng", "score", "tp", "fp", "P", F.sum("tp").over(w_in).alias("ctp"), F.sum("fp").over(w_in).alias("cfp"))
    return (within.join(F.broadcast(offsets), "rng")  # n_ranges rows
                  .select("score", "tp", "fp", "P", (F.col("ctp") + F.col("otp")).alias("cum_tp"),
                          (F.col("cfp") + F.col("ofp")).alias("cum_fp")))


def pr_curve(pred: DataFrame, score: str = "score", label: str = "label", n_ranges: int = 64) -> DataFrame:
    """(threshold, recall, precision) per distinct score; recall is 0 without positives."""
    return cumulative_by_score(confusion_by_score(pred, score, label), n_ranges).select(
        F.col("score").alias("threshold"),
        F.when(F.col("P") == 0, F.lit(0.0)).otherwise(F.try_divide("cum_tp", "P")).alias("recall"),
        (F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp"))).alias("precision"),
    )


def area_under_pr(pred: DataFrame, score: str = "score", label: str = "label", n_ranges: int = 64) -> DataFrame:
    """Trapezoid area under the PR curve with the point (0, first precision) prepended; 0
    without positives, null without rows.

    Each point's segment needs only its own running totals: the previous point is the
    running total minus this score's counts, so no lag over a global order is needed.
    """
    cum = cumulative_by_score(confusion_by_score(pred, score, label), n_ranges)
    prev_tp = F.col("cum_tp") - F.col("tp")
    prev_n = F.col("cum_tp") + F.col("cum_fp") - F.col("tp") - F.col("fp")
    prec = F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp"))
    prev_prec = F.when(prev_n == 0, prec).otherwise(F.try_divide(prev_tp, prev_n))
    step = F.coalesce(F.try_divide("tp", "P"), F.lit(0.0))
    return cum.agg(F.sum(step * (prec + prev_prec) / 2.0).alias("area_under_pr"))


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """n, mean label, SST, SSE, MSE = SSE/n, R^2 = 1 - SSE/SST (two-level aggregate)."""
    y, yhat = F.col(label), F.col(prediction)
    first = pred.agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean_label"))
    joined = attach(pred, first)
    err = y - yhat
    dev = y - F.col("mean_label")
    agg = joined.groupBy("n", "mean_label").agg(F.sum(dev * dev).alias("sst"), F.sum(err * err).alias("sse"))
    return agg.select("n", "mean_label", "sst", "sse", (F.col("sse") / F.col("n")).alias("mse"),
                      (F.lit(1.0) - F.col("sse") / F.col("sst")).alias("r2"))
