"""Score a streaming DataFrame with a fitted linear model (stateless projection)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from concord.operators.evaluate import predict


def score_stream(stream: DataFrame, model, features: str = "features", indices: str | None = None,
                 values: str | None = None) -> DataFrame:
    """``stream`` (``readStream``) -> stream with ``score`` and ``prediction`` columns.

    ``model`` is a ``LinearModel`` or a ``(weights, kind)`` pair."""
    weights, kind = (model.weights, model.kind) if hasattr(model, "weights") else model
    return predict(stream, weights, kind, features=features, indices=indices, values=values)
