"""Streaming use of the library.

The reference has no streaming operator.  Scoring with a fitted model is a pure
per-row projection (a dot product with a literal weight array, then a threshold),
so the same plan runs unchanged on a streaming DataFrame; ``score_stream`` is that
plan, and ``tests/test_streaming.py`` drives it from a parquet stream.
"""

from concord.streaming.scoring import score_stream

__all__ = ["score_stream"]
