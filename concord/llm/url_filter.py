"""URL filters: a trie over reversed host labels, then path segments, is broadcast; the
deepest matching entry decides, so a longer block entry beats a shorter allow entry and
the other way round.

Defined results: a null url, or one without ``://``, has empty host and path; no entry
fits it and it takes the default verdict, as does an empty host.  Two entries for the same
(host, path) are refused.  Repeated rows are judged one by one; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from concord.llm.common import packed_row, prepare

#: entries above this are refused: the trie is broadcast, so its size must be bounded
MAX_RULES = 2_000_000


def host_of(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1),
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def build_trie(rules: list[tuple[str, str, str]]) -> dict:
    """Trie of ``(verdict, host, path)`` entries.

    Host level: one node per label, from the right.  Each host node holds a path trie over
    whole segments; an entry's last, possibly partial, segment is kept in ``tails`` of the
    node that holds the segments before it, longest first."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} entries exceed the broadcast bound of {MAX_RULES}")
    root: dict = {"next": {}, "paths": None}
    seen = set()
    for verdict, host, path in rules:
        if (host, path) in seen:
            raise ValueError(f"two entries for {host}{path}")
        seen.add((host, path))
        node = root
        for label in reversed(host.split(".")):
            node = node["next"].setdefault(label, {"next": {}, "paths": None})
        if node["paths"] is None:
            node["paths"] = {"next": {}, "tails": []}
        segments, at = path.split("/"), node["paths"]
        for segment in segments[:-1]:
            at = at["next"].setdefault(segment, {"next": {}, "tails": []})
        at["tails"].append((segments[-1], host + path, verdict))
        at["tails"].sort(key=lambda x: -len(x[0]))
    return root


def longest_match(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """(entry, verdict) of the longest entry fitting host and path: the most host labels
    first, then the longest path prefix."""
    best, node = None, trie
    for label in reversed(host.split(".")):
        node = node["next"].get(label)
        if node is None:
            break
        if node["paths"] is not None:
            best = _longest_path(node["paths"], path) or best
    return best


def _longest_path(at: dict, path: str) -> tuple[str, str] | None:
    best, rest = None, path.split("/")
    for segment in rest:
        for tail, entry, verdict in at["tails"]:
            if segment.startswith(tail):
                best = (entry, verdict)
                break
        at = at["next"].get(segment)
        if at is None:
            break
    return best


def judge_urls(df: DataFrame, rules: list[tuple[str, str, str]], url: str = "url",
               default: str = "allow") -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` (null when none fits) and ``verdict`` added;
    columns of those names are replaced."""
    spark = df.sparkSession
    prepare(spark)
    trie = spark.sparkContext.broadcast(build_trie(rules))
    new = {"host", "path", "rule", "verdict"}
    src = df.select(packed_row(df, new).alias("row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    schema = StructType([*src.schema.fields, StructField("rule", StringType()), StructField("verdict", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = trie.value
        for batch in batches:
            found = [longest_match(tree, h, p) for h, p in
                     zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f and f[0] for f in found], pa.string()),
                 pa.array([f[1] if f else default for f in found], pa.string())],
                names=["row", "host", "path", "rule", "verdict"])

    return src.mapInArrow(run, schema).select("row.*", "host", "path", "rule", "verdict")
