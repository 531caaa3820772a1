"""Helpers shared by the corpus operators: scratch tables, Arrow plumbing, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.session import delete_path, ensure_importable, scratch_path


#: bytes of an Arrow batch between the JVM and a Python worker: whole texts are long, and several
#: batches of a task are in memory at a time.  A setting of the session's own stays.
ARROW_BYTES, ARROW_KEY = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> None:
    """Ship the package to the Python workers (checkpoint folder included), and bound the
    bytes of an Arrow batch."""
    ensure_importable(spark)
    if not spark.sparkContext.getConf().contains(ARROW_KEY):
        spark.conf.set(ARROW_KEY, str(ARROW_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives the
    loss of any executor, and lets a table that is used twice be computed once."""
    spark = df.sparkSession
    path = scratch_path(spark, "concord-llm")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._concord_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of materialised tables that are no longer read."""
    for df in frames:
        path = getattr(df, "_concord_path", None)
        if path:
            delete_path(df.sparkSession, path)
            df._concord_path = None


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch into runs of rows whose ``column`` holds about ``max_bytes``
    bytes (a single longer text is a run of its own), so work arrays stay bounded."""
    import numpy as np
    import pyarrow.compute as pc

    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def utf8_parts(column: pa.Array):
    """(bytes as uint8 array, int64 offsets of length n+1) of a string column, null as
    empty, without copying."""
    import numpy as np

    if pa.types.is_large_string(column.type):
        width = np.int64
    else:
        width = np.int32
    n = len(column)
    if column.null_count:
        column = column.fill_null("")
    bufs = column.buffers()
    if n == 0 or bufs[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(bufs[1], width, n + 1 + column.offset)[column.offset:].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def with_nulls_as_empty(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), F.lit("")))


def packed_row(df: DataFrame, without: set[str] = frozenset()) -> Column:
    """The columns of ``df`` as one struct, so that a Python stage can pass them on whatever
    their names are; ``without`` names columns (lower case) that are about to be replaced."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in without])


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not use (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    name, k = stem, 0
    while name.lower() in taken:
        k += 1
        name = f"{stem}_{k}"
    return name


#: edges that a task contracts at a time
CONTRACT_EDGES = 500_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of a partition as stars around the smallest node of each local
    component; work memory is bounded by eight times CONTRACT_EDGES nodes, which the edges
    of one task do not reach unless it was given more than its share."""
    parent: dict = {}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def stars(schema):
        rows = [(u, find(u)) for u in parent]
        rows = [(u, v) for u, v in rows if u != v]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], schema.field(k).type) for k in (0, 1)], schema=schema)

    schema = None
    for batch in batches:
        schema = batch.schema
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            u, v = find(u), find(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
        if len(parent) > 8 * CONTRACT_EDGES:
            yield stars(schema)
    if parent:
        yield stars(schema)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its smallest node.

    Every task first contracts about CONTRACT_EDGES edges to stars; unless one task saw all
    edges, alternating large-star and small-star rounds join stars across tasks.  A round is a minimum per node (combined
    map-side) and an equi-join back, so a hub's edges are never gathered in one task.
    Edges are written to the shared folder each round; only their count and checksum reach
    the driver.  Null ends are ignored; self-loops only make their node known.
    """
    e = materialise(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null"))
    kind = e.schema["u"].dataType.simpleString()

    def stamp(df):
        r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    def contracted(df, n):
        """(stars, whether one task saw all edges): about CONTRACT_EDGES edges a task."""
        tasks = max(1, -(-n // CONTRACT_EDGES))
        return materialise(df.where("u > v").coalesce(tasks).mapInArrow(_contract, f"u {kind}, v {kind}")), tasks == 1

    cur, whole = contracted(e, stamp(e)[0])
    loops = e.where("u = v").select("u")
    for _ in range(max_rounds):
        if whole:  # its stars are the components
            break
        last = stamp(cur)
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v"))
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low2, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low2.select("u", F.col("m").alias("v"))).distinct())
        nxt = materialise(small)
        discard(cur)
        cur = nxt
        now = stamp(cur)
        if now == last:
            break
        cur, whole = contracted(nxt, now[0])
        discard(nxt)
    else:
        raise RuntimeError("connected components did not converge")
    star = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component"))
    alone = loops.select(F.col("u").alias("node"), F.col("u").alias("component"))
    return star.union(roots).union(alone).groupBy("node").agg(F.min("component").alias("component"))


def give_back() -> None:
    """Return freed memory to the system at the end of a task: Python workers are reused, and what they keep
    adds to the executor's memory while the JVM works."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable:
    """mapInArrow function applying ``fn`` to each non-empty batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return run
