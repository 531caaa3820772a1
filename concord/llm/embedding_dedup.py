"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Equal vectors of a label become one class first.  Unit vectors are rotated to principal
axes (fitted on a bounded sample; any rotation keeps every cosine) and dealt by label and by
buckets of the first axis: vectors with cosine >= t differ there by at most sqrt(2 - 2t), so
only equal and neighbouring buckets are compared.  Buckets are salted into tiles of bounded
size.  A pair of tiles accumulates products over the leading axes, bounds the rest by the
product of suffix norms, and goes on only with pairs that can still reach t; those are
decided by the full product in double precision.

A pair of tiles returns one row per linked vector (links and local component), never pairs,
so a group of near copies costs rows in proportion to its size.

Defined results: a vector that is null, empty, zero, holds null or non-finite values, or has
a null label or id links with nothing; vectors of different length do not link; repeated rows
link with each other as equal vectors; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import connected_components, materialise, prepare

TILE = 1024
SAMPLE = 4096
STEPS = (16, 48)  # leading axes accumulated before each bound


def principal_axes(sample: list[list[float]]) -> dict[int, np.ndarray]:
    """Per vector length, orthonormal axes by falling variance of the unit vectors."""
    axes = {}
    for d in sorted({len(v) for v in sample}):
        x = unit(np.array([v for v in sample if len(v) == d], np.float64))
        axes[d] = np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()
    return axes


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, without overflow for very large values."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def linked_pairs(x: np.ndarray, y: np.ndarray, axes: np.ndarray, threshold: float, same: bool):
    """Row numbers (i, j) of all pairs with cosine >= threshold; for one tile against
    itself, i < j.  ``x`` and ``y`` are unit vectors."""
    d = x.shape[1]
    a, b = x @ axes, y @ axes
    cuts = [c for c in STEPS if c < d]
    slack = 1e-9
    found_i, found_j = [], []
    for lo in range(0, len(a), 256):
        part = a[lo:lo + 256]
        first = cuts[0] if cuts else d
        dots = part[:, :first] @ b[:, :first].T
        rest_a = np.sqrt(np.maximum((part[:, first:] ** 2).sum(axis=1), 0))
        rest_b = np.sqrt(np.maximum((b[:, first:] ** 2).sum(axis=1), 0))
        i, j = np.nonzero(dots + rest_a[:, None] * rest_b[None, :] >= threshold - slack)
        if same:
            keep = i + lo < j
            i, j = i[keep], j[keep]
        dot = dots[i, j]
        for at, stop in zip(cuts, [*cuts[1:], d]):
            if not len(i):
                break
            dot = dot + np.concatenate([np.einsum("ij,ij->i", part[i[k:k + 8192], at:stop], b[j[k:k + 8192], at:stop])
                                        for k in range(0, len(i), 8192)])
            if stop < d:
                rest_a = np.sqrt((part[:, stop:] ** 2).sum(axis=1))
                rest_b = np.sqrt((b[:, stop:] ** 2).sum(axis=1))
                keep = dot + rest_a[i] * rest_b[j] >= threshold - slack
                i, j, dot = i[keep], j[keep], dot[keep]
        close = dot >= threshold - slack
        i, j = i[close] + lo, j[close]
        for k in range(0, len(i), 8192):  # the deciding product, on the vectors as given
            exact = np.einsum("ij,ij->i", x[i[k:k + 8192]], y[j[k:k + 8192]]) >= threshold
            found_i.append(i[k:k + 8192][exact])
            found_j.append(j[k:k + 8192][exact])
    none = np.zeros(0, np.int64)
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (none, none)


def smallest_reachable(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest node reachable from each of n nodes over edges (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def link_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                 threshold: float = 0.93) -> DataFrame:
    """(id, n_links, component_id, kept) per row."""
    spark = df.sparkSession
    prepare(spark)
    own = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"),
                    F.col(vec_col).cast("array<double>").alias("vec"))
    usable = (F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull()
              & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
              & F.exists("vec", lambda v: v != 0))
    ck = F.md5(F.concat(F.col("label").cast("string"), F.lit(":"), F.array_join(F.col("vec").cast("array<string>"), ",")))
    own = own.withColumn("ck", F.when(F.coalesce(usable, F.lit(False)), ck))
    classes = materialise(own.where("ck is not null").groupBy("ck").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("mult"), F.first("label").alias("label"), F.first("vec").alias("vec")))
    # about SAMPLE vectors, which fit the axes only
    sample = classes.select("vec").sample(False, min(1.0, SAMPLE / max(classes.count(), 1)), seed=23).collect()
    axes = spark.sparkContext.broadcast(principal_axes([r["vec"] for r in sample]))
    width = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6

    def place(batches):
        for batch in batches:
            rows = batch.column("vec").to_pylist()
            dims = np.array([len(v) for v in rows])
            bucket, blob = np.zeros(len(rows), np.int64), [b""] * len(rows)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                u = unit(np.array([rows[k] for k in at], np.float64))
                lead = axes.value.get(int(d))
                first = u @ lead[:, 0] if lead is not None else u[:, 0]
                bucket[at] = np.floor(first / width).astype(np.int64)
                for k, v in zip(at, u):
                    blob[k] = v.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("ck"), batch.column("mult"), batch.column("label"), pa.array(dims, pa.int32()),
                 pa.array(bucket), pa.array(blob, pa.binary())], names=["ck", "mult", "label", "dim", "bucket", "unit"])

    label_type = classes.schema["label"].dataType.simpleString()
    placed = materialise(classes.select("ck", "mult", "label", "vec").mapInArrow(
        place, f"ck string, mult long, label {label_type}, dim int, bucket long, unit binary"))
    home = ["label", "dim", "bucket"]
    salts = materialise(placed.groupBy(*home).agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE)).cast("int").alias("salts")))
    tiled = (placed.join(salts, home).withColumn("salt", F.pmod(F.xxhash64("ck"), F.col("salts")).cast("int"))
             .withColumn("tile", F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in home], F.col("salt").cast("string")))))

    def bundle(table: pa.Table) -> pa.Table:
        return pa.table({"tile": table.column("tile").slice(0, 1), "dim": table.column("dim").slice(0, 1),
                         "cks": pa.array([table.column("ck").to_pylist()], pa.list_(pa.string())),
                         "mults": pa.array([table.column("mult").to_pylist()], pa.list_(pa.int64())),
                         "units": pa.array([b"".join(table.column("unit").to_pylist())], pa.binary())})

    tiles = materialise(tiled.select("tile", "dim", "ck", "mult", "unit").groupBy("tile").applyInArrow(
        bundle, "tile string, dim int, cks array<string>, mults array<long>, units binary"))
    # the list of tile pairs holds names only; vectors follow by a join on the tile
    index = (salts.select(*home, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
             .withColumn("tile", F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in home], F.col("salt").cast("string")))))
    right = index.select(*home, F.col("salt").alias("salt2"), F.col("tile").alias("tile2"))
    reach = index.withColumn("to", F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)))
    pairs = (reach.select("label", "dim", F.col("to").alias("bucket"), F.col("bucket").alias("from"), "salt", "tile")
             .join(right, home).where((F.col("from") != F.col("bucket")) | (F.col("salt") <= F.col("salt2")))
             .select(F.md5(F.concat("tile", F.lit("|"), "tile2")).alias("pair"), "tile", "tile2"))
    sides = pairs.select("pair", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("tile").alias("tile")),
        F.struct(F.lit(1).alias("side"), F.col("tile2").alias("tile")))).alias("s")).select("pair", "s.side", "s.tile")

    def compare(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["side"])
        a, b = rows[0], rows[-1]
        d = a["dim"]
        x = np.frombuffer(a["units"], np.float64).reshape(-1, d)
        y = np.frombuffer(b["units"], np.float64).reshape(-1, d)
        same = a["tile"] == b["tile"]
        lead = axes.value.get(d)
        i, j = linked_pairs(x, y, np.eye(d) if lead is None else lead, threshold, same)
        names = np.array(a["cks"] if same else [*a["cks"], *b["cks"]], object)
        mult = np.array(a["mults"] if same else [*a["mults"], *b["mults"]], np.int64)
        j = j if same else j + len(x)
        links = np.bincount(i, mult[j], len(names)) + np.bincount(j, mult[i], len(names))
        hit = np.flatnonzero(links)
        root = smallest_reachable(len(names), i, j)
        return pa.table({"ck": pa.array(names[hit].tolist(), pa.string()), "n": pa.array(links[hit].astype(np.int64)),
                         "root": pa.array(names[root[hit]].tolist(), pa.string())})

    partial = materialise(sides.join(tiles, "tile").groupBy("pair").applyInArrow(compare, "ck string, n long, root string"))
    links = partial.groupBy("ck").agg(F.sum("n").alias("n"))
    comp = connected_components(partial.select(F.col("ck").alias("a"), F.col("root").alias("b")))
    named = (classes.select("ck", "rep", "mult").join(links, "ck", "left")
             .join(comp.withColumnRenamed("node", "ck"), "ck", "left")
             .withColumn("component", F.coalesce("component", "ck")))
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    found = materialise(named.join(smallest, "component").select("ck", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n"), "component_id"))
    return (own.select("id", "ck").join(found, "ck", "left")
            .select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "id").alias("component_id"),
                    F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(True)).alias("kept")))


ORACLE = r"""
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach(id, other) AS (
  SELECT a, b FROM links
  UNION
  SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other),
comp AS (SELECT id, least(id, min(other)) AS component_id FROM reach GROUP BY id),
degree AS (SELECT a AS id, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, e.vec_id) AS component_id,
       e.vec_id = coalesce(component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN comp ON comp.id = e.vec_id LEFT JOIN degree ON degree.id = e.vec_id"""
