"""Training tables derived from the driver's parquet tables, whole tables always.

The driver tables carry no usable signal (quantity, discount and price are
uncorrelated), so the regression / classification labels are planted from the row's
own columns.  Features are centred and scaled because the models have no intercept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.operators.blocks import block_of_key


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt over the session's parallelism, before CPU-heavy text work: a table
    of one row group is one task."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def feat_a() -> Column:
    return F.col("l_quantity") / 50.0 - 0.5


def feat_c() -> Column:
    return F.col("l_discount") * 10.0 - 0.5


def feat_t() -> Column:
    return F.col("l_tax") * 12.5 - 0.5


def planted() -> Column:
    """3a - 2c + (price / 1e5 - 0.5)."""
    return 3.0 * feat_a() - 2.0 * feat_c() + (F.col("l_extendedprice") / 1e5 - 0.5)


def reg_small(spark: SparkSession, sf_dir: str, n_blocks: int = 4) -> DataFrame:
    """Two features (a, c), planted real label, block = l_orderkey mod N."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber",
        block_of_key("l_orderkey", n_blocks).alias("block_id"),
        planted().alias("label"),
        F.array(feat_a(), feat_c()).alias("features"),
    )


def reg_lasso(spark: SparkSession, sf_dir: str, n_blocks: int = 4) -> DataFrame:
    """Three features (a, c, t); t has true weight 0."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber",
        block_of_key("l_orderkey", n_blocks).alias("block_id"),
        planted().alias("label"),
        F.array(feat_a(), feat_c(), feat_t()).alias("features"),
    )


def cls_small(spark: SparkSession, sf_dir: str, n_blocks: int = 4) -> DataFrame:
    """Features (a, c, t); label 1 when the planted score is positive."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber",
        block_of_key("l_orderkey", n_blocks).alias("block_id"),
        F.when(planted() > 0, 1.0).otherwise(0.0).alias("label"),
        F.array(feat_a(), feat_c(), feat_t()).alias("features"),
    )


def cls_small_sparse(spark: SparkSession, sf_dir: str, n_blocks: int = 4) -> DataFrame:
    """cls_small as sparse rows: zero features are not stored."""
    dense = cls_small(spark, sf_dir, n_blocks)
    pairs = F.filter(F.transform(F.col("features"), lambda v, i: F.struct(i.alias("i"), v.alias("v"))),
                     lambda e: e["v"] != 0.0)
    return dense.select("l_orderkey", "l_linenumber", "block_id", "label",
                        F.transform(pairs, lambda e: e["i"]).alias("indices"),
                        F.transform(pairs, lambda e: e["v"]).alias("values"))


def cls_wide_dense(spark: SparkSession, sf_dir: str, n_blocks: int = 4) -> DataFrame:
    """64 embedding values as doubles, label `label < 5` (no real signal: shape/speed)."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(
        "vec_id",
        block_of_key("vec_id", n_blocks).alias("block_id"),
        F.when(F.col("label") < 5, 1.0).otherwise(0.0).alias("label"),
        F.transform("embedding", lambda v: v.cast("double")).alias("features"),
    )


HASH_WIDTH = 4096


def cls_slots(spark: SparkSession, sf_dir: str, n_blocks: int = 4, width: int = HASH_WIDTH) -> DataFrame:
    """One stored value per row (1 + t) in the slot of its part key: wide, sparse, and separable
    by slot, so SQL can solve it slot by slot."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        block_of_key("l_orderkey", n_blocks).alias("block_id"),
        F.when(planted() > 0, 1.0).otherwise(0.0).alias("label"),
        F.array(F.pmod("l_partkey", F.lit(width)).cast("int")).alias("indices"),
        F.array(F.lit(1.0) + feat_t()).alias("values"),
    )


def cls_sparse(spark: SparkSession, sf_dir: str, n_blocks: int = 4, width: int = HASH_WIDTH) -> DataFrame:
    """documents joined to labels; lower-cased whitespace tokens hashed into `width`
    slots, counts as values (a wide sparse problem).  Whole texts are tokenised.

    A text's slots stay one array until they are counted, and its counts are moved as arrays, not as a row per token."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    tokens = F.filter(F.split(F.lower("text"), r"\s+"), lambda t: t != "")
    slots = (docs.join(labels, "doc_id")
             .select("doc_id", "quality", F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(width)).cast("int")).alias("j")))
    kinds = {f.name: f.dataType.simpleString() for f in slots.schema.fields}
    schema = f"doc_id {kinds['doc_id']}, quality {kinds['quality']}, j array<int>, v array<double>"
    parts = (slots.mapInArrow(slot_counts, schema).groupBy("doc_id", "quality").agg(F.collect_list(F.struct("j", "v")).alias("part"))
             .select("doc_id", "quality", F.flatten("part.j").alias("j"), F.flatten("part.v").alias("v")))
    return parts.mapInArrow(slot_sums, schema).select(
        "doc_id",
        block_of_key("doc_id", n_blocks).alias("block_id"),
        F.col("quality").cast("double").alias("label"),
        F.col("j").alias("indices"),
        F.transform("v", lambda v: F.log1p(v)).alias("values"),
    )


def _slots(rows: np.ndarray, j: pa.Array) -> tuple[np.ndarray, int]:
    """Every slot's key, ordered by its row's number and the slot, and the keys per row."""
    slot = j.flatten().to_numpy().astype(np.int64)
    width = int(slot.max()) + 1
    return np.repeat(rows * width, pc.list_value_length(j).to_numpy()) + slot, width


def _rows_of(batch: pa.RecordBatch, first: np.ndarray, keys: np.ndarray, width: int, v: np.ndarray) -> pa.RecordBatch:
    """Rows with the names of the rows ``first`` of ``batch``, from rising keys and their values."""
    ends = pa.array(np.searchsorted(keys, np.arange(len(first) + 1) * width), pa.int32())
    return pa.RecordBatch.from_arrays(
        [batch.column(c).take(pa.array(first)) for c in ("doc_id", "quality")]
        + [pa.ListArray.from_arrays(ends, pa.array(keys % width, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(v, pa.float64()))],
        names=["doc_id", "quality", "j", "v"])


def slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slots of texts -> each slot of a document and quality in order, and how often it occurs; texts without tokens go.  Rows of
    one document and quality are joined within a batch, so that what is left of a document that occurs very often is small."""
    for batch in batches:
        batch = batch.filter(pc.greater(pc.list_value_length(batch.column("j")), 0))  # a filter of the rows above would be pushed down and split every text again
        if not batch.num_rows:
            continue
        doc, quality = (pc.fill_null(pc.dictionary_encode(batch.column(c)).indices, -1).to_numpy().astype(np.int64) + 1 for c in ("doc_id", "quality"))
        _, first, row = np.unique(doc * (int(quality.max()) + 1) + quality, return_index=True, return_inverse=True)
        keys, width = _slots(row, batch.column("j"))
        found, times = np.unique(keys, return_counts=True)
        yield _rows_of(batch, first, found, width, times)


def slot_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts that were joined from several batches, added up by slot."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.arange(batch.num_rows)
        keys, width = _slots(rows, batch.column("j"))
        if np.all(keys[1:] > keys[:-1]):  # no document came from two batches
            yield batch
            continue
        found, at = np.unique(keys, return_inverse=True)
        yield _rows_of(batch, rows, found, width, np.bincount(at, weights=batch.column("v").flatten().to_numpy()))
