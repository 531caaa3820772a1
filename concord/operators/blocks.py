"""Block assignment, splitting of hot blocks and input checks.

Blocks are data, not layout: every row carries an explicit ``block_id``.  Ids come from
a key, or from the row's place in its source; place-based ids are written to the
checkpoint folder before they are used, because a second evaluation of the same frame
may order its rows differently.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType
from pyspark.sql.window import Window

from concord.session import ensure_checkpoint_dir

#: Rows of a block are one Python task's input: blocks are sized for this many bytes, and a block
#: with more of them is split before training, whatever its number of rows.
BLOCK_BYTES = 32 << 20


def block_of_key(key: str | Column, n_blocks: int) -> Column:
    """Repeatable block number ``pmod(key, N)`` for an integer key (need not be unique)."""
    k = F.col(key) if isinstance(key, str) else key
    return F.pmod(k, F.lit(int(n_blocks))).cast("int")


def _by_place(parts: Column) -> Column:
    """A hash of the row's place, below ``parts``: spreads identical copies evenly
    (content hashing would keep them together)."""
    return F.pmod(F.xxhash64(F.monotonically_increasing_id()), parts).cast("int")


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row's values: 8 per number, the length of text and binary values, the sum over an array."""
    total = F.lit(0).cast("long")
    for f in df.schema.fields:
        col, kind = F.col(f"`{f.name}`"), f.dataType
        if isinstance(kind, ArrayType):
            size = F.size(col) * 8 if not isinstance(kind.elementType, (StringType, BinaryType)) else \
                F.aggregate(col, F.lit(0).cast("long"), lambda a, v: a + F.coalesce(F.octet_length(v), F.lit(0)))
        elif isinstance(kind, (StringType, BinaryType)):
            size = F.octet_length(col)
        else:
            size = F.lit(8)
        total = total + F.greatest(F.coalesce(size, F.lit(0)), F.lit(0))
    return total


def blocks_for(df: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks of about ``block_bytes`` each, from the bytes of the rows (one aggregate): the
    optimizer's estimate of a joined or filtered input may be far from them."""
    size = df.agg(F.sum(row_bytes(df)).alias("b")).first()["b"] or 0
    return max(1, -(-int(size) // block_bytes))


def assign_blocks(df: DataFrame, n_blocks: int | None = None, key: str | Column | None = None) -> DataFrame:
    """Add ``block_id``: ``pmod(key, N)`` when a key is given, else a hash of the row's
    place, written once to the checkpoint folder so that every later evaluation reads
    the same ids.  Without ``n_blocks`` the input's bytes decide it."""
    n = blocks_for(df) if n_blocks is None else n_blocks
    if n < 1:
        raise ValueError("n_blocks must be >= 1")
    if key is not None:
        return df.withColumn("block_id", block_of_key(key, n))
    ensure_checkpoint_dir(df.sparkSession)
    return df.withColumn("block_id", _by_place(F.lit(int(n)))).checkpoint()


def block_sizes(df: DataFrame) -> DataFrame:
    """Rows per block: one small aggregate (N output rows)."""
    return df.groupBy("block_id").agg(F.count(F.lit(1)).alias("n_rows"))


def split_hot_blocks(df: DataFrame, max_rows: int) -> DataFrame:
    """Split any block holding more than ``max_rows`` rows into equal hashed sub-blocks
    and renumber densely.  Costs one N-row aggregate; the result is written to the
    checkpoint folder.  A row whose block the aggregate did not see, or without a
    block, fails the job: no row is dropped."""
    ensure_checkpoint_dir(df.sparkSession)
    sizes = block_sizes(df).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("n_rows") / F.lit(max_rows))).cast("int"))
    w = Window.orderBy("block_id")  # over N rows only
    sizes = sizes.withColumn("base", (F.sum("parts").over(w) - F.col("parts")).cast("int"))
    placed = df.withColumn("__place__", F.xxhash64(F.monotonically_increasing_id()))
    # one row per block: sent to the rows, which would otherwise meet in one task per block
    joined = placed.join(F.broadcast(sizes.select("block_id", "parts", "base")), "block_id", "left")
    block = F.when(F.col("parts").isNull(), F.raise_error(F.lit("a row has no block, or one that was not counted")).cast("int")) \
        .otherwise(F.col("base") + F.pmod("__place__", F.col("parts")).cast("int"))
    return joined.withColumn("block_id", block.cast("int")).drop("parts", "base", "__place__").checkpoint()


class Checked(NamedTuple):
    """What ``check_rows`` counted: rows, blocks, and rows and bytes of the largest blocks."""

    rows: int
    blocks: int
    most_rows: int
    most_bytes: int


def check_rows(df: DataFrame, label: str = "label", binary: bool = False) -> Checked:
    """Counts of the rows and their blocks; fails on an empty input, a null block, a null
    or NaN label, and with ``binary`` on any label other than 0/1.  One scan, N rows
    shuffled, one row to the driver."""
    lab = F.col(label)
    bad = lab.isNull() | F.isnan(lab.cast("double"))
    if binary:
        bad = bad | ~lab.isin(0.0, 1.0)
    r = (df.groupBy("block_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"), F.sum(row_bytes(df)).alias("bytes"))
         .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("blocks"), F.max("n").alias("most"), F.max("bytes").alias("bytes"),
              F.sum("bad").alias("bad"), F.sum(F.when(F.col("block_id").isNull(), F.col("n")).otherwise(0)).alias("lost")).first())
    if not r["n"]:
        raise ValueError("no rows to train on")
    if r["lost"]:
        raise ValueError(f"{r['lost']} rows have no block_id")
    if r["bad"]:
        raise ValueError(f"{r['bad']} rows have {'a label other than 0/1' if binary else 'a null or NaN label'}")
    return Checked(int(r["n"]), int(r["blocks"]), int(r["most"]), int(r["bytes"]))
