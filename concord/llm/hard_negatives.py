"""Hard-negative mining by exact integer scores from Kronecker-packed products.

Components become integers, floor(scale * x).  A block of candidates is biased to values of
zero or more and packed: the same component of several candidates stands in separated fields
of one wide integer, wide enough for the largest sum of products.  One multiplication per
anchor component then serves all of them, and the sums are unpacked exactly.  While the
packed sums fit in 53 bits the wide integers are whole doubles, so that a block of anchors
is one matrix product; larger values go through Python's unbounded integers.

Anchors and rows are dealt by their number over a grid of groups of fixed size; a cell of the grid
compares one group of anchors with one group of rows, whatever ids and labels they have, and
returns the best few per anchor only.  The first pass looks at rows of the anchor's label and
yields its positives, the second at rows of other labels and yields the negatives.

Defined results: rows with a null id or label, a null vector, or any null or non-finite component take
no part; rows equal in id, label and integer vector count once, rows that share only their id are
different rows; vectors of different length do not meet; integers and scores beyond 64 bits
stay at the ends of a long; an anchor without positives, or a positive without negatives in
its window, gives no rows; an empty table gives none.  Other columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.llm.common import discard, materialise, prepare

#: bytes of integer components in a group of rows and in a group of anchors
ROW_BYTES = 2 << 20
ANCHOR_BYTES = 8 << 20
#: anchors scored at a time within a cell
STRIP = 256
EXACT_BITS = 53  # whole numbers that doubles hold exactly
LONG = np.iinfo(np.int64)


def kronecker_scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors, (anchors x rows) int64."""
    m, d = anchors.shape
    n = len(rows)
    if not (m and n and d):
        return np.zeros((m, n), np.int64)
    low_a, low_r = int(anchors.min()), int(rows.min())
    span_a, span_r = int(anchors.max()) - low_a, int(rows.max()) - low_r
    width = max(1, (d * span_a * span_r).bit_length())
    fits = width <= EXACT_BITS
    fields = EXACT_BITS // width if fits else 4
    kind = np.int64 if fits else object
    a = anchors.astype(kind) - low_a
    r = rows.astype(kind) - low_r
    groups = -(-n // fields)
    padded = np.zeros((fields * groups, d), kind)
    padded[:n] = r
    wide = padded[:groups]
    for f in range(1, fields):
        wide = wide + padded[f * groups:(f + 1) * groups] * (1 << width * f)
    if fits:
        sums = (a.astype(np.float64) @ wide.astype(np.float64).T).astype(np.int64)
    else:
        sums = a @ wide.T
    mask = (1 << width) - 1
    scores = np.concatenate([(sums >> (width * f)) & mask for f in range(fields)], axis=1)[:, :n]
    # sum (a - low_a)(r - low_r) = sum a r - low_a sum r - low_r sum a + d low_a low_r
    small = fits and d * max(abs(low_a), span_a + abs(low_a)) * max(abs(low_r), span_r + abs(low_r)) < 1 << 61
    kind = np.int64 if small else object
    scores = (scores.astype(kind) + low_a * rows.astype(kind).sum(axis=1)[None, :]
              + low_r * anchors.astype(kind).sum(axis=1)[:, None] - d * low_a * low_r)
    return scores if small else np.clip(scores, int(LONG.min), int(LONG.max)).astype(np.int64)


def ordered_keys(scores: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, int, int]:
    """(keys, base, top): per anchor the sorted values score * base + (base - 1 - place), so that
    a larger key is a higher score or, at the same score, an earlier place; places that are not
    allowed have the smallest keys of all.  No score is above ``top`` or below -``top``."""
    n = scores.shape[1]
    base = 1 << max(1, (n - 1).bit_length())
    top = max(abs(int(scores.max())), abs(int(scores.min())))
    kind = np.int64 if (top + 1) * base < 1 << 62 else object
    keys = scores.astype(kind) * base + (base - 1 - np.arange(n))
    keys[~allowed] = -(top + 1) * base
    keys.sort(axis=1)
    return keys, base, top


def best_between(keys: np.ndarray, base: int, top: int, low: int, high: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the first k keys of one anchor with low <= score <= high."""
    low, high = max(low, -top), min(high, top)
    a, z = (int(np.searchsorted(keys, v)) for v in (low * base, (high + 1) * base)) if low <= high else (0, 0)
    found = keys[max(a, z - k):z][::-1]
    return (base - 1 - found % base).astype(np.int64), (found // base).astype(np.int64)


def window(score: int, least: Fraction, most: Fraction) -> tuple[int, int]:
    """Smallest and largest whole score in [least * score, most * score]."""
    return -(-least.numerator * score // least.denominator), most.numerator * score // most.denominator


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, integer matrix) per vector length of a list column."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = []
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        out.append((at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)))
    return out


def _by_id(table: pa.Table) -> pa.Table:
    return table.sort_by([("id", "ascending"), ("row", "ascending")]).combine_chunks()


def _strips(table: pa.Table, same_label: bool):
    """Per strip of anchors of a cell in order of id: (anchors, rows compared, their ordered keys)."""
    vectors = table.column("q").combine_chunks()
    is_anchor = table.column("is_anchor").to_numpy(zero_copy_only=False)
    number = table.column("row").to_numpy()
    label = table.column("label").to_numpy()
    for at, x in _matrix(vectors):
        a, r = np.flatnonzero(is_anchor[at]), np.flatnonzero(~is_anchor[at])
        parts = [(a, r)] if not same_label else [(a[label[at[a]] == v], r[label[at[r]] == v]) for v in np.unique(label[at[a]])]
        for mine, theirs in parts:
            if not len(theirs):
                continue
            for lo in range(0, len(mine), STRIP):
                strip = mine[lo:lo + STRIP]
                if same_label:
                    allowed = number[at[strip]][:, None] != number[at[theirs]][None, :]
                else:
                    allowed = label[at[strip]][:, None] != label[at[theirs]][None, :]
                yield at[strip], at[theirs], ordered_keys(kronecker_scores(x[strip], x[theirs]), allowed)


def _first(df: DataFrame, by: list[str], k: int, rank: str) -> DataFrame:
    """The first k rows of each group by falling score, then id; pruned before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id", "other")
    return df.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def mine_hard_negatives(df: DataFrame, anchor: Column | str, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                        scale: int = 256, positives: int = 5, negatives: int = 10,
                        least: Fraction = Fraction(3, 10), most: Fraction = Fraction(9, 10)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` says which rows of ``df`` are anchors.  An anchor's positives are the best ``positives`` other
    rows of its label; its negatives for each of them are the best ``negatives`` rows of other
    labels whose score is between ``least`` and ``most`` times the positive's."""
    spark = df.sparkSession
    prepare(spark)
    anchor = F.expr(anchor) if isinstance(anchor, str) else anchor
    label = F.col(label_col)
    own = df.select(F.col(id_col).cast("long").alias("id"), label.alias("name"), F.col(vec_col).cast("array<double>").alias("v"),
                    F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
    usable = (F.col("id").isNotNull() & F.col("name").isNotNull() & F.col("v").isNotNull()
              & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    whole = (own.where(usable).select("id", "name", "is_anchor", F.transform("v", lambda x: F.floor(x * F.lit(float(scale)))).alias("q"))
             .dropDuplicates(["id", "name", "q"]))
    # labels of any type travel as numbers; equal labels have equal numbers, and the reverse
    if dict(whole.dtypes)["name"] in ("tinyint", "smallint", "int", "bigint"):
        whole = whole.withColumn("label", F.col("name").cast("long"))
    else:
        names = materialise(whole.select("name").distinct().select("name", F.monotonically_increasing_id().alias("label")))
        whole = whole.join(names, "name")
    rows = materialise(whole.select(F.monotonically_increasing_id().alias("row"), "id", "label", "is_anchor", "q"))
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(8 * F.size("q") + 8).alias("bytes"), F.count_if("is_anchor").alias("m"),
                     F.sum(F.when(F.col("is_anchor"), 8 * F.size("q") + 8)).alias("anchor_bytes")).first()
    row_groups = max(1, -(-(sizes["bytes"] or 0) // ROW_BYTES))
    anchor_groups = max(1, -(-(sizes["anchor_bytes"] or 0) // ANCHOR_BYTES))

    def grid(anchors: DataFrame) -> DataFrame:
        """Every group of anchors beside every group of rows, one cell each."""
        left = (anchors.withColumn("is_anchor", F.lit(True)).withColumn("i", F.pmod(F.xxhash64("row"), F.lit(anchor_groups)))
                .withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(row_groups - 1)).cast("array<bigint>"))))
        right = (rows.withColumn("is_anchor", F.lit(False)).withColumn("windows", F.lit(None).cast("array<struct<positive:bigint,score:bigint>>"))
                 .withColumn("j", F.pmod(F.xxhash64("row"), F.lit(row_groups)))
                 .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(anchor_groups - 1)).cast("array<bigint>"))))
        names = ["i", "j", "row", "id", "label", "is_anchor", "q", "windows"]
        return left.select(names).union(right.select(names)).groupBy("i", "j")

    def near(table: pa.Table) -> pa.Table:
        table = _by_id(table)
        ids, number = table.column("id").to_numpy(), table.column("row").to_numpy()
        out = [[], [], [], []]
        for strip, others, ordered in _strips(table, True):
            for a, line in zip(strip, ordered[0]):
                k = min(positives, len(others) - int((number[others] == number[a]).sum()))
                place, score = best_between(line, *ordered[1:], int(LONG.min), int(LONG.max), k) if k else ([], [])
                for col, got in zip(out, ([number[a]] * len(place), ids[others[place]], number[others[place]], score)):
                    col.extend(got)
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("anchor", "id", "other", "score"), out)})

    anchors = rows.where("is_anchor").withColumn("windows", F.lit(None).cast("array<struct<positive:bigint,score:bigint>>"))
    found = grid(anchors).applyInArrow(near, "anchor long, id long, other long, score long")
    chosen = materialise(_first(found, ["anchor"], positives, "place").select("anchor", "id", "other", "score"))

    def hard(table: pa.Table) -> pa.Table:
        table = _by_id(table)
        ids, number = table.column("id").to_numpy(), table.column("row").to_numpy()
        out = [[], [], [], [], []]
        for strip, others, ordered in _strips(table, False):
            asked = table.column("windows").take(pa.array(strip)).to_pylist()
            for a, line, windows in zip(strip, ordered[0], asked):
                for w in windows:
                    place, score = best_between(line, *ordered[1:], *window(w["score"], least, most), negatives)
                    for col, got in zip(out, ([number[a]] * len(place), [w["positive"]] * len(place), ids[others[place]], number[others[place]], score)):
                        col.extend(got)
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("anchor", "positive", "id", "other", "score"), out)})

    asked = chosen.groupBy("anchor").agg(F.collect_list(F.struct(F.col("other").alias("positive"), "score")).alias("windows"))
    anchors = rows.where("is_anchor").join(asked.withColumnRenamed("anchor", "row"), "row")
    found = grid(anchors).applyInArrow(hard, "anchor long, positive long, id long, other long, score long")
    ranked = materialise(_first(found, ["anchor", "positive"], negatives, "rank")
                         .select("anchor", "positive", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")))
    heads = rows.where("is_anchor").select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    firsts = chosen.select("anchor", F.col("other").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = materialise(ranked.join(firsts, ["anchor", "positive"]).join(heads, "anchor")
                      .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))
    discard(rows, chosen, ranked)
    return out


ORACLE = r"""
WITH usable AS (
  SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
rows AS (SELECT *, row_number() OVER (ORDER BY id) AS n FROM usable),
scored AS (
  SELECT a.n AS anchor, a.id AS anchor_id, r.n AS other, r.id, r.label = a.label AS same,
         list_dot_product(a.q, r.q)::BIGINT AS score
  FROM rows a JOIN rows r ON a.id % 100 = 0 AND a.n <> r.n AND len(a.q) = len(r.q)),
positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5),
found AS (
  SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY s.score DESC, s.id) AS rank
  FROM positives p JOIN scored s ON s.anchor = p.anchor AND NOT s.same
   AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 10"""
