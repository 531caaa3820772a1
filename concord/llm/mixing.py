"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a token budget: a share of all tokens by its weight, no more than ``max_epochs``
times its size, the excess reshared by weight until none is above.  A source whose budget
covers its size k times is taken whole k times; these complete epochs come first.  The rest
of the budget is a weighted sample without replacement: every document draws a uniform number
u from a hash of its id and text and has the exponential key -ln(u) / quality, so better documents
tend to come earlier; documents are sorted by key within the source, their sizes summed up,
and taken until the budget is met.  The document in which it ends is taken in part (its first words).

The prefix sums run in three levels, none of which puts a whole source into one task: sums of key ranges
(as many as a source's rows need), sums within the one range in which the budget ends, by key and by chunks of
repeated rows, and the rows of that last chunk.

Defined results: a null text has size 0; a null source is a source of its own, last in order; documents of size 0
are taken with 0 words; repeated rows have equal keys and are taken one after another; a document without a quality
has ``quality_default``; a source of size 0 has target 0; an empty table gives no rows.
Sources are numbered by code point, so their weights repeat in that order.  Nothing depends on
how rows are dealt over files and tasks, so reruns agree.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.llm.common import discard, materialise

WORD = r"[^\x20\x09-\x0D]+"
#: about so many rows in a range of keys
RANGE_ROWS = 5_000
#: repeated rows are summed by chunks of so many places of the written table
CHUNK_ROWS = 10_000


def word_count(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform_of(digest: Column) -> Column:
    """A number in (0, 1) from the first 13 digits of a hex digest."""
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """``df`` with the place (from 0) of each row in order of ``by``, nulls last.  Rows are range-partitioned,
    numbered within their range, and shifted by the rows of the ranges before."""
    parted = materialise(df.repartitionByRange(F.col(by).asc_nulls_last()).withColumn(f"{name}_part", F.spark_partition_id()))
    within = parted.withColumn(name, F.row_number().over(Window.partitionBy(f"{name}_part").orderBy(F.col(by).asc_nulls_last())))
    counts = parted.groupBy(f"{name}_part").agg(F.count(F.lit(1)).alias("rows"))
    # one row per task of the exchange above
    before = counts.withColumn("before", F.sum("rows").over(Window.orderBy(f"{name}_part")) - F.col("rows")).drop("rows")
    return within.join(before, f"{name}_part").withColumn(name, F.col(name) + F.col("before") - 1).drop("before", f"{name}_part")


def targets(sources: DataFrame, max_epochs: int) -> DataFrame:
    """``sources`` (source, source_size, weight) with ``target``: shares of all sizes by weight, cut off at
    ``max_epochs`` sizes, what is cut off reshared by weight until none is above.

    Sources are cut off in order of max_epochs * size / weight; a round is one aggregate over the sources, which returns what
    the uncut ones share and the sum of their weights, and raises the level of the uncut ones.  Sums and products of
    sizes and weights are decimals of 38 digits: ints end at 2**31 and longs at 2**63."""
    size, weight_of = F.col("source_size").cast("decimal(38,0)"), F.col("weight").cast("decimal(38,0)")
    cap = size * F.lit(Decimal(max_epochs))

    def is_cut(words: int, weight: int) -> Column:
        return cap * F.lit(Decimal(weight)) <= F.lit(Decimal(words)) * weight_of

    open_words, open_weight = None, None
    while True:
        cut = F.lit(False) if open_weight is None else is_cut(open_words, open_weight)
        got = sources.agg(F.coalesce(F.sum(size), F.lit(0)).cast("decimal(38,0)").alias("words"),
                          F.coalesce(F.sum(F.when(cut, cap)), F.lit(0)).cast("decimal(38,0)").alias("cut"),
                          F.coalesce(F.sum(F.when(~cut, F.col("weight"))), F.lit(0)).cast("long").alias("weight")).first()
        words, weight = int(got["words"] - got["cut"]), int(got["weight"])
        if weight == 0 or (words, weight) == (open_words, open_weight):
            break
        open_words, open_weight = words, weight
    if not open_weight:
        return sources.withColumn("target", cap.cast("double"))
    level = F.lit(float(open_words)) * F.col("weight") / F.lit(float(open_weight))
    return sources.withColumn("target", F.when(is_cut(open_words, open_weight), cap.cast("double")).otherwise(level))


def mix(df: DataFrame, weights: list[int], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        quality: DataFrame | None = None, quality_default: float = 1.0, max_epochs: int = 3) -> DataFrame:
    """(id, source, size, source_size, target, epochs, taken) per row of ``df``.

    The sources in order weigh ``weights``, repeating.  ``quality`` has (id, quality), one row per id, all above 0."""
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    drawn = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
                      F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text)).alias("digest"))
    if quality is not None:
        drawn = drawn.join(quality.select(F.col(id_col).alias("id"), F.col("quality").cast("double").alias("quality")), "id", "left")
        drawn = drawn.withColumn("quality", F.coalesce("quality", F.lit(float(quality_default))))
    else:
        drawn = drawn.withColumn("quality", F.lit(float(quality_default)))
    drawn = materialise(drawn.select("id", "source", "size", "digest", (-F.log(uniform_of(F.col("digest"))) / F.col("quality")).alias("key"), "quality",
                                     F.monotonically_increasing_id().alias("row")))

    per_source = materialise(drawn.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"),
                                                         F.avg("quality").alias("mean")))
    cycle = F.lit([int(w) for w in weights])
    placed = materialise(numbered(per_source, "source", "place").withColumn("weight", F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int"))))
    budget = targets(placed, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(F.lit(0))
    rest = F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    budget = materialise(budget.withColumn("epochs", epochs.cast("long")).withColumn("rest", F.least(F.greatest(rest, F.lit(0)), F.col("source_size")))
                         .withColumn("ranges", F.ceil(F.col("rows") / F.lit(RANGE_ROWS)))
                         .select("source", "source_size", "target", "epochs", "rest", "ranges", "mean"))

    def ends(groups: DataFrame, order: list[str], keep: list[str]) -> DataFrame:
        """Per source the group in which its rest ends: (source, keep, before)."""
        run = Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return (groups.withColumn("upto", F.col("start") + F.sum("size").over(run))
                .where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("size") < F.col("rest")))
                .select("source", "rest", *keep, (F.col("upto") - F.col("size")).alias("before")))

    # a rising function of the key with about even values within a source
    part = F.floor(F.col("ranges") * (F.lit(1.0) - F.exp(-F.col("key") * F.col("mean"))))
    some = budget.where("rest > 0").select("source", "rest", "ranges", "mean")
    ranged = same_source(drawn, some).withColumn("range", part)
    sums = ranged.groupBy("source", "rest", "range").agg(F.sum("size").alias("size")).withColumn("start", F.lit(0))
    last = materialise(ends(sums, ["range"], ["range"]))
    # within that range, by key; repeated rows by chunks
    inside = materialise(same_source(ranged.drop("rest"), last.select("source", "rest", F.col("range").alias("end"), F.col("before").alias("start")))
                         .where(F.col("range") == F.col("end"))
                         .select("source", "rest", "start", "key", "digest", "size", F.floor(F.col("row") / F.lit(CHUNK_ROWS)).alias("chunk"), "row"))
    sums = inside.groupBy("source", "rest", "start", "key", "digest", F.col("size").alias("each"), "chunk").agg(F.sum("size").alias("size"))
    last = materialise(ends(sums, ["key", "digest", "each", "chunk"], ["key", "digest", "each", "chunk"]))
    rows = (same_source(inside.drop("rest", "start"), last.select("source", "rest", F.col("before").alias("start"), *[F.col(c).alias(f"end_{c}") for c in ("key", "digest", "each", "chunk")]))
            .where("key = end_key and digest = end_digest and size = end_each and chunk = end_chunk"))
    stop = materialise(ends(rows, ["row"], ["key", "digest", "size", "row"]))

    at = F.struct("key", "digest", "size", "row")
    stop = stop.select("source", at.alias("stop"), (F.col("rest") - F.col("before")).alias("part"))
    plan = materialise(same_source(budget.select("source", "source_size", "target", "epochs"), stop, "left"))
    sampled = F.when(at < F.col("stop"), F.col("size")).when(at == F.col("stop"), F.col("part")).otherwise(F.lit(0))
    out = materialise(same_source(drawn, plan)
                      .select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "epochs",
                              (F.col("epochs") * F.col("size") + sampled).cast("long").alias("taken")))
    discard(drawn, per_source, placed, budget, last, inside, plan)
    return out


def same_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on the source, where null equals null."""
    other = right.withColumnRenamed("source", "source_of")
    return left.join(other, left["source"].eqNullSafe(other["source_of"]), how).drop("source_of")


ORACLE = r"""
WITH drawn AS (
  SELECT d.doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(d.doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS digest,
         coalesce(q.quality, 2.0) AS quality
  FROM documents d LEFT JOIN (SELECT doc_id, avg(CASE quality WHEN 1 THEN 4.0 WHEN 0 THEN 1.0 ELSE 2.0 END) AS quality
                              FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id) q ON q.doc_id = d.doc_id),
keyed AS (
  SELECT *, -ln((('0x' || substr(digest, 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / quality AS key FROM drawn),
sources AS (
  SELECT source, sum(size)::HUGEINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM keyed GROUP BY source),
-- sources are cut off at three sizes in order of size by weight; the level is that of the first one that is not
ordered AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS open_words,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open_weight,
         row_number() OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST) AS nth
  FROM sources
  WINDOW before AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT open_words, open_weight FROM ordered WHERE 3 * source_size * open_weight > open_words * weight ORDER BY nth LIMIT 1),
planned AS (
  SELECT source, source_size, CASE WHEN open_weight IS NULL OR 3 * source_size * l.open_weight <= l.open_words * weight THEN (3 * source_size)::DOUBLE
                      ELSE l.open_words::DOUBLE * weight / l.open_weight::DOUBLE END AS target
  FROM (SELECT source, source_size, weight FROM sources) LEFT JOIN level l ON true),
epochs AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS epochs FROM planned),
ranked AS (
  SELECT k.doc_id, k.size, e.source_size::BIGINT AS source_size, e.target, e.epochs,
         least(greatest(round(e.target - e.epochs * e.source_size), 0), e.source_size) AS rest,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.digest, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed k JOIN epochs e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (epochs * size + least(size, greatest(rest - before, 0)))::BIGINT AS taken FROM ranked"""
