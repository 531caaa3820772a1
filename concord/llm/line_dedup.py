"""Line deduplication over content-defined chunks, in DataFrame functions only.

A rolling hash over two neighbouring line hashes is taken at every line; a chunk ends after
a line whose rolling hash is a strict local maximum.  Boundaries depend only on four
neighbouring lines, so inserted lines shift them no further, and chunks inside a text have
two lines at least.  A chunk of two or more lines that occurs again anywhere in the corpus is
removed, except at its first place (smallest id, then first in the text), after its bytes
were compared: chunks are grouped by hash and bytes, and a hash shared by different bytes
removes nothing.

Defined results: a null text stays null, an empty one empty; a text of one line has no
chunk of several lines and stays; a text all of whose chunks go becomes empty; rows without
an id count as the last document; rows that share an id count as one document, so repeats
between them stay; other columns pass through whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.common import free_name, materialise

#: fixed values: multiplier and modulus (a prime below 2**31) of the rolling hash
ROLL_BASE, ROLL_MOD = 1_000_003, 2_147_483_647


def line_hash(line: Column) -> Column:
    """The first 32 bits of a line's md5."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def chunked(df: DataFrame, text_col: str, lines: str, chunks: str) -> DataFrame:
    """``df`` with its lines and their chunks, array<struct<start, n, hash>> (null text: null).

    Each array is built from columns of the projection before it and used there more than
    once, so the optimizer keeps the projections apart and no array is built per element."""
    h, r, cut, starts = (free_name(df, f"line_{x}") for x in ("h", "r", "cut", "starts"))
    df = df.withColumn(lines, F.split(F.col(text_col), "\n", -1))
    df = df.withColumn(h, F.transform(lines, line_hash))
    before = F.concat(F.array(F.lit(0).cast("long")), F.slice(h, 1, F.size(h) - 1))
    df = df.withColumn(r, F.when(F.size(h) > 0, F.zip_with(before, h, lambda p, c: (p * ROLL_BASE + c) % ROLL_MOD)))
    none = F.array(F.lit(None).cast("long"))
    left = F.concat(none, F.slice(r, 1, F.size(r) - 1))
    right = F.concat(F.slice(r, 2, F.size(r)), none)
    sides = F.arrays_zip(left.alias("l"), F.col(r).alias("c"), right.alias("r"))
    df = df.withColumn(cut, F.transform(sides, lambda x: F.coalesce((x["c"] > x["l"]) & (x["c"] > x["r"]), F.lit(False))))
    df = df.withColumn(starts, F.concat(F.array(F.lit(0)), F.array_compact(
        F.transform(cut, lambda c, i: F.when(c, i + 1)))))
    stops = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(lines)))
    df = df.withColumn(chunks, F.zip_with(starts, stops, lambda s, e: F.struct(
        s.alias("start"), (e - s).alias("n"),
        F.md5(F.array_join(F.slice(F.col(lines), s + 1, e - s), "\n")).alias("hash"))))
    return df.drop(h, r, cut, starts)


def repeated_chunks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(hash, first_id) of every chunk of several lines that occurs more than once.

    Grouping by hash and bytes is combined map-side, so a chunk that fills much of the
    corpus is shuffled once per task; a second, small aggregation drops hashes that stand
    for different bytes."""
    base = chunked(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "text", "lines", "chunks")
    texts = F.transform(F.filter("chunks", lambda c: c["n"] > 1), lambda c: F.struct(
        c["hash"].alias("hash"), F.array_join(F.slice(F.col("lines"), c["start"] + 1, c["n"]), "\n").alias("bytes")))
    each = base.select("id", F.explode(texts).alias("c")).select("id", "c.hash", "c.bytes")
    by_bytes = each.groupBy("hash", "bytes").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("first_id"))
    return (by_bytes.groupBy("hash").agg(F.count(F.lit(1)).alias("texts"), F.sum("k").alias("k"), F.min("first_id").alias("first_id"))
            .where("texts = 1 and k > 1").select("hash", "first_id"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with repeated chunks taken out of ``text_col`` and four counts added:
    ``n_lines``, ``n_chunks``, ``n_removed_chunks``, ``n_removed_lines`` (replaced if there)."""
    # written first: both sides of the join by hash are then plain shuffles, which adaptive
    # execution may split where one chunk occurs in very many documents
    repeated = materialise(repeated_chunks(df, id_col, text_col))
    key, lines, chunks, drop = (free_name(df, x) for x in ("dedup_key", "dedup_lines", "dedup_chunks", "dedup_drop"))
    ident = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("\x00"), F.coalesce(F.col(text_col), F.lit(""))))
    keyed = df.withColumn(key, ident)

    spans = chunked(keyed.select(F.col(key).alias("key"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")),
                    "text", "lines", "chunks")
    several = F.filter("chunks", lambda c: c["n"] > 1)
    per_hash = (spans.select("key", "id", F.explode(several).alias("c"))
                .select("key", "id", "c.hash", "c.start").join(repeated, "hash")
                .groupBy("key", "hash").agg(F.collect_set("start").alias("starts"), F.min("start").alias("lead"),
                                            F.first(F.col("id").eqNullSafe(F.col("first_id"))).alias("first")))
    hits = (per_hash.select("key", F.explode(F.filter("starts", lambda x: ~(F.col("first") & (x == F.col("lead"))))).alias("start"))
            .groupBy("key").agg(F.collect_set("start").alias("drop")))
    joined = keyed.join(hits.select(F.col("key").alias(key), F.col("drop").alias(drop)), key, "left")
    out = chunked(joined, text_col, lines, chunks)
    gone = F.coalesce(F.col(drop), F.array().cast("array<int>"))
    kept = F.array_join(F.transform(
        F.filter(chunks, lambda c: ~F.array_contains(F.col(drop), c["start"])),
        lambda c: F.array_join(F.slice(F.col(lines), c["start"] + 1, c["n"]), "\n")), "\n")
    counts = {
        "n_lines": F.coalesce(F.when(F.col(text_col).isNotNull(), F.size(lines)), F.lit(0)).cast("long"),
        "n_chunks": F.coalesce(F.when(F.col(text_col).isNotNull(), F.size(chunks)), F.lit(0)).cast("long"),
        "n_removed_chunks": F.size(gone).cast("long"),
        "n_removed_lines": F.when(F.col(drop).isNull(), F.lit(0)).otherwise(F.aggregate(
            F.filter(chunks, lambda c: F.array_contains(F.col(drop), c["start"])), F.lit(0), lambda a, c: a + c["n"])).cast("long"),
    }
    names = [c for c in df.columns if c.lower() not in counts]
    return out.select(
        *[F.when(F.col(drop).isNull(), F.col(text_col)).otherwise(kept).alias(c) if c.lower() == text_col.lower()
          else F.col(f"`{c}`") for c in names],
        *[v.alias(k) for k, v in counts.items()])


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL),
hashed AS (
  SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM lines),
rolled AS (
  SELECT *, (coalesce(lag(h) OVER d, 0) * 1000003 + h) % 2147483647 AS r FROM hashed
  WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
cuts AS (
  SELECT *, coalesce(r > lag(r) OVER d AND r > lead(r) OVER d, false) AS cut FROM rolled
  WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (
  SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c
  FROM cuts),
chunks AS (
  SELECT doc_id, c, min(i) AS start, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS bytes
  FROM numbered GROUP BY doc_id, c),
ranked AS (
  SELECT *, n > 1 AND row_number() OVER (PARTITION BY bytes, n > 1 ORDER BY doc_id, start) > 1 AS gone FROM chunks),
kept AS (
  SELECT doc_id, sum(n)::BIGINT AS n_lines, count(*) AS n_chunks, count(*) FILTER (gone) AS n_removed_chunks,
         coalesce(sum(n) FILTER (gone), 0)::BIGINT AS n_removed_lines,
         coalesce(string_agg(bytes, chr(10) ORDER BY c) FILTER (NOT gone), '') AS kept_text
  FROM ranked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_chunks, 0) AS n_chunks,
       coalesce(n_removed_chunks, 0) AS n_removed_chunks, coalesce(n_removed_lines, 0) AS n_removed_lines,
       md5(kept_text) AS kept_md5
FROM documents d LEFT JOIN kept USING (doc_id)"""
