"""Registered queries of the corpus operators and, where SQL can state them, their DuckDB SQL.

Every query runs its operator over the whole intended table with production parameters and
derives the digest columns from the operator's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.common import materialise, read_table
from concord.llm.embedding_dedup import ORACLE as EMBEDDING_SQL
from concord.llm.hard_negatives import ORACLE as HARD_NEGATIVE_SQL
from concord.llm.line_dedup import ORACLE as LINE_DEDUP_SQL
from concord.llm.mixing import ORACLE as MIXING_SQL

#: rules of op4: verdict, host, path
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file on the driver (tasks get its content)."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the counts of its line chunks and the md5 of what is kept."""
    from concord.llm.line_dedup import dedup_lines

    kept = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.withColumn("kept_md5", F.md5("text")).drop("text")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat an earlier string of 100 bytes."""
    from concord.llm.suffix_dedup import remove_repeats

    return remove_repeats(read_table(spark, sf_dir, "documents"), emit="digest")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learns from rows that are not held out."""
    from concord.llm.language_id import held_out, predict, train

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    marked = docs.withColumn("held_out", held_out(F.col("doc_id")))
    model = train(marked.where("not held_out"))
    return predict(marked.select("doc_id", "text", "held_out"), model).drop("text")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's url."""
    from concord.llm.url_filter import judge_urls

    return judge_urls(read_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


def op5_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and of its edited text."""
    from concord.llm.edit_fingerprint import fingerprint_with_edits

    return fingerprint_with_edits(read_table(spark, sf_dir, "documents"))


def edit_fingerprint_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near copies of every document: fingerprints banded by sampled steps and verified at a
    likeness of 0.8."""
    from concord.llm.edit_fingerprint import fingerprint_texts, with_classes

    return with_classes(materialise(fingerprint_texts(read_table(spark, sf_dir, "documents"))))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings of equal label."""
    from concord.llm.embedding_dedup import link_vectors

    return link_vectors(read_table(spark, sf_dir, "embeddings"))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of ids and of the decoded text of every document."""
    from concord.llm.bpe import encode

    return encode(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), emit="digest")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence and offset of every piece of every document."""
    from concord.llm.packing import pack

    return pack(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    from concord.llm.secret_scan import find_secrets

    return find_secrets(read_table(spark, sf_dir, "documents")).drop("row", "mask")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle-set size and near-duplicate component of every document."""
    from concord.llm.ngram_join import jaccard_groups

    return jaccard_groups(read_table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor (id divisible by 100) for each of its five positives."""
    from concord.llm.hard_negatives import mine_hard_negatives

    rows = read_table(spark, sf_dir, "embeddings")
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(rows.select("vec_id", "embedding", changed.alias("label")), F.col("vec_id") % 100 == 0)


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document; labelled good documents come four times as
    readily as labelled bad ones, unlabelled ones twice."""
    from concord.llm.mixing import mix

    grade = F.when(F.col("quality") == 1, 4.0).when(F.col("quality") == 0, 1.0).otherwise(2.0)
    quality = (read_table(spark, sf_dir, "labels").where("doc_id is not null")
               .groupBy("doc_id").agg(F.avg(grade).alias("quality")))
    mixed = mix(read_table(spark, sf_dir, "documents"), weights=[1, 2, 3], quality=quality, quality_default=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight whitened components of every embedding.  ``deviation`` is null where a long cannot hold it."""
    from concord.llm.whitening import whitened_components

    out = whitened_components(read_table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_suffix_dedup, op3_language_id, op4_url_filter, op5_edit_fingerprints, op6_embedding_dedup,
                                   op7_bpe_round_trip, op8_best_fit_packing, op9_secret_scan, op10_ngram_jaccard,
                                   op11_hard_negatives, op12_source_mixing, op13_embedding_whitening, edit_fingerprint_classes)}

ORACLE_SQL = {
    "op1_line_dedup": LINE_DEDUP_SQL,
    "op6_embedding_dedup": EMBEDDING_SQL,
    "op11_hard_negatives": HARD_NEGATIVE_SQL,
    "op12_source_mixing": MIXING_SQL,
    "op4_url_filter": r"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
fits AS (
  SELECT *, ('.' || host) LIKE '%.example.org' AS on_example, ('.' || host) LIKE '%.org' AS on_org,
         ('.' || host) LIKE '%.com' AS on_com FROM parts),
ruled AS (
  SELECT page_id, host, path,
         CASE WHEN on_example AND starts_with(path, '/en/1') THEN 'example.org/en/1'
              WHEN on_example AND starts_with(path, '/es/') THEN 'example.org/es/'
              WHEN on_org AND starts_with(path, '/') THEN 'org/'
              WHEN on_com AND starts_with(path, '/fr/') THEN 'com/fr/'
              WHEN on_com AND starts_with(path, '/de/') THEN 'com/de/' END AS rule
  FROM fits)
SELECT *, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled""",
}
