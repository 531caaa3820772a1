"""A training-data pipeline over ``documents``: language ID, line dedup, n-gram Jaccard join,
secret scan, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as
Parquet to the shared folder named by ``spark.checkpoint.dir`` and reads it back as the next
stage's documents.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.common import materialise
from concord.llm.language_id import predict, train
from concord.llm.line_dedup import dedup_lines
from concord.llm.ngram_join import drop_near_duplicates
from concord.llm.packing import pack
from concord.llm.queries import vocabulary
from concord.llm.secret_scan import mask_secrets


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text fits a learned language; texts without letters, and texts far
    outside the calibrated cross-entropy of their best language, go.  The label of a
    document is not changed."""
    return predict(docs, train(docs)).where("not rejected").select(own_columns(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of several lines go from the texts, and documents of which nothing
    is left go; a document that lost no line stays, also without a text."""
    out = dedup_lines(docs).where("n_removed_lines = 0 or n_removed_lines < n_lines or text <> ''")
    return resized(out.select(own_columns(docs)), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, similarity 0.8)."""
    return drop_near_duplicates(docs).select(own_columns(docs))


def mask_credentials(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return resized(mask_secrets(docs).select(own_columns(docs)), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in training sequences."""
    return pack(docs, vocabulary("word_bpe_49k.json"))


def own_columns(df: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in df.columns]


def resized(df: DataFrame, like: DataFrame) -> DataFrame:
    """``n_chars`` set to the length of the text as it is now."""
    return df.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType)) if "n_chars" in like.columns else df


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("secret_scan", mask_credentials),
    ("best_fit_packing", pack_sequences),
]

#: language models and shingle sketches are not SQL; the stages are tested one by one
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of what all stages keep of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs)
    return docs
