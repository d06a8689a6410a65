"""A training corpus from raw documents, in five stages; each works on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import bpe, mixing, quality, secrets, simhash
from lattica.llm.storage import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, with what it knows of their sites, doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, labels).select(*COLUMNS)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id, null last. Sets of five-word shingles that agree by 0.8 or more.

    Candidates come from multi-index hashing of fingerprints, each link is verified on whole sets. Rows are told apart by
    id and text: each row stands or goes with its own group, whatever other rows of its id do. Of rows of one id in one
    group, the one with the least key stays; of rows that are equal in id and text, one.
    """
    groups = simhash.near_texts(docs, words=5)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    first = groups.groupBy("component").agg(F.min(order).alias("first")).select("first.row_key")
    # rows that are equal in id and text meet as a minimum in each task before they are dealt out
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    each = docs.groupBy(simhash.row_key().alias("row_key")).agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.min(F.struct(*rest)).alias("rest"))
    kept = each.join(first, "row_key", "left_semi")
    return kept.select("doc_id", "text", *[f"rest.{c}" for c in rest]).select(*COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced by a mark."""
    found = secrets.scan(docs)
    clean = found.withColumn("text", secrets.redact(F.col("text"), F.col("spans")))
    return clean.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it; the copies are rows of their own."""
    mixed = mixing.mix(docs).filter("copies > 0")
    copies = mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return copies.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of each document, as digests."""
    return bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_documents),
    ("near_duplicates", distinct_documents),
    ("secrets", without_secrets),
    ("mixing", mixed_sources),
    ("bpe", encoded),
]

#: SQL can't express the classifier, the fingerprints or the merges; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs
