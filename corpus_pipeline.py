"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next one's docs. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import bpe, mixing, quality, secrets, simhash
from orrery.llm.common import checkpoint_dir, delete, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their hosts' frequent lines; copies count once, as they are the next stage's task."""
    return quality.keep_good(docs, limits=quality.Limits(copies_once=True))


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, a similarity of 0.8 and more."""
    return simhash.keep_one(docs, width=5, alike=0.8)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to their target weights; a document taken several times has as many rows."""
    return mixing.repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids (little-endian unsigned 32-bit integers)."""
    rows = bpe.encode(docs.select("doc_id", "lang", "source", "text"), keep=False)
    return rows.select("doc_id", "lang", "source", F.expr("CAST(length(ids) DIV 4 AS BIGINT)").alias("n_tokens"), "ids")


STAGES = [("quality", good), ("near duplicates", single), ("secrets", clean), ("mixing", mixed), ("tokens", tokens)]

#: XXH64 fingerprints and byte-pair merges are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the shared checkpoint folder, and goes once the next stage is written.

    The last one's input stays, as its result is lazy. Nulls, empty tables and
    repeated rows are taken as the operators say.
    """
    docs = table(spark, sf_dir, "documents")
    place = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{place}/{k}")
            docs = spark.read.parquet(f"{place}/{k}")
            if k:
                delete(spark, f"{place}/{k - 1}")
    return docs
