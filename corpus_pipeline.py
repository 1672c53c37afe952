"""A corpus pipeline: quality, near-duplicates, secrets, source weights, pieces.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept and returns the columns of
``documents``; the last one returns pieces. ``run`` writes each stage's rows to the shared folder before the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, pieces, quality_compression, secret_scan, shingle_dedup
from tidemark.llm.common import prepared, saved
from tidemark.llm.queries import TARGETS, domains, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier takes for good; the others go."""
    return quality_compression.keep_good(docs, table(prepared(spark), sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with a five-word Jaccard similarity of 0.8 or more stays.

    The fingerprint trie and MinHash bands propose pairs, exact comparison decides.
    """
    prepared(spark)
    return shingle_dedup.unique_documents(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with each secret replaced by a mark."""
    prepared(spark)
    return secret_scan.redacted(docs, secret_scan.thresholds(docs))


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says, so that the domains' expected tokens meet their targets."""
    return mixing.mixed(docs, domains(table(prepared(spark), sf_dir, "labels")), TARGETS)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each whole text."""
    prepared(spark)
    coded = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), "doc_id")
    return coded.select("doc_id", F.size("ids").alias("n_pieces"), "ids")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("source_weights", source_weights),
    ("pieces", to_pieces),
]

#: SQL can express none of the models, fingerprints and tokenizers; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepared(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
