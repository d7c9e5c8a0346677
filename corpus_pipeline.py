"""A training corpus from raw documents: each stage calls one operator of ``rollcall.llm`` on all its predecessor kept.

Defined cases: each stage's operator states how it treats nulls, blank and long texts, ties, repeated rows and empty
tables. Extra columns pass through, whatever their names; one named like a column the last stage adds gets ``_input``
added to its name there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rollcall.llm import bpe, exact_dedup, mixing, quality, simhash
from rollcall.llm.queries import vocabulary_path
from rollcall.llm.storage import documents, settle, ship


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality scorer keeps."""
    ship(spark)
    return quality.keep_good(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    ship(spark)
    return exact_dedup.keep_first_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: fingerprints of four-word shingles at most four bits apart."""
    ship(spark)
    return simhash.keep_first_of_groups(docs, width=4, radius=4)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    ship(spark)
    return mixing.take_mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document, and the text they decode to."""
    ship(spark)
    return bpe.encode_tokens(docs, vocabulary_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mix", mixed),
    ("encode", encoded),
]

# Fingerprints, trained scores and byte-pair merges are beyond SQL; tests compare run() with its stages, and the two
# dedup stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
