"""From raw documents to tokens: each stage works on all that the one before has kept.

Nulls, empty and very long texts, repeated rows, empty tables and columns with other names have the results that the
operators define (see the modules of muster.llm).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from muster.llm import bpe, common, exact_dedup, mixing, quality_rules, simhash


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs, common.table(spark, sf_dir, "labels"))


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints."""
    return simhash.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which the sources are mixed."""
    return mixing.interleaved(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digests of the tokens of each document."""
    return bpe.digests(docs)


STAGES = [("quality rules", rules), ("exact dedup", copies), ("simhash near-dedup", near_copies), ("mixing", mixed), ("byte-level BPE", tokens)]

#: The SimHash and BPE stages have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
