"""Corpus pipeline: quality rules, exact dedup, SimHash near-dedup, mixing, byte-level BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stepwright.llm import bpe, common, exact, mixing, quality, setjoin, simhash


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_documents(docs)


def stage_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.keep_first(docs)


def stage_simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash groups, then what two bits miss: groups of five-word shingle sets of a similarity of 0.8."""
    return setjoin.keep_first(simhash.keep_first(docs), width=5, alike=80)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def stage_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, keep=("doc_id", "source"))


STAGES = [("quality", stage_quality), ("exact", stage_exact), ("simhash", stage_simhash), ("mixing", stage_mixing), ("bpe", stage_bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again.

    A stage's result is deleted once the next one's is written.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = common.shared_path(spark, f"pipeline-{name}")
        docs = common.write(stage(spark, docs, sf_dir), path)
        if last:
            common.forget(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)


#: Hashing into fingerprints, the hypergeometric draw and BPE have no SQL form; tests use brute force.
ORACLE_SQL = None
