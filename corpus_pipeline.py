"""A corpus pipeline of five stages; each is one operator of ledgerloom.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of
documents. An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import bpe, mixing, near_dedup, rule_ensemble, secret_scan
from ledgerloom.llm.common import cut, table

#: Words in a shingle of the near-duplicate stage.
SHINGLE = 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go."""
    return rule_ensemble.keep_good(docs, rule_ensemble.fit_on(docs, table(spark, sf_dir, "labels")))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the least doc_id."""
    return near_dedup.keep_one(docs, SHINGLE)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are redacted; every document stays."""
    return secret_scan.redact_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken as often as the mix wants them, up to three times."""
    return mixing.sample_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of ids and of the decoded text, and the ids of each row."""
    return bpe.round_trip_digests(docs, with_ids=True)


STAGES = [("quality classifier", quality), ("near-duplicates", dedup), ("secret scan", secrets), ("source mix", mix), ("bpe", encode)]
#: Trees, sketches and merge lists can't be stated in SQL; a test holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
