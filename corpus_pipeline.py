"""The corpus pipeline: from raw documents to packed sequences, five stages of one operator each.

A stage takes what its predecessor kept and returns what stays, with the columns of documents;
the last returns packed pieces.  Between stages, the documents are a Parquet table in the shared
folder, so a lost executor never takes the work of an earlier stage with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventide.llm.common import dropped, table, written
from eventide.llm.decontaminate import drop_leaks
from eventide.llm.exact_dedup import drop_copies
from eventide.llm.minhash import drop_near_duplicates
from eventide.llm.packing import pack_documents
from eventide.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id stays."""
    return drop_copies(docs)


def minhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates, the one with the smallest doc_id stays."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left becomes pieces of sequences."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("minhash", minhash), ("decontaminate", decontaminate), ("packing", packing)]

#: The learnt classifier, the edit-distance search and the tokenizer are out of SQL's reach.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, stored; what the stages before it kept is deleted when the next one is stored."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last is not None:
            dropped(last)
        last = docs
    return docs
