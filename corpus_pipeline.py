"""A corpus pipeline over the operators of quillmill.llm: each stage reads what the one before it kept and wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillmill.llm import decontam, mixing, neardup, secrets, toxicity
from quillmill.llm.common import remove, shared_folder, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier, trained on the labelled ones among docs, scores 0.5 or more."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8 or more."""
    return neardup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that share ten consecutive words, or a whole shorter item, with the benchmark."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts become a mark."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight takes it."""
    return mixing.mix(docs)


STAGES = [("toxicity", reject_toxic), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("secrets", redact_secrets), ("mixing", mix)]
#: SQL can't express the classifiers and the fingerprints; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written as Parquet in the shared folder and read again; a table goes once
    the next one is whole."""
    top = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{top}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
