"""The corpus pipeline: quality, near-duplicates, benchmark leaks, source mix, token ids.

Every stage works on all that the one before it kept. All but the last return the columns of
``documents``; the last returns the digest of the token store it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sensorloom.llm import decontaminate, mixing, neardup, quality, tokenstore
from sensorloom.llm.common import read, stage
from sensorloom.llm.queries import vocabulary

#: The default for near-duplicate stages on word shingles.
SHINGLE, PERCENT = 5, 80


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep(docs, size=SHINGLE, percent=PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokenstore.report(docs, vocabulary())


STAGES = [
    ("quality", drop_low_quality),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token ids", write_token_ids),
]

#: Learned scores and random draws aren't SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline{k}")
    return docs
