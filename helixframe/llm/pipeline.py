"""Corpus pipeline: quality classifier, quality rules, SimHash near-dedup, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import importance, packing, quality_rules, simhash
from helixframe.llm.common import materialise, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return importance.filter_documents(docs, table(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, width=3)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, length=2048, end=1, crc=True)


STAGES = [
    ("quality classifier", classify),
    ("quality rules", rules),
    ("simhash near-dedup", near_dedup),
    ("packing", pack),
]

#: Importance weights, minimum covariance determinants and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
