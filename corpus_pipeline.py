"""From raw documents to packed sequences: quality rules, near duplicates, personal
data, mixing, packing. Each stage works on all that the one before it kept, and all
but the last return the columns of ``documents``.

Defined results, besides those of the operators: a null or empty text fails the base quality rules and goes at
the first stage; very long texts are taken whole by each; of rows equal in id and text the near-duplicate stage keeps one, and
rows without an id stay; the mix may repeat a document, and cuts one only where a target ends; extra columns
pass to the stage before the last, and columns that stages make for themselves begin with two underscores or are dropped before; an empty
table passes all stages as an empty one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import minhash, mixing, packing, pii, quality
from corpusmill.llm.common import Written, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.apply(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.apply(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("source mix", source_mix),
    ("packing", packed_sequences),
]

#: Learned rules, boosted trees and tokenisation are not SQL: tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        written = Written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            before.drop()
        docs, before = written.df, written
    return docs
