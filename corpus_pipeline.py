"""From raw documents to packed training sequences, in five stages.

Each stage is written as Parquet to the cluster's shared folder and read again before the next.

Defined results of all stages: a null text counts as an empty one and stays until packing, which gives it its closing token; very long texts
are taken whole; rows that repeat a doc_id stay or go together; rows without a doc_id stay; columns beyond those of `documents`, whatever their
names, are kept up to packing; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.llm import common, decontaminate, line_dedup, neardup, packing, toxicity


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxicity.drop_toxic(docs, common.table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go from later ones; every document stays, n_chars follows its text."""
    out = line_dedup.dedup_lines(docs)
    n_chars = F.when(F.col("n_lines_deleted") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars.cast("long")).select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return neardup.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go."""
    return decontaminate.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest as sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [("toxicity", toxic), ("line dedup", lines), ("near duplicates", near), ("decontamination", clean), ("packing", packed)]
#: SQL can't express restoring, tokenizing or packing: tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir))
    return docs
