"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genolake.llm import line_dedup, near_dedup, packing, quality_qda, quality_rules, shared


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: drops the documents that score below 0.3."""
    return quality_qda.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: drops the documents that the quality rules reject."""
    return quality_rules.keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: drops lines that three or more documents share, but in the newest; n_chars follows."""
    return line_dedup.cleaned(docs, line_dedup.keep_bitmaps(docs)).withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: one document of each near-duplicate class stays."""
    return near_dedup.representatives(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: sequences of 2048 ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", rules), ("line_dedup", lines), ("near_dedup", near_duplicates), ("packing", pack)]
#: The stages aren't expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written to the shared folder and read again, and what it was made from is deleted."""
    docs, begin = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared.mark()
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        shared.forget(begin, but=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
