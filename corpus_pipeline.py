"""Corpus pipeline: quality rules, quality classifier, near-duplicate removal, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and
reread as the next one's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import near_dedup, packing, preference, quality_rules
from lodestone.llm.common import documents, persist_table

#: Similarity, in per cent, from which two documents are near duplicates.
PER_CENT = 80


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the n-gram ratio; null and empty texts fail, repeated rows are judged each."""
    ratios = quality_rules.fit_ratios(docs, quality_rules.trusted_ids(spark, sf_dir))
    judged = quality_rules.judge(docs.select(F.struct(*docs.columns).alias("row"), "text"), ratios)
    return judged.where("kept").select("row.*")


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise classifier predicts to be good; a null text counts as empty, repeated rows are judged each."""
    model = preference.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return preference.keep_good(docs, model)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates; null ids and texts without words stay."""
    return near_dedup.representatives(docs, PER_CENT)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of at most 2048 tokens; a null or empty text is its end id alone."""
    return packing.packed(docs)


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("near_dedup", near_dedup_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the hashed ratios nor the classifier, so the tests use a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and reread; no document gives no rows."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = persist_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
