"""The corpus pipeline: quality, exact copies, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; its result is written as
Parquet and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, packing, quality, resemblance, suffix
from tidemark.llm.common import numbered, table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier scores at 0.5 or more; fitted on the labelled documents it is given."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model, only=0.5, score_col="_quality").drop("_quality")


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the one with the largest id, of equals the first."""
    rows = numbered(docs)
    return rows.join(exact_dedup.one_each(rows.select("rid", "id", "text")), "rid", "left_semi").select("doc.*")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (SimHash of five-word shingles finds them, resemblance 0.8 or more decides): the one with the smallest id, of equals the first; a null id comes last."""
    rows = numbered(docs)
    classes = written(resemblance.near_classes(rows.select("rid", "text")).join(rows.select("rid", "id"), "rid"), "classes")
    lead = F.coalesce(F.min(F.when(F.col("id").isNotNull(), F.col("rid"))), F.min("rid"))
    leads = classes.groupBy("root").agg(lead.alias("rid")).select("rid")
    return rows.join(classes.join(leads, "rid", "left_anti").select("rid"), "rid", "left_anti").select("doc.*")


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of over 50 words, or of 400 bytes, that also start elsewhere; n_chars follows the text."""
    return suffix.without_repeats(docs, readings=(suffix.BYTES, suffix.WORDS)).withColumn("n_chars", F.char_length("text").cast("bigint")).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
