"""The registered queries: each runs its operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, fm_index, hamming_search, license_scan, merkle, mixing, packing, periodic_runs, quality, sentence_pieces, simhash, suffix, url_filter
from tidemark.llm.common import table


def op1_exact_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return hamming_search.nearest(vectors, vectors.where(F.col("vec_id") % hamming_search.QUERY_STEP == 0))


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(table(spark, folder, "documents"))


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"))


def op4_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return sentence_pieces.encoding_digests(table(spark, folder, "documents"), packing.vocabulary("piece_bpe_32k.model"))


def op6_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix.repeated_passages(table(spark, folder, "documents"), words=suffix.WORDS)


def op7_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_groups(table(spark, folder, "documents"))


def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return fm_index.repeated_windows(table(spark, folder, "documents")).drop("kept")


def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judged(table(spark, folder, "pages"), url_filter.fit(url_filter.labelled_urls(spark)))


def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, folder, "documents")).drop("bucket")


def op11_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(table(spark, folder, "documents")).drop("copies")


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.tamper_check(table(spark, folder, "documents"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.run_digests(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_topk_search, op2_license_scan, op3_packing, op4_quality_classifier, op5_sentencepiece, op6_suffix_array_dedup,
        op7_simhash_near_dedup, op8_substring_dedup, op9_url_filter, op10_exact_dedup, op11_source_mixing, op12_merkle_manifest, op13_periodic_runs,
    )
}
ORACLE: dict[str, str] = {
    "op1_exact_topk_search": hamming_search.oracle(), "op2_license_scan": license_scan.oracle(), "op10_exact_dedup": exact_dedup.ORACLE,
    "op11_source_mixing": mixing.oracle(), "op12_merkle_manifest": merkle.ORACLE,
}
