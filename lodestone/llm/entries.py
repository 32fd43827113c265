"""Queries of the training-data operators and their DuckDB twins, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from lodestone.llm import bpe, crf, fill_middle, imatch, near_dedup, packing, preference, quality_rules, runs, secret_scan, url_filter, warc, wavelet
from lodestone.llm.common import documents, pages

#: Similarity, in per cent, from which op8 links two documents.
OP8_PER_CENT = 85


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every text; null and empty texts have none, repeated rows stay rows of their own."""
    return bpe.round_trip(documents(spark, sf_dir))


def op2_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text; null counts as empty, equal texts have equal fingerprints."""
    return imatch.fingerprint_documents(documents(spark, sf_dir))


def op3_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048; a null or empty text is its end id alone."""
    return packing.packed(documents(spark, sf_dir))


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records and read back; a null or empty html is an empty payload, always a response."""
    return warc.round_trip(spark, sf_dir)


def op5_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text; null and empty texts are scored as empty, repeated rows each by themselves."""
    return preference.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_ngram_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the n-gram ratio's verdict of every text; null and empty texts have no words and fail."""
    return quality_rules.apply_rules(documents(spark, sf_dir), quality_rules.trusted_ids(spark, sf_dir))


def op7_url_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every url; null or without a scheme: empty host and path."""
    return url_filter.filter_urls(pages(spark, sf_dir))


def op8_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document; texts without words stand alone, equal texts and repeated rows are one class."""
    return near_dedup.near_duplicates(documents(spark, sf_dir), OP8_PER_CENT)


def op9_crf_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; a null or empty html has the empty text, repeated rows are extracted each."""
    return crf.extract(pages(spark, sf_dir))


def op10_wavelet_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents written as wavelet matrices by ascending id and read back; a null or empty text is its end id alone."""
    return wavelet.round_trip(documents(spark, sf_dir))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text arranged for filling in its middle and restored; null and empty texts and those with a marker stay plain."""
    return fill_middle.fill_digests(documents(spark, sf_dir))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words of every text, a tenth of them with a planted periodic end; null and empty texts have none."""
    return runs.run_digests(runs.planted(documents(spark, sf_dir)))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text by one automaton of all rules; null and empty texts have none, repeated rows are scanned each."""
    return secret_scan.secret_digests(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage of corpus_pipeline over all documents."""
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_byte_bpe": op1_byte_bpe,
        "op2_imatch": op2_imatch,
        "op3_cost_packing": op3_cost_packing,
        "op4_warc_round_trip": op4_warc_round_trip,
        "op5_bradley_terry": op5_bradley_terry,
        "op6_ngram_ratio": op6_ngram_ratio,
        "op7_url_trie": op7_url_trie,
        "op8_minhash_forest": op8_minhash_forest,
        "op9_crf_main_text": op9_crf_main_text,
        "pipeline": pipeline,
        "op10_wavelet_files": op10_wavelet_files,
        "op11_fill_middle": op11_fill_middle,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_secret_scan": op13_secret_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_warc_round_trip": warc.ROUND_TRIP_SQL,
        "op7_url_trie": url_filter.FILTER_SQL,
        "op11_fill_middle": fill_middle.FILL_SQL,
        "op13_secret_scan": secret_scan.SCAN_SQL,
    }
