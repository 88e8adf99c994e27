"""Registered queries of this subpackage and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from corpusloom.llm import archive, bpe, clustering, decontaminate, langid, licenses, linededup, media, minhash, ngram, oracles, quality, resampling, substrings
from corpusloom.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_report(documents(spark, sf_dir))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(documents(spark, sf_dir), words=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.perplexity_report(documents(spark, sf_dir))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(documents(spark, sf_dir))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(documents(spark, sf_dir))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(documents(spark, sf_dir), path, public_tokenizers.PATTERN, keep_ids=False)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(documents(spark, sf_dir))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_report(documents(spark, sf_dir))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.archive_report(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Query]:
    return {
        "op1_media": op1_media,
        "op2_minhash": op2_minhash,
        "op3_quality": op3_quality,
        "op4_ngram": op4_ngram,
        "op5_line_dedup": op5_line_dedup,
        "op6_licenses": op6_licenses,
        "op7_bpe": op7_bpe,
        "op8_language": op8_language,
        "op9_substrings": op9_substrings,
        "op10_decontaminate": op10_decontaminate,
        "op11_archive": op11_archive,
        "op12_clusters": op12_clusters,
        "op13_resampling": op13_resampling,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    found = {
        "op2_minhash": oracles.near_duplicates(),
        "op5_line_dedup": oracles.line_dedup(),
        "op6_licenses": licenses.report_sql(),
        "op9_substrings": oracles.substrings(),
        "op10_decontaminate": oracles.decontamination(),
        "op11_archive": archive.report_sql(),
        "op12_clusters": clustering.report_sql(),
        "op13_resampling": resampling.report_sql(),
    }
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
