"""A training-data pipeline: quality, repeated lines, near duplicates, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; `run` writes every stage's rows to the shared
folder as Parquet and reads them again, so that a lost executor costs a task and not a stage.

Each stage follows its operator: a null text is an empty one, an empty text has a score, no lines, no set, no benchmark words and no
tokens, and stays unless its score is too low. Rows with a null doc_id take part. Repeated rows count as one document for lines and near
duplicates (one of them stays) and are scored, searched and encoded one by one. Ties go to the smallest doc_id. Texts of any length are
read whole. Empty tables give empty results. Extra columns, whatever their names, go along up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, decontaminate, linededup, minhash, quality
from corpusloom.llm.common import documents, scratch_folder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects (score below 0.3)."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated runs of lines with at least eight words; every document stays, n_chars follows its text."""
    return linededup.drop_repeated_lines(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at a similarity of 0.8 over five words: that of the smallest doc_id."""
    return minhash.drop_near_duplicates(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents of whose words at least 5 % lie in benchmark passages."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and decoded text."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", lines_stage),
    ("near_dedup", near_duplicates_stage),
    ("decontamination", benchmark_stage),
    ("tokens", tokens_stage),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        folder = scratch_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
