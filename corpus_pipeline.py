"""From raw documents to token files: toxicity, near duplicates, benchmark contamination, mixing, output.

Each stage takes what the one before kept, as rows of ``documents``; the last
returns, for each document in the files that it wrote, doc_id, start, n_tokens
and ids_crc32. Stages are written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from texloom.llm import decontaminate, jaccard_join, mixing, token_files, toxicity
from texloom.llm.queries import tokenizer_path
from texloom.llm.shared import cut


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, _table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.dedup(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; from others the few hit words go, and n_chars follows."""
    out = decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.round_trip(docs, tokenizer_path())


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", remove_benchmark),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: SQL can't express the stages; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs, name)
    return docs
