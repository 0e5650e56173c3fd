"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate as _op6, html_extract as _op1, jaccard_join as _op3, media as _op2, mixing as _op5, perspectives as _op7, pitman_yor as _op8, substring_dedup as _op10, token_files as _op4, toxicity as _op9


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _op1.extract(_table(spark, sf_dir, "pages"))
    return d.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _op2.correct_types(_op2.text_media(_table(spark, sf_dir, "documents")))
    s = F.col("sniffed")
    payload = F.substring(F.col("media"), s["body_offset"] + 1, s["body_length"])
    d = d.select("doc_id", "n_bytes", "media", F.col("declared").alias("media_type"), payload.alias("payload"), s["feature"].alias("feature"))
    return d.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "media_type",
    )


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _op3.link_components(_table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _op4.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path())


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _op5.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _op6.summarize(_op6.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op7_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _op7.rotate(_table(spark, sf_dir, "conversations"))


def op8_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _op8.score(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    d = _op9.score(docs, _op9.fit(docs, _table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return d.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _op10.dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_extract, op2_media, op3_jaccard_join, op4_token_files, op5_mix, op6_decontaminate, op7_perspectives, op8_pitman_yor, op9_toxicity, op10_substring_dedup]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op7_perspectives": _op7.ORACLE_SQL}
