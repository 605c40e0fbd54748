"""The queries op1 to op10 and the pipeline, over the driver's tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ferrule.llm import bpe, exact_dedup, fingerprint, html_extract, lang_id, line_dedup, mixing, near_dup, quality, token_file

RANKS = "byte_bpe_multi_50k.tiktoken"
WORDS = "word_bpe_49k.json"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def op1_bpe(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_documents(_docs(spark, d), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, keep_ids=False)


def op2_language(spark: SparkSession, d: str) -> DataFrame:
    return lang_id.identify(_docs(spark, d))


def op3_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.grade(_docs(spark, d), spark.read.parquet(f"{d}/labels.parquet"))


def op4_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return exact_dedup.exact_groups(_docs(spark, d))


def op5_token_files(spark: SparkSession, d: str) -> DataFrame:
    return token_file.token_files(_docs(spark, d), public_tokenizers.path(WORDS))


def op6_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_documents(_docs(spark, d))


def op7_near_dup(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.near_groups(_docs(spark, d))


def op8_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return fingerprint.fingerprint_documents(_docs(spark, d))


def op9_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    return line_dedup.drop_boilerplate(spark.read.parquet(f"{d}/pages.parquet"))


def op10_html(spark: SparkSession, d: str) -> DataFrame:
    return html_extract.extract_pages(spark.read.parquet(f"{d}/pages.parquet"))


def pipeline(spark: SparkSession, d: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)


QUERIES = {f.__name__: f for f in (op1_bpe, op2_language, op3_quality, op4_exact_dedup, op5_token_files, op6_mix, op7_near_dup, op8_fingerprint, op9_line_dedup, op10_html, pipeline)}

ORACLES = {
    "op4_exact_dedup": r"""
      WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
      SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, h AS text_sha256 FROM t WINDOW w AS (PARTITION BY h)""",
    "op9_line_dedup": line_dedup.ORACLE,
}
