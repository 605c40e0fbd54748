"""The corpus pipeline: language, exact copies, near copies, mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read as the next
one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm import bpe, common, exact_dedup, lang_id, mixing, near_dup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document is rejected if no language is found, or none is likelier than this.
LEAST_SCORE = 0.35
#: Ids of dropped documents up to which they are broadcast; beyond it the join shuffles.
BROADCAST_IDS = 1_000_000


def _rows(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``row``: the id where ids are unique, else a number for each row, ascending by id and text."""
    if docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        return docs.withColumn("row", F.col("doc_id"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_last()]
    dealt = docs.repartitionByRange(common.partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    return common.stored(dealt.withColumn("row", F.monotonically_increasing_id()), "rows")


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` but those whose ``row`` is an id in ``dropped``; texts do not move while the list is small."""
    dropped = common.stored(dropped.select(F.col("doc_id").alias("__gone")).distinct(), "dropped")
    small = dropped.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(dropped) if small else dropped, F.col("row") == F.col("__gone"), "left_anti").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no recognisable language go: no letters, or no language of a score above LEAST_SCORE."""
    docs = _rows(docs)
    found = lang_id.identify(docs, "row")
    return _without(docs, found.where((F.col("lang_pred") == lang_id.UNKNOWN) | (F.col("score") < LEAST_SCORE)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row of the smallest id stays."""
    docs = _rows(docs)
    return _without(docs, exact_dedup.exact_groups(docs, "row").where(~F.col("kept")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row of the smallest id stays."""
    docs = _rows(docs)
    return _without(docs, near_dup.near_groups(docs, "row").where(~F.col("kept")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights: a row for each time the mix goes through a document, with the words it takes."""
    mixed = mixing.Mix(docs).texts()
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text of the mix: doc_id, n_tokens, ids_sha256, decoded_sha256, ids."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language", language), ("exact_dedup", exact), ("near_dup", near), ("mix", mix), ("bpe", tokens)]

#: No SQL expresses a trained network, confirmed similarities or the pseudorandom mix.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        common.discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
