"""The queries of the training-data operators over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.llm.ann import nearest
from meshwork.llm.common import table
from meshwork.llm.decontaminate import CONTAMINATION_SQL, contamination
from meshwork.llm.jaccard import CLASSES_SQL, similar_classes
from meshwork.llm.langid import predict
from meshwork.llm.quality import quality_scores
from meshwork.llm.secrets import secrets, secrets_sql
from meshwork.llm.sentencepiece_codec import piece_digests
from meshwork.llm.token_counts import token_counts
from meshwork.llm.url_filter import judge_sql, judge_urls
from meshwork.llm.warc import ROUND_TRIP_SQL, archive_round_trip


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % 50 == 0), k=5)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"), min_revisit_bytes=0)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(table(spark, sf_dir, "documents"), words=5, percent=80)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


QUERIES = {
    "op1_hash_prefix_forest": op1_hash_prefix_forest,
    "op2_url_filter": op2_url_filter,
    "op3_decontamination": op3_decontamination,
    "op4_language_id": op4_language_id,
    "op5_secrets": op5_secrets,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_warc": op7_warc,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_quality": op9_quality,
    "op10_token_counts": op10_token_counts,
}

ORACLES = {
    "op2_url_filter": judge_sql(),
    "op3_decontamination": CONTAMINATION_SQL.replace("{window}", "10"),
    "op5_secrets": secrets_sql(),
    "op7_warc": ROUND_TRIP_SQL,
    "op8_ngram_jaccard": CLASSES_SQL,
}
