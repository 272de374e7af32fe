"""A corpus pipeline: language, near duplicates, benchmark passages, secrets, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.llm import decontaminate, jaccard, langid, secrets, sentencepiece_codec
from meshwork.llm.common import materialize, table
from meshwork.llm.queries import tokenizer_path

def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected; lang becomes the predicted language. Nulls and texts without letters go."""
    model = langid.train(docs)
    kept = langid.identify(docs, model).where(~F.col("_rejected"))
    return kept.select(*[F.col("_lang").alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked documents the one with the smallest id."""
    return jaccard.deduplicate(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of the benchmark out of texts; documents of which they are more than half go."""
    judged = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).where(~F.col("_hits.drop"))
    text = F.col("_hits.clean_text")
    fresh = {"text": text, "n_chars": F.when(F.col("_hits.n_hit") > 0, F.length(text)).otherwise(F.col("n_chars")).cast("long")}
    return judged.select(*[fresh.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in texts; every document stays."""
    done = secrets.redact(docs)
    return done.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_pieces, ids of each document's text; a null text has null ids and no pieces."""
    done = sentencepiece_codec.encode(docs, tokenizer_path("piece_bpe_32k.model"))
    return done.select("doc_id", "lang", "source", F.coalesce(F.size("ids"), F.lit(0)).alias("n_pieces"), "ids")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("secret_scan", secret_scan),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Clustering, the transitive closure and Viterbi paths are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None
