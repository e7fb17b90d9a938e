"""The corpus pipeline: quality, near duplicates, secrets, mixing, token ids.

Each stage works on all that its predecessor kept.  ``run`` writes each stage's
result as Parquet in the shared folder and rereads it for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lynxmark.llm import bpe, mixing, quality, secrets, simhash
from lynxmark.llm.runtime import free_name, shared_path, temporary, write


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on ``labels``, scores 0.5 or more."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free_name(docs, "_score")
    return quality.score(docs, model, keep=docs.columns, out=score).where(F.col(score) >= 0.5).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of texts whose 5-word shingles are alike by 0.8 or more."""
    return simhash.keep_one_similar(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets found in them redacted."""
    return secrets.redact(docs, shared_path(spark, "secret-ledger"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: never, once or twice.  One without words is taken by none and goes."""
    return mixing.taken_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents and a digest of what they decode to."""
    encoded = bpe.encode_documents(docs.select("doc_id", "text"), bpe.word_vocabulary())
    return encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", source_mix),
    ("BPE encoding and decoding", token_ids),
]

#: No SQL: compression, 64-bit hashes and BPE have no DuckDB form; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        path = shared_path(spark, "pipeline-" + name.replace(" ", "-").lower())
        with temporary(spark):  # what a stage keeps for itself goes once its result is written
            write(function(spark, docs, sf_dir), path)
        docs = spark.read.parquet(path)
    return docs
