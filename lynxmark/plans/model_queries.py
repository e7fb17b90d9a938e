"""Anomaly and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models
from ..operators.ranking import with_midrank
from ..operators.staging import stage
from .registry import Tables, query


def vectors(t: Tables):
    """The standardised vectors, a column for each component of the longest, and the columns' names."""
    width = t.embeddings.agg(F.max(F.size("embedding"))).first()[0] or 1
    names = [f"x{k}" for k in range(width)]
    rows = t.embeddings.select("vec_id", *(F.get("embedding", F.lit(k)).cast("double").alias(n) for k, n in enumerate(names)))
    return models.standardise(rows, names), names


@query()
def knn_outlier(t: Tables):
    z, names = vectors(t)
    return models.knn_scores(z, "vec_id", names)


@query()
def isolation_forest(t: Tables):
    z, names = vectors(t)
    return models.isolation_scores(z, "vec_id", names)


@query()
def combined_anomaly(t: Tables):
    z, names = vectors(t)
    z = stage(z, "anomaly-vectors")
    # The mid-ranks read the scores several times.
    both = stage(models.isolation_scores(z, "vec_id", names).join(models.knn_scores(z, "vec_id", names), "vec_id"), "anomaly-scores")
    ranked = with_midrank(with_midrank(both, "iforest", "a"), "knn", "b")
    return ranked.select("vec_id", ((0.6 * F.col("a") + 0.4 * F.col("b")) * 100).alias("anomaly"))


def features(t: Tables):
    text = F.col("text")
    words = F.size(F.split(text, " "))
    # Texts are measured where they are read; only numbers meet the labels.
    measured = t.documents.select(
        "doc_id", F.log1p(F.length(text)).alias("length"), (F.length(text) / words).alias("word"),
        (F.length(F.regexp_replace(text, r"[^A-Z]+", "")) / F.length(text)).alias("upper"), (F.length(F.regexp_replace(text, r"[A-Za-z\s]+", "")) / F.length(text)).alias("marks"),
    )
    labels = t.labels.select("doc_id", F.col("quality").cast("int").alias("y"))
    # Each pass for a median would read and measure all texts again.
    rows = stage(measured.join(labels, "doc_id"), "logistic-features")
    return models.standardise(rows, ["length", "word", "upper", "marks"], 6.0)


@query()
def logistic_scores(t: Tables):
    names = ["length", "word", "upper", "marks"]
    return models.out_of_fold(features(t), names, "y", "doc_id").select("doc_id", F.col("y").cast("int").alias("y"), "fold", "probability")
