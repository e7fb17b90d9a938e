"""Sentiment of posts by entity: counts, decayed weight, burst, score, topics, months, latest negatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import poisson_tail

#: Days: half-life, age of an undated post, recent window, baseline before it.
HALF_LIFE, UNDATED, RECENT, BASELINE = 180.0, 365, 30, 365


def entity_sentiment(posts: DataFrame, key: str, as_of: str) -> DataFrame:
    """One row per key of ``posts`` (key, day date, negative boolean, polarity, intensity, engagement), in one aggregation.

    A null day counts as a year old and in no window; null engagement is none.
    """
    at, age = F.to_date(F.lit(as_of)), F.datediff(F.to_date(F.lit(as_of)), F.col("day"))
    decay = F.pow(F.lit(0.5), F.greatest(F.lit(0), F.coalesce(age, F.lit(UNDATED))) / HALF_LIFE)
    weight = F.col("intensity") * decay * (1 + F.log10(1 + F.coalesce(F.col("engagement"), F.lit(0))) / 3)
    recent = (F.col("day") <= at) & (age < RECENT)
    base = (age >= RECENT) & (age < RECENT + BASELINE)
    found = posts.groupBy(key).agg(
        F.count("*").alias("n_posts"), F.count_if("negative").alias("n_negative"), F.avg("polarity").alias("avg_polarity"),
        F.coalesce(F.sum(F.when(F.col("negative"), weight)), F.lit(0.0)).alias("weighted_negative"), F.count_if(recent).alias("recent"), F.count_if(base).alias("_base"),
    )
    found = found.withColumn("expected", F.greatest(F.lit(0.15), F.col("_base") / float(BASELINE) * RECENT))
    found = found.withColumn("p_value", poisson_tail(F.col("recent"), F.col("expected"))).withColumn("neg_ratio", F.col("n_negative") / F.col("n_posts"))
    burst = F.when(F.col("recent") >= 2, (1 - F.col("p_value")) * 100 * F.least(F.lit(1.0), F.col("recent") / 6.0)).otherwise(0.0)
    score = F.least(F.lit(1.0), F.col("weighted_negative") / 6.0) * 62 + F.col("neg_ratio") * 20 + burst * 0.18
    return found.select(
        key, "n_posts", "n_negative", "neg_ratio", "avg_polarity", "weighted_negative", "recent", "expected", "p_value",
        ((F.col("recent") >= 3) & (F.col("p_value") < 0.05)).alias("burst"), F.least(F.lit(100.0), F.greatest(F.lit(0.0), score)).alias("score"),
    )


def negative_topics(posts: DataFrame, key: str, topic: str) -> DataFrame:
    """Negative posts by key and topic, with the topic's place within its key (count, then name)."""
    n = posts.where("negative").groupBy(key, topic).agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), topic)))


def month_counts(posts: DataFrame, key: str) -> DataFrame:
    """Dated posts and negatives by key and month."""
    return posts.where("day IS NOT NULL").groupBy(key, F.date_format("day", "yyyy-MM").alias("month")).agg(F.count("*").alias("total"), F.count_if("negative").alias("negative"))


def latest_negatives(posts: DataFrame, key: str, tie: str, n: int = 6) -> DataFrame:
    """The ``n`` latest negative posts of each key (day, then intensity, undated last), cut before the rows of a key meet."""
    order = Window.partitionBy(key).orderBy(F.desc_nulls_last("day"), F.desc_nulls_last("intensity"), tie)
    return posts.where("negative").withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def post_overview(posts: DataFrame, months: int = 30) -> DataFrame:
    """``kind, name, total, negative``: posts and negatives of the last ``months`` months, of each source and of all; ``posts`` has day, source and negative."""
    counts = (F.count("*").alias("total"), F.count_if("negative").alias("negative"))
    by_month = posts.where("day IS NOT NULL").groupBy(F.date_format("day", "yyyy-MM").alias("name")).agg(*counts).orderBy(F.desc("name")).limit(months)
    by_source = posts.groupBy(F.coalesce("source", F.lit("其他")).alias("name")).agg(*counts)
    whole = posts.agg(*counts).select(F.lit("posts").alias("name"), "total", "negative")
    return by_month.select(F.lit("month").alias("kind"), "*").union(by_source.select(F.lit("source"), "*")).union(whole.select(F.lit("all"), "*"))
