"""Dimension, rule and final scores, reasons, actions, roll-ups and schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import band, clamp, rounded, weighted_mean
from .ranking import with_position

#: Weights of the dimensions and the model's share in the final score.
WEIGHTS = {"compliance": 0.35, "financial": 0.29, "evaluation": 0.12, "sentiment": 0.24}
BLEND = 0.25
BANDS = ("critical", "high", "medium", "low", "minimal")
#: Days until due and hours of a visit for the bands that have a wave of their own, and for all others.
WAVES = {"critical": (7, 8.0), "high": (14, 6.0), "medium": (30, 3.5)}
LAST_WAVE = (60, 2.5)
#: Weight of a reason of each level in the rule-based review.
LEVELS = {"critical": 40, "high": 22, "medium": 10, "low": 4}

# For each dimension its features, the weight of each, and how the feature becomes a score (factor, then offset).
DIMENSIONS = {
    "compliance": (
        ("pen_decay", 0.28, 100 / 6, 0.0),
        ("pen_count_1y", 0.18, 35.0, 0.0),
        ("pen_severe", 0.16, 40.0, 0.0),
        ("pen_repeat", 0.12, 30.0, 0.0),
        ("pen_fine_total_log", 0.08, 1 / 3000, 0.0),
        ("pen_recency", 0.11, 100.0, 0.0),
        ("pen_disp_sev", 0.07, 50.0, -50.0),
    ),
    "financial": (
        ("dev_max", 0.23, 1.0, 0.0),
        ("dev_mean", 0.11, 1.0, 0.0),
        ("last2_score", 0.20, 1.0, 0.0),
        ("round_score", 0.12, 1.0, 0.0),
        ("yoy_expense_score", 0.13, 1.0, 0.0),
        ("anomaly_score", 0.15, 1.0, 0.0),
        ("first_digit_score", 0.06, 1.0, 0.0),
    ),
    "evaluation": (
        ("eval_penalty", 0.55, 1.0, 0.0),
        ("eval_items_failed", 0.25, 20.0, 0.0),
        ("eval_fail_history", 0.20, 45.0, 0.0),
    ),
    "sentiment": (
        ("senti_score", 0.72, 1.0, 0.0),
        ("senti_burst", 0.16, 1.0, 0.0),
        ("senti_child_topic", 0.12, 35.0, 0.0),
    ),
}
#: Features that count as 0 (disposition: as 1) where they are missing; others take no part then.
ZERO = {f for f, *_ in DIMENSIONS["compliance"]} | {"eval_items_failed", "eval_fail_history", "senti_child_topic"}


def dimension_score(name: str, features: dict[str, Column]) -> Column:
    """Weighted mean of the dimension's features, each scaled and clamped to 0..100, to two places; 0 where none is there.

    ``pen_fine_total_log`` is the common logarithm of 1 plus the fines and is
    undone first.  Without financial statements (``fin_available`` is not 1) the
    financial score is the anomaly score alone.
    """

    def scaled(feature: str, factor: float, offset: float) -> Column:
        value = features.get(feature, F.lit(None)).cast("double")
        if feature in ZERO:
            value = F.coalesce(value, F.lit(0.0))
        if feature == "pen_disp_sev":
            value = F.when(value == 0, 1.0).otherwise(value)
        if feature == "pen_fine_total_log":
            value = F.pow(F.lit(10.0), value)
        return clamp(value * factor + offset)

    score = weighted_mean((scaled(f, factor, offset), w) for f, w, factor, offset in DIMENSIONS[name])
    if name == "financial":
        score = F.when(F.coalesce(features.get("fin_available", F.lit(None)).cast("double"), F.lit(0.0)) == 1, score).otherwise(weighted_mean([(scaled("anomaly_score", 1.0, 0.0), 1.0)]))
    return rounded(score, 2)


def rule_score(dims: dict[str, Column], available: dict[str, Column] | None = None, weights: dict[str, float] = WEIGHTS) -> Column:
    """Weighted mean over the available dimensions, weights shared anew among them."""
    have = available or {}
    return weighted_mean((F.when(have.get(d, F.lit(True)), dims[d]), w) for d, w in weights.items())


def final_score(rule: Column, model: Column, blend: float = BLEND) -> Column:
    """Rule and model score blended; the rule score alone where there is no model score."""
    b = max(0.0, min(1.0, blend))
    return F.when(model.isNull(), rule).otherwise(rule * (1 - b) + model * b)


def ranked(df: DataFrame, score: str, tie: str) -> DataFrame:
    """Adds rank, total, percentile and band."""
    out = with_position(df, score, [tie])
    return out.withColumn("percentile", (1 - (F.col("rank") - 1) / F.col("total")) * 100).withColumn("band", band(F.col("rank"), F.col("total")))


def reasons(rules: list[tuple[Column, str, Column]]) -> Column:
    """Array of (level order, position, level, title) for the rules that hold, most serious first."""
    order = {level: k for k, level in enumerate(LEVELS)}
    made = [
        F.when(cond, F.struct(F.lit(order[level]).alias("order"), F.lit(k).alias("place"), F.lit(level).alias("level"), title.alias("title"))) for k, (cond, level, title) in enumerate(rules)
    ]
    return F.sort_array(F.array_compact(F.array(*made)))


def review_score(found: Column) -> Column:
    """Sum of the reasons' weights, at most 100."""
    weight = F.create_map(*(F.lit(x) for pair in LEVELS.items() for x in pair))
    return F.least(F.lit(100), F.aggregate(found, F.lit(0), lambda a, r: a + weight[r["level"]]))


def review_level(score: Column, found: Column) -> Column:
    critical = F.exists(found, lambda r: r["level"] == "critical")
    return F.when(critical | (score >= 70), "critical").when(score >= 45, "high").when(score >= 22, "medium").when(score > 0, "low").otherwise("none")


def schedule(df: DataFrame, capacity: int, start: str, rank: str = "rank") -> DataFrame:
    """The ``capacity`` first rows with wave, due date and hours; ``df`` has rank and band.

    Bands without a wave of their own come in the last one.
    """

    def by_band(value) -> Column:
        out = F.lit(value(len(WAVES) + 1, *LAST_WAVE))
        for k, (b, (days, hours)) in enumerate(WAVES.items(), 1):
            out = F.when(F.col("band") == b, value(k, days, hours)).otherwise(out)
        return out

    picked = df.where(F.col(rank) <= max(1, capacity))
    due = F.date_add(F.lit(start).cast("date"), by_band(lambda k, days, hours: days))
    return picked.withColumn("wave", by_band(lambda k, days, hours: k)).withColumn("due", due).withColumn("hours", by_band(lambda k, days, hours: hours))


def routes(df: DataFrame, city: str, district: str, score: str, name: str, most: int = 30) -> DataFrame:
    """The ``most`` places with most visits, then best score: count, best and mean score, trips saved, members by falling score.

    Members are gathered for those places only.
    """
    place = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(a) for c, a in ((city, "city"), (district, "district"))), F.col(score).alias("_score"), F.col(name).alias("_name"))
    per = place.groupBy("city", "district").agg(F.count("*").alias("visits"), F.max("_score").alias("max_score"), F.avg("_score").alias("mean_score"), F.greatest(F.lit(0), F.count("*") - 1).cast("long").alias("saved"))
    top = per.orderBy(F.desc("visits"), F.desc("max_score"), "city", "district").limit(most)
    # ``most`` rows are broadcast.
    members = place.join(F.broadcast(top.select("city", "district")), ["city", "district"]).groupBy("city", "district").agg(F.sort_array(F.collect_list(F.struct((-F.col("_score")).alias("s"), F.col("_name").alias("n")))).alias("m"))
    return top.join(members, ["city", "district"]).withColumn("members", F.array_join(F.transform("m", lambda x: x["n"]), ",")).drop("m")
