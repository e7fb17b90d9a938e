"""All validation measures of scores in one table, weights learnt from labels, warnings' lead time and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluation import auc, cumulative
from .models import logistic_model
from .scoring import WEIGHTS
from .staging import stage

#: Part of the ranking that is warned of.
FLAGGED = 5


def _rows(df: DataFrame, part: str, at: Column, values: dict[str, Column]) -> DataFrame:
    """``part, at, name, value`` from one wide table: a row for each value."""
    made = F.array(*(F.struct(F.lit(n).alias("name"), v.cast("double").alias("value")) for n, v in values.items()))
    return df.select(F.lit(part).alias("part"), at.cast("long").alias("at"), F.explode(made).alias("x")).select("part", "at", "x.*")


def bundle(df: DataFrame, score: str, label: str, tie: str, ks: tuple[int, ...] = (20, 50, 100), points: int = 60, buckets: int = 10) -> DataFrame:
    """All measures of one score: ``part, at, name, value``.

    Parts: ``whole`` (n, positives, base rate, AUC), ``curve`` (false and true
    positive rate and precision at every n // points-th place and the last),
    ``lift`` by bucket, ``at_k`` for those of ``ks`` that the table reaches, and
    ``confusion`` with the first fifth flagged.  The order is made once and
    staged; an empty table has the ``whole`` part only.
    """
    placed = stage(cumulative(df, score, label, tie).select("rank", "total", "tp", "fp", F.col(label).cast("long").alias("y")), "validation-places")
    ends = placed.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("p"))  # one row
    whole = ends.join(F.broadcast(auc(df, score, label).select("auc")))
    out = _rows(whole, "whole", F.lit(0), {"n": F.col("n"), "positives": F.col("p"), "base_rate": F.coalesce(F.round(F.try_divide(F.col("p"), F.col("n")), 4), F.lit(0.0)), "auc": F.round("auc", 4)})
    known = placed.join(F.broadcast(ends))
    rank, n, p, tp = (F.col(c) for c in ("rank", "n", "p", "tp"))
    step = F.greatest(F.lit(1), F.floor(n / points))
    curve = known.where((rank % step == 0) | (rank == n))
    out = out.union(_rows(curve, "curve", rank, {"fpr": F.round(F.try_divide(F.col("fp"), n - p), 4), "tpr": F.round(F.try_divide(tp, p), 4), "precision": F.round(tp / rank, 4)}))
    size = F.floor(n / buckets)
    bucket = F.floor(F.try_divide(rank - 1, size)) + 1
    per = known.withColumn("bucket", bucket).where(F.col("bucket") <= buckets).groupBy("bucket").agg(F.avg("y").alias("rate"), F.max(p / n).alias("base"))
    out = out.union(_rows(per, "lift", F.col("bucket"), {"rate": F.round("rate", 4), "lift": F.round(F.try_divide(F.col("rate"), F.col("base")), 2)}))
    base = F.greatest(F.round(p / n, 4), F.lit(1e-9))
    reached = known.where(rank.isin(*ks))
    out = out.union(_rows(reached, "at_k", rank, {"precision": F.round(tp / rank, 4), "recall": F.round(F.try_divide(tp, p), 4), "lift": F.round(tp / rank / base, 2)}))
    cut = F.greatest(F.lit(1), F.floor(n / FLAGGED))
    at = known.where(rank == cut)
    f1 = F.round(2 * tp / F.greatest(F.lit(1), p + rank), 4)
    return out.union(_rows(at, "confusion", rank, {
        "tp": tp, "fp": rank - tp, "fn": p - tp, "tn": n - rank - (p - tp), "precision": F.round(tp / rank, 4), "recall": F.round(tp / F.greatest(F.lit(1), p), 4), "f1": f1,
    }))


def dimension_auc(df: DataFrame, dims: tuple[str, ...], label: str) -> DataFrame:
    """AUC of each dimension alone; scores of two places, so that a dimension has some 10,000 distinct values at most."""
    made = F.array(*(F.struct(F.lit(d).alias("dimension"), F.round(F.col(d), 2).alias("s")) for d in dims))
    each = df.select(F.col(label).alias("y"), F.explode(made).alias("x")).select("y", "x.*")
    return auc(each, "s", "y", ["dimension"]).select("dimension", F.round("auc", 4).alias("auc"))


def calibrated_weights(df: DataFrame, label: str, current: dict[str, float] = WEIGHTS, l2: float = 0.05) -> dict[str, float]:
    """Weights from a logistic model on the dimension scores, centred and scaled: its positive coefficients, shared to 1.

    The current weights where no coefficient is positive or a class is missing.
    """
    dims = list(current)
    parts = df.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"), *(f(d).alias(f"{m}_{d}") for d in dims for m, f in (("mean", F.avg), ("sd", F.stddev)))).first()
    if not parts["p"] or not parts["n"]:
        return dict(current)
    scaled = df.select(label, *(((F.col(d) - parts[f"mean_{d}"]) / (parts[f"sd_{d}"] or 1.0)).alias(d) for d in dims))
    found = [max(0.0, float(c)) for c in logistic_model(scaled, dims, label, l2).coefficients]
    whole = sum(found)
    return {d: round(c / whole, 4) for d, c in zip(dims, found)} if whole > 0 else dict(current)


def lead_and_coverage(ranked: DataFrame, events: DataFrame, key: str, label: str, date: str, as_of: str, days: int = 365, rank: str = "rank") -> DataFrame:
    """One row: how long before their first event within ``days`` the first fifth of ``ranked`` was flagged, and how many of the positives it holds.

    Events on ``as_of`` or without a date do not count; zeros where nothing was hit.
    """
    start, day = F.lit(as_of).cast("date"), F.col(date).cast("date")
    first = events.where((day > start) & (day <= F.date_add(start, days))).groupBy(F.col(key).alias("_key")).agg(F.min(day).alias("_first"))
    ends = ranked.agg(F.count("*").alias("n"), F.coalesce(F.sum(label), F.lit(0)).cast("long").alias("total_positive"))
    cut = F.greatest(F.lit(1), F.floor(F.col("n") / FLAGGED))
    top = ranked.join(F.broadcast(ends)).where(F.col(rank) <= cut).select(key, cut.alias("_cut"))
    found = top.join(first, F.col(key) == F.col("_key"), "left").withColumn("d", F.datediff("_first", start))
    # Days are whole and at most ``days``: the exact median holds that many values.
    told = found.agg(
        F.count("*").alias("flagged"), F.count("d").alias("hit"), *(F.coalesce(c, F.lit(0)).alias(a) for a, c in (("mean_days", F.round(F.avg("d"), 1)), ("median_days", F.round(F.percentile("d", 0.5), 1)), ("min_days", F.min("d")), ("max_days", F.max("d")))),
    )
    both = told.join(F.broadcast(ends))
    pct = F.coalesce(F.round(F.try_divide(F.col("flagged") * 100, F.col("n")), 1), F.lit(0.0))
    return both.select("flagged", pct.alias("flagged_pct"), "hit", "total_positive", F.round(F.col("hit") / F.greatest(F.lit(1), F.col("total_positive")), 4).alias("recall"), "mean_days", "median_days", "min_days", "max_days")
