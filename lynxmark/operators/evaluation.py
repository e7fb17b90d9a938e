"""Validation measures of a score against 0/1 labels.

Curves and AUC first reduce the table to one row per distinct score (or per
position, where the order decides); running sums then follow ``ranking``'s
parts, so no task holds all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranking import with_midrank, with_position


def auc(df: DataFrame, score: str, label: str, groups: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve by mid-ranks (ties count half); 0.5 where one class is missing.

    With ``groups``, one value per group; those share a window per group over distinct scores.
    """
    y = F.col(label)
    if groups:
        per = df.groupBy(*groups, score).agg(F.sum(y).alias("p"), F.count("*").alias("n"))
        below = F.coalesce(F.sum(F.col("n") - F.col("p")).over(Window.partitionBy(*groups).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sums = per.withColumn("wins", F.col("p") * (below + (F.col("n") - F.col("p")) / 2)).groupBy(*groups)
        out = sums.agg(F.sum("wins").alias("w"), F.sum("p").alias("pos"), F.sum(F.col("n") - F.col("p")).alias("neg"))
        return out.select(*groups, F.coalesce(F.try_divide(F.col("w"), F.col("pos") * F.col("neg")), F.lit(0.5)).alias("auc"))
    ranked = with_midrank(df.select(score, label), score)
    s = ranked.agg(F.sum(F.when(y == 1, F.col("midrank"))).alias("r"), F.sum(y).alias("pos"), F.count("*").alias("n"))
    pos, neg = F.col("pos"), F.col("n") - F.col("pos")
    # sum of 1-based mid-ranks = n * sum(midrank) + pos / 2
    return s.select(F.coalesce(F.try_divide(F.col("r") * F.col("n") + pos / 2 - pos * (pos + 1) / 2, pos * neg), F.lit(0.5)).alias("auc"), pos.alias("positives"), neg.alias("negatives"))


def cumulative(df: DataFrame, score: str, label: str, tie: str) -> DataFrame:
    """``rank, total, tp, fp`` at each position of the descending order."""
    ranked = with_position(df.select(score, label, tie), score, [tie])
    size = 1 << 12  # positions of a block; blocks' sums are few, a block's rows are summed by themselves
    blocked = ranked.withColumn("_b", F.floor((F.col("rank") - 1) / size))
    sums = blocked.groupBy("_b").agg(F.sum(label).alias("_s"))
    bases = sums.select(F.col("_b").alias("_of"), F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = F.sum(label).over(Window.partitionBy("_b").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    out = blocked.withColumn("_in", inside).join(bases, F.col("_b") == F.col("_of"))
    return out.select("rank", "total", tie, score, label, (F.col("_base") + F.col("_in")).cast("long").alias("tp")).withColumn("fp", F.col("rank") - F.col("tp"))


def roc_points(df: DataFrame, score: str, label: str, tie: str, points: int = 60) -> DataFrame:
    """False and true positive rates at every n // points-th position and the last."""
    c = cumulative(df, score, label, tie)
    ends = df.agg(F.sum(label).alias("p"), F.count("*").alias("n"))
    step = F.greatest(F.lit(1), F.floor(F.col("total") / points))
    kept = c.where((F.col("rank") % step == 0) | (F.col("rank") == F.col("total"))).join(F.broadcast(ends))
    return kept.select("rank", F.try_divide(F.col("fp"), F.col("n") - F.col("p")).alias("fpr"), F.try_divide(F.col("tp"), F.col("p")).alias("tpr"), (F.col("tp") / F.col("rank")).alias("precision"))


def lift(df: DataFrame, score: str, label: str, tie: str, buckets: int = 10) -> DataFrame:
    """Hits by chunk of n // buckets positions; the remainder is left out."""
    ranked = with_position(df.select(score, label, tie), score, [tie])
    size = F.floor(F.col("total") / buckets)
    per = ranked.withColumn("bucket", F.floor((F.col("rank") - 1) / size) + 1).where(F.col("bucket") <= buckets).groupBy("bucket").agg(F.count("*").alias("n"), F.sum(label).cast("long").alias("hits"))
    base = df.agg((F.sum(label) / F.count("*")).alias("rate"))
    return per.join(F.broadcast(base)).select(F.col("bucket").cast("int").alias("bucket"), "n", "hits", F.try_divide(F.col("hits") / F.col("n"), F.col("rate")).alias("lift"))


def at_k(df: DataFrame, score: str, label: str, tie: str, ks: tuple[int, ...] = (20, 50, 100)) -> DataFrame:
    """Precision and recall among the k highest scores, for each k: a top-k, not a sort of all."""
    top = df.orderBy(F.desc(score), tie).limit(max(ks)).select(score, label, tie)
    rn = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), tie)))  # max(ks) rows
    all_ = df.agg(F.sum(label).alias("pos"))
    each = rn.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("rank <= k").groupBy("k").agg(F.count("*").alias("n"), F.sum(label).cast("long").alias("hits"))
    return each.join(F.broadcast(all_)).select("k", "hits", (F.col("hits") / F.col("n")).alias("precision"), F.try_divide(F.col("hits"), F.col("pos")).alias("recall"))
