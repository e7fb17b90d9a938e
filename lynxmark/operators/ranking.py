"""Positions in a whole table without one task that sorts it all.

A table is cut by quantiles of the ordering value into parts; each part is
ranked by itself and starts where the parts before end.  The quantiles
(``PARTS`` numbers) and the parts' counts are all that is known centrally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PARTS = 128


def _parted(df: DataFrame, score: str) -> DataFrame:
    """With ``_part``: larger scores in smaller parts; equal scores together; null scores in the last."""
    marks = df.agg(F.percentile_approx(score, [k / PARTS for k in range(1, PARTS)], 10_000).alias("q")).first().q or []
    marks = sorted(set(marks))
    part = F.lit(len(marks)) - sum((F.when(F.col(score) > m, 1).otherwise(0) for m in marks), F.lit(0)) if marks else F.lit(0)
    return df.withColumn("_part", F.when(F.col(score).isNull(), len(marks) + 1).otherwise(part).cast("int"))


def with_position(df: DataFrame, score: str, ties: list[Column | str], name: str = "rank", total: str | None = "total") -> DataFrame:
    """Adds ``name``, 1 for the largest score, ties in the order of ``ties``; and ``total``, the number of rows."""
    parted = _parted(df, score)
    counts = parted.groupBy("_part").agg(F.count("*").alias("_n"))  # at most PARTS + 1 rows
    bases = counts.select(
        F.col("_part").alias("_of"),
        F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
        F.sum("_n").over(Window.partitionBy()).alias("_all"),
    )
    inside = Window.partitionBy("_part").orderBy(F.col(score).desc_nulls_last(), *ties)
    out = parted.withColumn("_rn", F.row_number().over(inside)).join(F.broadcast(bases), F.col("_part") == F.col("_of"))
    out = out.withColumn(name, (F.col("_base") + F.col("_rn")).cast("long"))
    if total:
        out = out.withColumn(total, F.col("_all").cast("long"))
    return out.drop("_part", "_of", "_base", "_all", "_rn")


def with_midrank(df: DataFrame, score: str, name: str = "midrank") -> DataFrame:
    """Adds the part of rows below plus half of the rows equal: (below + equal / 2) / n."""
    per = df.groupBy(score).agg(F.count("*").alias("_equal"))
    parted = _parted(per, score)
    parts = parted.groupBy("_part").agg(F.sum("_equal").alias("_n"))
    bases = parts.select(
        F.col("_part").alias("_of"),
        F.coalesce(F.sum("_n").over(Window.orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
        F.sum("_n").over(Window.partitionBy()).alias("_all"),
    )
    before = Window.partitionBy("_part").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    below = parted.withColumn("_below", F.coalesce(F.sum("_equal").over(before), F.lit(0))).join(F.broadcast(bases), F.col("_part") == F.col("_of"))
    ranked = below.select(F.col(score).alias("_score"), ((F.col("_base") + F.col("_below") + F.col("_equal") / 2) / F.col("_all")).alias(name))
    return df.join(ranked, df[score].eqNullSafe(ranked["_score"])).drop("_score")


def whole_quantiles(df: DataFrame, value: str, shares: tuple[float, ...]) -> DataFrame:
    """One row: ``n`` and the exact linear quantiles ``q0``, ``q1``, ... of all values that are not null.

    Equal values are one row with their count, so a frequent value is no hot spot.
    """
    per = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_equal"))
    parted = _parted(per, value)
    parts = parted.groupBy("_part").agg(F.sum("_equal").alias("_n"))
    bases = parts.select(
        F.col("_part").alias("_of"),
        F.coalesce(F.sum("_n").over(Window.orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
        F.sum("_n").over(Window.partitionBy()).alias("_all"),
    )
    before = Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = parted.withColumn("_below", F.coalesce(F.sum("_equal").over(before), F.lit(0))).join(F.broadcast(bases), F.col("_part") == F.col("_of"))
    start = F.col("_base") + F.col("_below")
    at = lambda place: F.max(F.when((start <= place) & (place < start + F.col("_equal")), F.col(value)))
    spots = [(F.col("_all") - 1) * share for share in shares]
    found = placed.agg(F.max("_all").alias("_all"), *(at(edge(spot)).alias(f"_{name}{i}") for i, spot in enumerate(spots) for name, edge in (("low", F.floor), ("high", F.ceil))))
    part = [spot - F.floor(spot) for spot in spots]
    return found.select(F.coalesce("_all", F.lit(0)).alias("n"), *((F.col(f"_low{i}") + (F.col(f"_high{i}") - F.col(f"_low{i}")) * p).alias(f"q{i}") for i, p in enumerate(part)))


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key; one row is kept while rows of a key are gathered, so a hot key costs no more."""
    names = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*")


def keep_first(df: DataFrame, keys: list[Column], order: str) -> DataFrame:
    """The first row of each key by ``order``: keep-first deduplication."""
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    names = df.columns
    best = df.select("*", *named).groupBy(*(f"_k{i}" for i in range(len(keys)))).agg(F.min_by(F.struct(*names), order).alias("_row"))
    return best.select("_row.*")
