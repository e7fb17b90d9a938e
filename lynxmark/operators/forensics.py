"""Digit forensics, peer deviation and volatility."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import benford_share, clamp, first_digit, last_two, safe_div, sampling_mad

BENFORD = [math.log10(1 + 1 / d) for d in range(1, 10)]
#: Least amounts for a test of first digits, last digits and round numbers.
LEAST_FIRST, LEAST_LAST, LEAST_ROUND = 25, 60, 15
MAD_SCALE = 1.4826


def digit_counts(amounts: DataFrame, key: str, value: str) -> DataFrame:
    """One row per key with ``n`` and ``c1`` .. ``c9``: a map-side sum, no digit rows."""
    d = first_digit(F.col(value))
    rows = amounts.select(key, d.alias("_d")).where("_d is not null")
    return rows.groupBy(key).agg(F.count("*").alias("n"), *(F.count_if(F.col("_d") == k).alias(f"c{k}") for k in range(1, 10)))


def benford_test(amounts: DataFrame, key: str, value: str, least: int = LEAST_FIRST) -> DataFrame:
    """First-digit test for each key with ``least`` amounts: n, chi2, mad, p_value, mad_ratio, level, score."""
    n = F.col("n")
    counts = digit_counts(amounts, key, value).where(n >= least)
    chi2 = sum((F.col(f"c{d}") - n * p) * (F.col(f"c{d}") - n * p) / (n * p) for d, p in enumerate(BENFORD, 1))
    mad = sum(F.abs(F.col(f"c{d}") / n - p) for d, p in enumerate(BENFORD, 1)) / 9
    out = counts.select(key, "n", chi2.alias("chi2"), mad.alias("mad"), (mad / sampling_mad(BENFORD, n)).alias("mad_ratio"))
    h = F.col("chi2") / 2
    p = F.exp(-h) * (1 + h + h * h / 2 + h * h * h / 6)
    strength = F.least(-F.log10(F.greatest(p, F.lit(1e-12))) / 4, F.lit(1.0))
    large = n >= 5000
    level = F.when(large, F.when(F.col("mad") < 0.006, "close").when(F.col("mad") < 0.012, "acceptable").when(F.col("mad") < 0.015, "marginal").otherwise("nonconforming")).otherwise(
        F.when(F.col("mad_ratio") < 1.15, "close").when(F.col("mad_ratio") < 1.5, "acceptable").when(F.col("mad_ratio") < 2.0, "marginal").otherwise("nonconforming")
    )
    score = F.when(large, clamp((F.col("mad") - 0.006) / 0.024 * 100)).otherwise(clamp(100 * (0.65 * strength + 0.35 * clamp((F.col("mad_ratio") - 1.1) / 1.2, 0, 1))))
    return out.withColumn("p_value", p).withColumn("level", level).withColumn("score", score)


def leave_one_out(counts: DataFrame, key: str, group: str, least: int = LEAST_FIRST, pool_least: int = 2000) -> DataFrame:
    """Digits of each key against its group's other members; against all others where those have under ``pool_least`` amounts.

    ``counts`` has key, group, n and c1..c9.  Group and overall totals are
    aggregates joined back, so no key's rows are gathered.
    """
    names = ["n", *(f"c{d}" for d in range(1, 10))]
    per = counts.groupBy(group).agg(*(F.sum(c).alias(f"g_{c}") for c in names))
    all_ = counts.agg(*(F.sum(c).alias(f"t_{c}") for c in names))
    joined = counts.where(F.col("n") >= least).join(F.broadcast(all_)).join(per, group)
    near = F.col("g_n") - F.col("n") >= pool_least
    pool = {c: F.when(near, F.col(f"g_{c}") - F.col(c)).otherwise(F.col(f"t_{c}") - F.col(c)) for c in names}
    share = [pool[f"c{d}"] / pool["n"] for d in range(1, 10)]
    mad = sum(F.abs(F.col(f"c{d}") / F.col("n") - s) for d, s in enumerate(share, 1)) / 9
    base = sum(F.sqrt(2 * s * (1 - s) / (math.pi * F.col("n"))) for s in share) / 9
    return joined.where(pool["n"] > 0).select(key, group, "n", pool["n"].alias("pool"), mad.alias("mad"), safe_div(mad, base).alias("mad_ratio"))


def last_two_test(amounts: DataFrame, key: str, value: str, least: int = LEAST_LAST) -> DataFrame:
    """Uniformity of the last two digits: chi2 = 100 * sum(c**2) / n - n, empty bins by algebra."""
    rows = amounts.select(key, last_two(F.col(value)).alias("_e")).where("_e is not null").groupBy(key, "_e").agg(F.count("*").alias("_c"))
    per = rows.groupBy(key).agg(F.sum("_c").alias("n"), F.sum(F.col("_c") * F.col("_c")).alias("_q"), F.max("_c").alias("_m"))
    return per.where(F.col("n") >= least).select(key, "n", (100 * F.col("_q") / F.col("n") - F.col("n")).alias("chi2"), (F.col("_m") / F.col("n")).alias("max_share"))


def round_share(amounts: DataFrame, key: str, value: str, least: int = LEAST_ROUND) -> DataFrame:
    """Part of whole amounts that are multiples of 1000 and of 100, and the bias score."""
    whole = F.floor(F.abs(F.col(value))).cast("long")
    per = amounts.where(whole > 0).groupBy(key).agg(F.count("*").alias("n"), F.count_if(whole % 1000 == 0).alias("k"), F.count_if(whole % 100 == 0).alias("h"))
    share = F.col("k") / F.col("n")
    return per.where(F.col("n") >= least).select(key, "n", share.alias("share_1000"), (F.col("h") / F.col("n")).alias("share_100"), clamp((share - 0.02) / 0.15 * 100).alias("score"))


def robust_z(df: DataFrame, value: str, group: str, least: int = 5) -> DataFrame:
    """Adds ``z``: deviation from the group's median in scaled MADs; the deviation's scale is the sample standard deviation where the MAD is 0.

    Two aggregates by group, joined back: a group's values meet in no window.
    Groups below ``least`` members, and those without spread, give 0.
    """
    med = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.percentile(value, 0.5).alias("_med"), F.stddev_samp(value).alias("_sd"), F.count("*").alias("_n"))
    near = df.join(med, group, "left")
    mad = near.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("_g")).agg((F.percentile(F.abs(F.col(value) - F.col("_med")), 0.5) * MAD_SCALE).alias("_mad"))
    joined = near.join(mad, F.col(group) == F.col("_g"), "left")
    scale = F.when(F.col("_mad") > 0, F.col("_mad")).otherwise(F.col("_sd"))
    z = F.when((F.col("_n") >= least) & (scale > 0) & F.col(value).isNotNull(), (F.col(value) - F.col("_med")) / scale).otherwise(0.0)
    return joined.withColumn("z", z).drop("_g", "_sd", "_n", "_med", "_mad")


def deviation_score(z: Column, side: str = "both") -> Column:
    """0..100 from a robust z: (|z|, z or -z, by side, minus 1) / 3."""
    eff = {"both": F.abs(z), "high": F.greatest(F.lit(0.0), z), "low": F.greatest(F.lit(0.0), -z)}[side]
    return clamp((eff - 1) / 3 * 100)


def yoy(df: DataFrame, key: str, year: str, value: str) -> DataFrame:
    """Largest change between years that have a value other than zero: ``max_change`` and its score."""
    there = df.where(F.col(value).isNotNull() & (F.col(value) != 0))
    before = F.lag(value).over(Window.partitionBy(key).orderBy(year))
    steps = there.withColumn("_c", F.abs((F.col(value) - before) / F.abs(before)))
    return steps.groupBy(key).agg(F.count("*").alias("years"), F.max("_c").alias("max_change")).withColumn("score", F.coalesce(clamp((F.col("max_change") - 0.15) / 0.65 * 100), F.lit(0.0)))
