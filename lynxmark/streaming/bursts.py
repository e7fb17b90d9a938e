"""Sliding counts of events and their bursts; the same plan serves a stream and a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import poisson_tail


def sliding_counts(events: DataFrame, key: str = "user_id", ts: str = "ts", width: str = "7 days", slide: str = "1 day", late: str = "2 days") -> DataFrame:
    """``key, start, end, n`` for each window that holds an event.  On a stream, events later than ``late`` behind the newest go and closed windows leave the state."""
    told = events.withWatermark(ts, late).groupBy(F.window(ts, width, slide).alias("w"), F.col(key)).agg(F.count("*").alias("n"))
    return told.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def bursts(counts: DataFrame, rates: DataFrame, key: str = "user_id", least: int = 3, level: float = 0.01) -> DataFrame:
    """Windows of ``least`` events or more that a Poisson law with the key's ``rate`` for a window gives a chance under ``level``.  ``rates`` is a table: a stream meets it without state."""
    told = counts.join(rates.select(key, "rate"), key)
    return told.withColumn("p", poisson_tail(F.col("n"), F.col("rate"))).where((F.col("n") >= least) & (F.col("p") < level))
