"""Benchmarks within peers, identifier collisions, coverage of a master table by its facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import whole_quantiles


def peer_benchmark(df: DataFrame, group: str, value: str, least: int = 5) -> DataFrame:
    """Minimum, quartiles and maximum of each group's values; of all values where a group has fewer than ``least``.

    Null values take no part; a null group is a group.  The figures of the whole
    table, one row, come from positions found in parts and are joined to the groups.
    """
    quartiles = F.percentile(value, F.array(*map(F.lit, (0.25, 0.5, 0.75))))
    own = df.groupBy(group).agg(F.count(value).alias("n"), F.min(value).alias("min"), quartiles.alias("q"), F.max(value).alias("max"))
    names = ("min", "q1", "median", "q3", "max")
    whole = whole_quantiles(df, value, (0.0, 0.25, 0.5, 0.75, 1.0)).select(*(F.col(f"q{i}").alias(f"all_{x}") for i, x in enumerate(names)))
    own = own.select(group, "n", "min", *(F.col("q")[i].alias(x) for i, x in enumerate(names[1:4])), "max")
    enough = F.col("n") >= least
    return own.join(F.broadcast(whole)).select(group, "n", F.when(enough, "peers").otherwise("all").alias("basis"), *(F.when(enough, F.col(x)).otherwise(F.col(f"all_{x}")).alias(x) for x in names))


def collisions(df: DataFrame, key: str, name: str) -> DataFrame:
    """Keys that stand for more than one name, with the number of names and the first of them."""
    return df.groupBy(key).agg(F.count_distinct(name).alias("names"), F.min(name).alias("first_name")).where("names > 1")


def coverage(master: DataFrame, key: str, facts: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """The keys of ``master`` with a flag for each fact table that has the key, and the share of tables that do.

    Each fact table is reduced to its distinct keys before it is joined.
    """
    out = master.select(key)
    for name, (table, column) in facts.items():
        held = table.select(F.col(column).alias(key)).where(F.col(key).isNotNull()).distinct().withColumn(f"has_{name}", F.lit(True))
        out = out.join(held, key, "left").withColumn(f"has_{name}", F.coalesce(f"has_{name}", F.lit(False)))
    held = sum((F.col(f"has_{n}").cast("int") for n in facts), F.lit(0))
    return out.withColumn("share", held / F.lit(float(max(1, len(facts)))))
