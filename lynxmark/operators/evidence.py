"""Evidence of single institutions: finances, peers, digit tests, compliance, opinions; reviews of a selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scoring import reasons, review_level, review_score


def gathered(facts: DataFrame, key: str, order: list[Column], columns: list[str], most: int, name: str) -> DataFrame:
    """``key`` and an array of the first ``most`` facts of each by ``order``; the cut comes before the array is made."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    kept = facts.withColumn("_place", place).where(F.col("_place") <= most)
    one = F.struct("_place", *columns)
    return kept.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: F.struct(*(x[c].alias(c) for c in columns))).alias(name))


def evidence(master: DataFrame, key: str, views: dict[str, DataFrame]) -> DataFrame:
    """One row of each institution with one column for each view, the other columns of the table of that name as a struct.

    Null means that there is no such evidence; a table may hold a key once.
    """
    out = master.select(key)
    for name, df in views.items():
        of = f"_{name}"
        out = out.join(df.select(F.col(key).alias(of), F.struct(*(c for c in df.columns if c != key)).alias(name)), F.col(key) == F.col(of), "left").drop(of)
    return out


def peers(master: DataFrame, key: str, group: str, kind: str, order: str, top: int = 8) -> DataFrame:
    """``key, peer_group, peer_count, place, peer``: the ``top`` highest others of the same group; who is alone there has those of the same kind.

    Missing ``order`` counts as 0, ties go to the smaller key.  A group's first
    ``top`` + 1 members serve all of its members, so no group meets itself.
    """
    rows = master.select(key, F.col(group).alias("g"), F.col(kind).alias("k"), F.coalesce(F.col(order), F.lit(0.0)).alias("o"))
    whole = None
    for column, level in (("g", 0), ("k", 1)):
        n = rows.groupBy(column).agg(F.count("*").alias("n"))
        best = rows.withColumn("place", F.row_number().over(Window.partitionBy(column).orderBy(F.desc("o"), key))).where(F.col("place") <= top + 1)
        best = best.groupBy(column).agg(F.sort_array(F.collect_list(F.struct("place", F.col(key).alias("id")))).alias("best"))
        one = n.join(best, column).select(F.col(column).alias("value"), F.lit(level).alias("level"), (F.col("n") - 1).alias("peer_count"), "best").where("value IS NOT NULL")
        whole = one if whole is None else whole.union(one)
    alone = lambda level: whole.where(F.col("level") == level).select(F.col("value").alias(f"v{level}"), F.col("peer_count").alias(f"n{level}"), F.col("best").alias(f"b{level}"))
    joined = rows.join(alone(0), F.col("g") == F.col("v0"), "left").join(alone(1), F.col("k") == F.col("v1"), "left")
    narrow = F.coalesce(F.col("n0"), F.lit(0)) > 0
    pick = lambda a, b: F.when(narrow, F.col(a)).otherwise(F.col(b))
    others = F.slice(F.filter(pick("b0", "b1"), lambda x: x["id"] != F.col(key)), 1, top)
    made = joined.select(key, pick("g", "k").alias("peer_group"), pick("n0", "n1").cast("long").alias("peer_count"), F.posexplode(F.transform(others, lambda x: x["id"])).alias("p", "peer"))
    return made.select(key, "peer_group", "peer_count", (F.col("p") + 1).alias("place"), "peer")


def review(rows: DataFrame, key: str, rules: list[tuple[Column, str, Column]], wanted: DataFrame | None = None) -> DataFrame:
    """Report of each institution, of those in ``wanted`` only where given: score, level and titles, most serious first.  One job for one or for many."""
    chosen = rows if wanted is None else rows.join(wanted.select(key).distinct(), key, "left_semi")
    out = chosen.select(key, reasons(rules).alias("_found")).withColumn("review_score", review_score(F.col("_found")))
    return out.select(key, "review_score", review_level(F.col("review_score"), F.col("_found")).alias("review_level"), F.transform("_found", lambda x: x["title"]).alias("findings"))


def targets(rows: DataFrame, key: str, score: str, top: int = 30) -> DataFrame:
    """The keys with the ``top`` highest scores, ties to the smaller key: what a batch of reviews takes when it names none."""
    return rows.orderBy(F.desc_nulls_last(score), key).limit(top).select(key)


def unscored(rows: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """Dimensions that are 0 or missing in every row: a sign that their facts were not loaded."""
    made = rows.agg(*(F.coalesce(F.max(F.abs(F.col(d))), F.lit(0.0)).alias(d) for d in dims))
    each = F.filter(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("double").alias("most")) for d in dims)), lambda x: x["most"] == 0)
    return made.select(F.explode(each).alias("x")).select("x.dimension")
