"""Mixing sources to target weights by weighted fair queueing.

Every document waits in its source's queue, in shuffled order; the queue is
served twice over.  A copy's virtual finish time is the source's words up to and
including it, divided by the source's weight.  All copies are served by finish
time until the total budget is used up: sources with much text are served at
their weight, small ones run dry after two rounds and the others share the rest.

Every order over the whole table is a range sort: the rows are dealt into ranges
of the order, each range's sum is taken, and a running sum is the sum of the
ranges before and a window inside the range.  A hot source is many ranges, and
so are rows that are alike in all, since a random number breaks their ties.
Sources are ranked and filled in the same way, so that they may be as many as
documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import free_name, parallelism, stage

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: The budget and a source's most, as parts of what there is.
SHARE, ROUNDS = 1.5, 2
#: Rows of one range.
RANGE = 500_000


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def _pick(index: Column) -> Column:
    out = F.lit(WEIGHTS[-1])
    for k, w in enumerate(WEIGHTS[:-1]):
        out = F.when(index % len(WEIGHTS) == k, w).otherwise(out)
    return out


def running(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """``df`` with a running sum, this row included, of the column ``sums[name]`` under each ``name``, in the given order.

    Rows alike in the whole order follow one another in any order.
    """
    spark = df.sparkSession
    part, tie = free_name(df, "part"), free_name(df, "tie")
    n = max(2 * parallelism(spark), -(-df.count() // RANGE))
    laid = df.withColumn(tie, F.rand(11)).repartitionByRange(n, *order, tie).withColumn(part, F.spark_partition_id())
    laid = stage(laid, "mix-ranges")
    each = laid.groupBy(part).agg(*(F.sum(c).alias(f"sum_{k}") for k, c in enumerate(sums.values())))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # over the ranges, not the rows
    bases = each.select(part, *(F.coalesce(F.sum(f"sum_{k}").over(before), F.lit(0)).alias(f"base_{k}") for k in range(len(sums))))
    inside = Window.partitionBy(part).orderBy(*order, tie).rowsBetween(Window.unboundedPreceding, 0)
    made = {name: F.col(f"base_{k}") + F.sum(c).over(inside) for k, (name, c) in enumerate(sums.items())}
    return laid.join(F.broadcast(bases), part).withColumns(made).select(*df.columns, *sums)


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, before, weight, level, target`` from ``(source, source_size)``, one row per source.

    ``before`` is the size of all sources that sort before, ``level`` the
    virtual time at which the budget is spent.
    """
    by_name = [F.col("source").asc_nulls_last()]
    named = running(sizes.withColumn("one", F.lit(1)), by_name, {"position": "one", "up_to": "source_size"})
    ranked = named.select("source", "source_size", (F.col("up_to") - F.col("source_size")).alias("before"), _pick(F.col("position") - 1).alias("weight"))
    ranked = ranked.withColumn("most", ROUNDS * F.col("source_size")).withColumn("dry", F.col("most") / F.col("weight"))
    filled = stage(running(ranked, [F.col("dry"), *by_name], {"most_up_to": "most", "weight_up_to": "weight"}), "mix-sources")
    total, weights = filled.agg(F.sum("source_size"), F.sum("weight")).first()
    if total is None:
        total, weights = 0, 0
    trial = (F.lit(SHARE * total) - (F.col("most_up_to") - F.col("most"))) / (F.lit(weights) - (F.col("weight_up_to") - F.col("weight")))
    first = filled.select("dry", trial.alias("trial")).where("trial <= dry").agg(F.min(F.struct("dry", "trial")).alias("x")).first().x
    level = F.lit(first.trial if first else None).cast("double")
    target = F.when(F.col("dry") <= level, F.col("most").cast("double")).otherwise(F.col("weight") * level)
    return filled.select("source", "source_size", "before", "weight", level.alias("level"), target.alias("target"))


def _turn(key: str, text: str) -> Column:
    """The place of a document in its queue: shuffled by id and text, so that reruns agree and repeated ids don't stand together."""
    return F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit(""))).cast("binary"))


def _mixed(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """``doc_id, source, turn, size, source_size, target, times`` for every document."""
    rows = stage(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"), _turn(key, text).alias("turn")), "mix-rows")
    targets = stage(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-targets")
    queued = running(rows, [F.col("source").asc_nulls_last(), F.col("turn"), F.col("doc_id"), F.col("size")], {"up_to": "size"})
    served = queued.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).withColumn("first_end", F.col("up_to") - F.col("before")).drop("of", "up_to", "before")
    served = stage(served.withColumn("base_copies", sum((F.col("first_end") + r * F.col("source_size") <= F.col("target")).cast("int") for r in range(ROUNDS))), "mix-served")
    # Copies that finish above the level, up to where the budget is surely spent.
    spent, longest, least, words = served.agg(F.sum(F.col("size") * F.col("base_copies")), F.max("size"), F.min("weight"), F.sum("size")).first()
    if spent is None:
        spent, longest, least, words = 0, 0, 1, 0
    above = served.where("base_copies < 2 and size > 0").withColumn("round", F.explode(F.array(*(F.lit(r) for r in range(ROUNDS)))))
    above = above.withColumn("end", F.col("first_end") + F.col("round") * F.col("source_size")).withColumn("finish", F.col("end") / F.col("weight"))
    above = stage(above.where((F.col("end") > F.col("target")) & (F.col("finish") <= F.col("level") + F.lit(longest / least))), "mix-above")
    names = ("source", "turn", "first_end")  # one document: its place in its queue
    order = [F.col("finish"), F.col("source").asc_nulls_last(), F.col("doc_id"), F.col("size")]
    more = running(above.select(*names, "doc_id", "size", "finish"), order, {"total": "size"}).where(F.col("total") + F.lit(spent) <= F.lit(SHARE * words))
    more = more.groupBy(*names).agg(F.count("*").cast("int").alias("extra")).select(*(F.col(n).alias(f"of_{n}") for n in names), "extra")
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"of_{n}"))
    times = F.when(F.col("size") > 0, F.col("base_copies") + F.coalesce("extra", F.lit(0))).otherwise(0)
    return served.join(more, same, "left").select("doc_id", "source", "turn", "size", "source_size", "target", times.alias("times"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``taken`` for every document.

    ``taken`` is 0, 1 or 2 times the size.  Null text counts as no words; a null
    source is a source of its own, the last.  The order is that of the MD5 of
    id and text, so reruns agree; rows alike in both share what is taken of them
    in any way.  Without any words every target and every ``taken`` is 0; an
    empty table gives an empty result.
    """
    return _mixed(docs, key, text, source).select(F.col("doc_id").alias(key), "source", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS turn FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
e AS (SELECT *, 2 * source_size AS most, (2 * source_size) / weight::DOUBLE AS dry FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY dry, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (ORDER BY dry, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS trial FROM e),
t AS (SELECT source, source_size, weight, CASE WHEN dry <= v.level THEN most::DOUBLE ELSE weight * v.level END AS target FROM l, (SELECT arg_min(trial, dry) AS level FROM l WHERE trial <= dry) v),
q AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.weight, t.target, CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY turn, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS first_end
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, first_end + r * source_size AS ending FROM q, (VALUES (0), (1)) k(r)),
o AS (SELECT *, sum(size) OVER (ORDER BY ending / weight::DOUBLE, source NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) AS total FROM c)
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN total <= 1.5 * (SELECT sum(size) FROM d) THEN size ELSE 0 END) AS BIGINT) AS taken
FROM o GROUP BY doc_id, size, source_size, target, source, first_end
"""


def taken_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents as often as the mix takes them, columns as they came.

    Rows alike in id, text and source are one document to the mix: together they
    come as often as it takes them, with the other columns of any one of them.
    """
    turn, of, from_, times, many = (free_name(docs, n) for n in ("_turn", "_of", "_from", "_times", "_many"))
    plan = _mixed(docs, key, text, source).groupBy(F.col("turn").alias(of), F.col("source").alias(from_)).agg(F.sum("times").cast("int").alias(times), (F.count("*") > 1).alias(many))
    plan = stage(plan.where(F.col(times) > 0), "mix-taken")
    tagged = docs.withColumn(turn, _turn(key, text))
    chosen = lambda p: tagged.join(p, (F.col(turn) == F.col(of)) & F.col(source).eqNullSafe(F.col(from_)))
    kept = chosen(plan.where(~F.col(many)))
    if not plan.where(many).isEmpty():
        kept = kept.union(chosen(plan.where(many)).dropDuplicates([turn, from_]))
    return kept.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
