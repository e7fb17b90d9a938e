"""Merges and splits of the sinks, and the sliding windows of the stream, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.sinks import append_new, split_rejects
from ..streaming.bursts import bursts, sliding_counts
from .registry import Tables, query


@query("""SELECT o_custkey, o_orderkey, o_orderpriority FROM orders WHERE o_orderdate < DATE '1998-01-01' UNION ALL
  SELECT o_custkey, o_orderkey, NULL FROM orders WHERE o_orderdate >= DATE '1998-01-01' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < DATE '1998-01-01')""")
def append_new_keys(t: Tables):
    day = F.lit("1998-01-01").cast("timestamp")
    old = t.orders.where(F.col("o_orderdate") < day).select("o_custkey", "o_orderkey", "o_orderpriority")
    return append_new(old, t.orders.where(F.col("o_orderdate") >= day).select("o_custkey", "o_orderkey"), ["o_custkey"])


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, CASE WHEN l_quantity > 45 THEN 'quantity' WHEN l_discount >= 0.095 THEN 'discount' WHEN l_tax > 0.075 THEN 'tax' END AS reason
  FROM lineitem WHERE l_quantity > 45 OR l_discount >= 0.095 OR l_tax > 0.075""")
def rejected_rows(t: Tables):
    reasons = {"quantity": F.col("l_quantity") > 45, "discount": F.col("l_discount") >= 0.095, "tax": F.col("l_tax") > 0.075}
    return split_rejects(t.lineitem, reasons)[1].select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "reason")


_WINDOWS = """SELECT user_id, CAST(ts AS DATE) - CAST(k AS INT) AS start, count(*) AS n FROM events, range(7) r(k) WHERE ts IS NOT NULL GROUP BY ALL"""


@query(f"SELECT user_id, CAST(start AS DATE) AS start_day, n FROM ({_WINDOWS})")
def sliding_windows(t: Tables):
    return sliding_counts(t.events).select("user_id", F.col("start").cast("date").alias("start_day"), "n")


@query(f"""WITH w AS ({_WINDOWS}), r AS (SELECT user_id, count(*) * 7 / 30.0::DOUBLE AS rate FROM events GROUP BY user_id),
  p AS (SELECT w.*, 1 - list_sum(list_transform(range(CAST(n AS BIGINT)), lambda i: exp(-rate + i * ln(rate) - lgamma(i + 1)))) AS p FROM w JOIN r USING (user_id))
  SELECT user_id, CAST(start AS DATE) AS start_day, n, round(p, 6) AS p FROM p WHERE n >= 3 AND p < 0.01""")
def sliding_bursts(t: Tables):
    rates = t.events.groupBy("user_id").agg((F.count("*") * 7 / 30.0).alias("rate"))
    return bursts(sliding_counts(t.events), rates).select("user_id", F.col("start").cast("date").alias("start_day"), "n", F.round("p", 6).alias("p"))
