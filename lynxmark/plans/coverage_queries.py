"""Benchmark, collision and coverage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage as c
from .registry import Tables, query

_STATS = ["min(v) AS mn"] + [f"quantile_cont(v, {q}) AS q{int(q * 100)}" for q in (0.25, 0.5, 0.75)] + ["max(v) AS mx"]


@query(f"""WITH b AS (SELECT s_nationkey AS g, s_acctbal AS v FROM supplier), o AS (SELECT g, count(v) AS n, {', '.join(_STATS)} FROM b GROUP BY g), w AS (SELECT {', '.join(_STATS)} FROM b)
SELECT g AS s_nationkey, n, CASE WHEN n >= 5 THEN 'peers' ELSE 'all' END AS basis, """ + ", ".join(
    f"round(CASE WHEN n >= 5 THEN o.{a} ELSE w.{a} END, 4) AS {b}" for a, b in (("mn", "min"), ("q25", "q1"), ("q50", "median"), ("q75", "q3"), ("mx", "max"))
) + " FROM o, w")
def peer_benchmark(t: Tables):
    found = c.peer_benchmark(t.supplier, "s_nationkey", "s_acctbal")
    return found.select("s_nationkey", "n", "basis", *(F.round(x, 4).alias(x) for x in ("min", "q1", "median", "q3", "max")))


@query("SELECT p_brand, count(DISTINCT p_type) AS names, min(p_type) AS first_name FROM part GROUP BY p_brand HAVING count(DISTINCT p_type) > 1")
def id_collisions(t: Tables):
    return c.collisions(t.part, "p_brand", "p_type")


@query("""SELECT c_custkey, has_orders, has_events, (CAST(has_orders AS INT) + CAST(has_events AS INT)) / 2.0::DOUBLE AS share
  FROM (SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS has_orders, c_custkey IN (SELECT user_id FROM events) AS has_events FROM customer)""")
def fact_coverage(t: Tables):
    return c.coverage(t.customer, "c_custkey", {"orders": (t.orders, "o_custkey"), "events": (t.events, "user_id")})
