"""Digit forensics, peers, ratios and identities on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import safe_div
from ..operators import forensics as fo
from .registry import Tables, query

_BENFORD = "(VALUES " + ", ".join(f"({d}, log10(1 + 1.0::DOUBLE / {d}))" for d in range(1, 10)) + ") e(d, p)"


def _r(name: str, n: int = 6):
    return F.round(name, n).alias(name)


@query(f"""
WITH a AS (SELECT l_suppkey AS s, CAST(substr(CAST(CAST(floor(abs(l_extendedprice)) AS BIGINT) AS VARCHAR), 1, 1) AS INT) AS d FROM lineitem WHERE abs(l_extendedprice) >= 1),
n AS (SELECT s, count(*) AS n FROM a GROUP BY s), c AS (SELECT s, d, count(*) AS c FROM a GROUP BY s, d),
x AS (SELECT n.s, n.n, sum((coalesce(c, 0) - n * p) * (coalesce(c, 0) - n * p) / (n * p)) AS chi2, sum(abs(coalesce(c, 0) / n::DOUBLE - p)) / 9 AS mad
  FROM n CROSS JOIN {_BENFORD} LEFT JOIN c ON c.s = n.s AND c.d = e.d WHERE n >= 25 GROUP BY n.s, n.n)
SELECT s AS l_suppkey, n, round(chi2, 4) AS chi2, round(mad, 6) AS mad FROM x ORDER BY round(chi2, 4) DESC, s LIMIT 20""")
def first_digit_benford(t: Tables):
    tested = fo.benford_test(t.lineitem, "l_suppkey", "l_extendedprice").select("l_suppkey", "n", _r("chi2", 4), _r("mad"))
    return tested.orderBy(F.desc("chi2"), "l_suppkey").limit(20)


@query(f"""
WITH a AS (SELECT l_suppkey AS s, CAST(substr(CAST(CAST(floor(abs(l_extendedprice)) AS BIGINT) AS VARCHAR), 1, 1) AS INT) AS d FROM lineitem WHERE abs(l_extendedprice) >= 1),
n AS (SELECT s, count(*) AS n FROM a GROUP BY s), c AS (SELECT s, d, count(*) AS c FROM a GROUP BY s, d),
x AS (SELECT n.s, n.n, sum((coalesce(c, 0) - n * p) * (coalesce(c, 0) - n * p) / (n * p)) AS chi2, sum(abs(coalesce(c, 0) / n::DOUBLE - p)) / 9 AS mad,
  sum(abs(coalesce(c, 0) / n::DOUBLE - p)) / sum(sqrt(2 * p * (1 - p) / pi())) * sqrt(n.n) AS ratio
  FROM n CROSS JOIN {_BENFORD} LEFT JOIN c ON c.s = n.s AND c.d = e.d WHERE n >= 25 GROUP BY n.s, n.n),
y AS (SELECT *, exp(-chi2 / 2) * (1 + chi2 / 2 + chi2 * chi2 / 8 + chi2 * chi2 * chi2 / 48) AS p FROM x)
SELECT s AS l_suppkey, n, round(p, 6) AS p_value, round(ratio, 4) AS mad_ratio,
  CASE WHEN n >= 5000 THEN CASE WHEN mad < 0.006 THEN 'close' WHEN mad < 0.012 THEN 'acceptable' WHEN mad < 0.015 THEN 'marginal' ELSE 'nonconforming' END
    WHEN ratio < 1.15 THEN 'close' WHEN ratio < 1.5 THEN 'acceptable' WHEN ratio < 2.0 THEN 'marginal' ELSE 'nonconforming' END AS level,
  round(CASE WHEN n >= 5000 THEN greatest(0, least(100, (mad - 0.006) / 0.024 * 100))
    ELSE 100 * (0.65 * least(-log10(greatest(p, 1e-12)) / 4, 1) + 0.35 * greatest(0, least(1, (ratio - 1.1) / 1.2))) END, 3) AS score FROM y""")
def benford_levels(t: Tables):
    return fo.benford_test(t.lineitem, "l_suppkey", "l_extendedprice").select("l_suppkey", "n", _r("p_value"), _r("mad_ratio", 4), "level", _r("score", 3))


@query("""
WITH a AS (SELECT l_suppkey AS s, CAST(floor(abs(l_extendedprice)) AS BIGINT) % 100 AS e FROM lineitem WHERE abs(l_extendedprice) >= 100),
c AS (SELECT s, e, count(*) AS c FROM a GROUP BY s, e)
SELECT s AS l_suppkey, CAST(sum(c) AS BIGINT) AS n, round(100.0 * sum(c * c) / sum(c) - sum(c), 4) AS chi2, round(max(c) / sum(c)::DOUBLE, 6) AS max_share FROM c GROUP BY s HAVING sum(c) >= 60""")
def last_two_digit_chi2(t: Tables):
    return fo.last_two_test(t.lineitem, "l_suppkey", "l_extendedprice").select("l_suppkey", "n", _r("chi2", 4), _r("max_share"))


@query("""
WITH a AS (SELECT o_custkey AS k, CAST(floor(abs(o_totalprice)) AS BIGINT) AS v FROM orders),
p AS (SELECT k, count(*) AS n, count(*) FILTER (v % 1000 = 0) AS t, count(*) FILTER (v % 100 = 0) AS h FROM a WHERE v > 0 GROUP BY k)
SELECT k AS o_custkey, n, round(t / n::DOUBLE, 6) AS share_1000, round(h / n::DOUBLE, 6) AS share_100, round(greatest(0, least(100, (t / n::DOUBLE - 0.02) / 0.15 * 100)), 4) AS score FROM p WHERE n >= 15""")
def round_number_share(t: Tables):
    return fo.round_share(t.orders, "o_custkey", "o_totalprice").select("o_custkey", "n", _r("share_1000"), _r("share_100"), _r("score", 4))


@query(f"""
WITH a AS (SELECT l_suppkey AS s, s_nationkey AS g, CAST(substr(CAST(CAST(floor(abs(l_extendedprice)) AS BIGINT) AS VARCHAR), 1, 1) AS INT) AS d
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE abs(l_extendedprice) >= 1),
c AS (SELECT k.s, k.g, e.d, (SELECT count(*) FROM a WHERE a.s = k.s AND a.d = e.d) AS c FROM (SELECT DISTINCT s, g FROM a) k CROSS JOIN {_BENFORD}),
m AS (SELECT *, sum(c) OVER (PARTITION BY s) AS n, sum(c) OVER (PARTITION BY g, d) - c AS gc, sum(c) OVER (PARTITION BY g) - sum(c) OVER (PARTITION BY s) AS gn,
  sum(c) OVER (PARTITION BY d) - c AS tc, sum(c) OVER () - sum(c) OVER (PARTITION BY s) AS tn FROM c),
q AS (SELECT *, CASE WHEN gn >= 2000 THEN gn ELSE tn END AS pool, CASE WHEN gn >= 2000 THEN gc / gn::DOUBLE ELSE tc / tn::DOUBLE END AS p FROM m WHERE n >= 25)
SELECT s AS l_suppkey, CAST(n AS BIGINT) AS n, CAST(pool AS BIGINT) AS pool, round(sum(abs(c / n::DOUBLE - p)) / 9, 6) AS mad,
  round(sum(abs(c / n::DOUBLE - p)) / sum(sqrt(2 * p * (1 - p) / (pi() * n))), 4) AS mad_ratio FROM q GROUP BY s, n, pool""")
def digit_leave_one_out(t: Tables):
    counts = fo.digit_counts(t.lineitem, "l_suppkey", "l_extendedprice").join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return fo.leave_one_out(counts, "l_suppkey", "s_nationkey").select("l_suppkey", "n", "pool", _r("mad"), _r("mad_ratio", 4))


@query("""
WITH v AS (SELECT c_custkey, c_nationkey || '|' || c_mktsegment AS peer, sum(o_totalprice) AS spent FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
m AS (SELECT peer, median(spent) AS med, stddev_samp(spent) AS sd, count(spent) AS n FROM v GROUP BY peer),
d AS (SELECT v.peer, 1.4826 * median(abs(spent - med)) AS mad FROM v JOIN m USING (peer) GROUP BY v.peer),
z AS (SELECT c_custkey, peer, CASE WHEN n >= 5 AND spent IS NOT NULL AND CASE WHEN mad > 0 THEN mad ELSE sd END > 0 THEN (spent - med) / CASE WHEN mad > 0 THEN mad ELSE sd END ELSE 0 END AS z
  FROM v JOIN m USING (peer) JOIN d USING (peer))
SELECT c_custkey, peer, round(z, 5) AS z, round(greatest(0, least(100, (abs(z) - 1) / 3 * 100)), 3) AS score FROM z""")
def peer_robust_z(t: Tables):
    spent = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spent"))
    rows = t.customer.join(spent, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.concat_ws("|", "c_nationkey", "c_mktsegment").alias("peer"), "spent")
    z = fo.robust_z(rows, "spent", "peer")
    return z.select("c_custkey", "peer", _r("z", 5), F.round(fo.deviation_score(F.col("z")), 3).alias("score"))


@query("""
WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, sum(o_totalprice) AS v FROM orders GROUP BY ALL),
s AS (SELECT o_custkey, abs((v - lag(v) OVER w) / abs(lag(v) OVER w)) AS c FROM y WHERE v <> 0 WINDOW w AS (PARTITION BY o_custkey ORDER BY y))
SELECT o_custkey, count(*) AS years, round(max(c), 5) AS max_change, round(CASE WHEN max(c) IS NULL THEN 0 ELSE greatest(0, least(100, (max(c) - 0.15) / 0.65 * 100)) END, 3) AS score FROM s GROUP BY o_custkey""")
def yoy_volatility(t: Tables):
    years = t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("v"))
    return fo.yoy(years, "o_custkey", "y", "v").select("o_custkey", "years", _r("max_change", 5), _r("score", 3))


@query("""
WITH l AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS net, count(*) AS n, count(*) FILTER (l_quantity <= 0) AS bad FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, coalesce(n, 0) AS lines, CASE WHEN n IS NULL THEN 'no lines' WHEN bad > 0 THEN 'quantity' WHEN o_totalprice <= 0 THEN 'total'
  WHEN abs(net - o_totalprice) > greatest(1000, 0.02 * o_totalprice) THEN 'totals differ' ELSE 'accepted' END AS reason FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def identity_checks(t: Tables):
    lines = t.lineitem.groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), F.count("*").alias("n"), F.count_if(F.col("l_quantity") <= 0).alias("bad")
    )
    total = F.col("o_totalprice")
    reason = (
        F.when(F.col("n").isNull(), "no lines").when(F.col("bad") > 0, "quantity").when(total <= 0, "total")
        .when(F.abs(F.col("net") - total) > F.greatest(F.lit(1000.0), total * 0.02), "totals differ").otherwise("accepted")
    )
    return t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("n", F.lit(0)).cast("long").alias("lines"), reason.alias("reason"))


@query("""
WITH y AS (SELECT l_suppkey, year(l_shipdate) AS y, sum(l_extendedprice) AS gross, sum(l_extendedprice * l_discount) AS off, sum(l_extendedprice * l_tax) AS tax, sum(l_quantity) AS qty,
  sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END) AS back FROM lineitem GROUP BY ALL),
r AS (SELECT l_suppkey, y, off / nullif(gross, 0) AS discount, tax / nullif(gross, 0) AS tax, gross / nullif(qty, 0) AS unit, back / nullif(gross, 0) AS returned FROM y)
SELECT l_suppkey, CAST(y AS INT) AS year, ratio, round(value, 6) AS value FROM (UNPIVOT r ON discount, tax, unit, returned INTO NAME ratio VALUE value)""")
def unpivot_ratios(t: Tables):
    price = F.col("l_extendedprice")
    per = t.lineitem.groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg(
        F.sum(price).alias("gross"), F.sum(price * F.col("l_discount")).alias("off"), F.sum(price * F.col("l_tax")).alias("paid"), F.sum("l_quantity").alias("qty"),
        F.sum(F.when(F.col("l_returnflag") == "R", price).otherwise(0.0)).alias("back"),
    )
    g = F.col("gross")
    wide = per.select("l_suppkey", "year", safe_div(F.col("off"), g).alias("discount"), safe_div(F.col("paid"), g).alias("tax"), safe_div(g, F.col("qty")).alias("unit"), safe_div(F.col("back"), g).alias("returned"))
    return wide.unpivot(["l_suppkey", "year"], ["discount", "tax", "unit", "returned"], "ratio", "value").where("value is not null").withColumn("value", F.round("value", 6))
