"""Ranks, bands, roll-ups, schedules, validation measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import band, rounded
from ..operators import evaluation as ev
from ..operators import scoring as sc
from ..operators.ranking import with_midrank, with_position
from .registry import Tables, query

_BAND = "CASE WHEN (rank - 1) * 100 < total * 2 THEN 'critical' WHEN (rank - 1) * 100 < total * 8 THEN 'high' WHEN (rank - 1) * 100 < total * 25 THEN 'medium' WHEN (rank - 1) * 100 < total * 60 THEN 'low' ELSE 'minimal' END"


@query("""SELECT c_custkey, round((rank() OVER (ORDER BY c_acctbal) - 1 + 0.5::DOUBLE * count(*) OVER (PARTITION BY c_acctbal)) / count(*) OVER (), 6) AS midrank FROM customer""")
def midrank_percentile(t: Tables):
    return with_midrank(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal").select("c_custkey", rounded("midrank", 6).alias("midrank"))


@query(f"""WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank, count(*) OVER () AS total FROM customer)
SELECT c_custkey, rank, round((1 - (rank - 1) / total::DOUBLE) * 100, 4) AS percentile, {_BAND} AS band FROM r""")
def band_by_rank(t: Tables):
    return sc.ranked(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey").select("c_custkey", "rank", rounded("percentile", 4).alias("percentile"), "band")


@query(f"""WITH r AS (SELECT row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank, count(*) OVER () AS total, c_acctbal FROM customer),
b AS (SELECT {_BAND} AS band, c_acctbal, total FROM r)
SELECT v.band, count(c_acctbal) AS n, round(100.0::DOUBLE * count(c_acctbal) / (SELECT count(*) FROM customer), 4) AS pct, round(min(c_acctbal), 2) AS low, round(max(c_acctbal), 2) AS high
FROM (VALUES ('critical'), ('high'), ('medium'), ('low'), ('minimal')) v(band) LEFT JOIN b ON b.band = v.band GROUP BY v.band""")
def band_summary(t: Tables):
    per = sc.ranked(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey").groupBy("band").agg(
        F.count("*").alias("n"), F.max("total").alias("total"), F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high")
    )
    bands = t.spark.createDataFrame([(b,) for b in sc.BANDS], "band string")
    n = F.coalesce("n", F.lit(0))
    return bands.join(per, "band", "left").select("band", n.alias("n"), rounded(F.coalesce(100.0 * n / F.col("total"), F.lit(0.0)), 4).alias("pct"), rounded("low", 2).alias("low"), rounded("high", 2).alias("high"))


@query("""SELECT r_name, n_name, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(sum(o_totalprice), 2) AS total, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS priority,
round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL HAVING count(*) >= 2""")
def group_rollup(t: Tables):
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    joined = t.orders.select("o_custkey", "o_totalprice", "o_orderpriority").join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    price = F.col("o_totalprice")
    return joined.groupBy("r_name", "n_name").agg(
        F.count("*").alias("n"), rounded(F.avg(price), 4).alias("mean"), rounded(F.sum(price), 2).alias("total"), F.count_if(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("priority"),
        rounded(F.percentile(price, 0.9), 4).alias("p90"),
    ).where("n >= 2")


@query("""SELECT CAST(b.b AS BIGINT) AS bucket, count(c_custkey) AS n FROM range(10) b(b) LEFT JOIN (SELECT c_custkey, least(9, floor((c_acctbal + 1000) / 1100)) AS k FROM customer) ON k = b.b GROUP BY b.b""")
def histogram10(t: Tables):
    k = F.least(F.lit(9), F.floor((F.col("c_acctbal") + 1000) / 1100))
    counts = t.customer.groupBy(k.cast("long").alias("bucket")).agg(F.count("*").alias("n"))
    return t.spark.range(10).toDF("bucket").join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT o_orderpriority, count(*) AS n, """ + ", ".join(f"round(quantile_cont(o_totalprice, {q}), 4) AS q{int(q * 100)}" for q in (0.02, 0.25, 0.5, 0.75, 0.98)) + " FROM orders GROUP BY o_orderpriority HAVING count(*) >= 3")
def box_stats(t: Tables):
    marks = (0.02, 0.25, 0.5, 0.75, 0.98)
    per = t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.percentile("o_totalprice", list(marks)).alias("q")).where("n >= 3")
    return per.select("o_orderpriority", "n", *(rounded(F.col("q")[k], 4).alias(f"q{int(m * 100)}") for k, m in enumerate(marks)))


@query("""SELECT s_suppkey, s_name, round(s_acctbal, 2) AS s_acctbal, (SELECT count(*) FROM supplier WHERE s_acctbal BETWEEN 0 AND 9000 AND contains(s_name, '1')) AS matched
FROM supplier WHERE s_acctbal BETWEEN 0 AND 9000 AND contains(s_name, '1') ORDER BY s_acctbal DESC NULLS FIRST, s_suppkey LIMIT 25""")
def list_filter_sort(t: Tables):
    kept = t.supplier.where(F.col("s_acctbal").between(0, 9000) & F.col("s_name").contains("1"))
    total = kept.agg(F.count("*").alias("matched"))
    page = kept.orderBy(F.col("s_acctbal").desc_nulls_first(), "s_suppkey").limit(25)
    return page.join(F.broadcast(total)).select("s_suppkey", "s_name", rounded("s_acctbal", 2).alias("s_acctbal"), "matched")


@query("""SELECT r_name AS city, n_name AS district, count(*) AS visits, round(max(s_acctbal), 2) AS max_score, round(avg(s_acctbal), 4) AS mean_score, CAST(greatest(0, count(*) - 1) AS BIGINT) AS saved,
string_agg(s_name, ',' ORDER BY s_acctbal DESC, s_name) AS members FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL ORDER BY count(*) DESC, max(s_acctbal) DESC, r_name, n_name LIMIT 30""")
def route_batches(t: Tables):
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    made = sc.routes(t.supplier.join(places, F.col("s_nationkey") == F.col("n_nationkey")), "r_name", "n_name", "s_acctbal", "s_name")
    return made.withColumn("max_score", rounded("max_score", 2)).withColumn("mean_score", rounded("mean_score", 4))


@query(f"""WITH r AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS rank, count(*) OVER () AS total FROM supplier), b AS (SELECT *, {_BAND} AS band FROM r WHERE rank <= 80)
SELECT s_suppkey, rank, b.band, coalesce(w.wave, 4) AS wave, CAST(DATE '2026-09-01' + coalesce(w.days, 60) AS DATE) AS due, coalesce(w.hours, 2.5::DOUBLE) AS hours
FROM b LEFT JOIN (VALUES ('critical', 1, 7, 8.0::DOUBLE), ('high', 2, 14, 6.0), ('medium', 3, 30, 3.5)) w(band, wave, days, hours) USING (band)""")
def wave_schedule(t: Tables):
    return sc.schedule(sc.ranked(t.supplier.select("s_suppkey", "s_acctbal"), "s_acctbal", "s_suppkey"), 80, "2026-09-01").select("s_suppkey", "rank", "band", "wave", "due", "hours")


@query("""SELECT l_suppkey, CAST(sum(l_quantity) AS DOUBLE) AS quantity, count(*) AS lines FROM lineitem GROUP BY l_suppkey ORDER BY quantity DESC, l_suppkey LIMIT 20""")
def topk_with_ties(t: Tables):
    per = t.lineitem.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("lines"))
    return per.orderBy(F.desc("quantity"), "l_suppkey").limit(20)


_LAB = "l AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS s, quality AS y FROM documents JOIN labels USING (doc_id))"
_RANKED = _LAB + ", r AS (SELECT *, row_number() OVER (ORDER BY s DESC, doc_id) AS rank, count(*) OVER () AS total FROM l), c AS (SELECT *, sum(y) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING) AS tp, sum(y) OVER () AS p FROM r)"


def labelled(t: Tables):
    return t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id").select("doc_id", F.col("n_chars").cast("double").alias("s"), F.col("quality").alias("y"), "toxic")


@query(f"WITH {_RANKED} SELECT rank, round((rank - tp) / (total - p)::DOUBLE, 6) AS fpr, round(tp / p::DOUBLE, 6) AS tpr FROM c WHERE rank % greatest(1, total // 60) = 0 OR rank = total")
def roc_points(t: Tables):
    return ev.roc_points(labelled(t), "s", "y", "doc_id").select("rank", rounded("fpr", 6).alias("fpr"), rounded("tpr", 6).alias("tpr"))


@query(f"WITH {_RANKED} SELECT rank, round(tp / rank::DOUBLE, 6) AS precision, round(tp / p::DOUBLE, 6) AS recall FROM c WHERE rank % greatest(1, total // 60) = 0 OR rank = total")
def pr_points(t: Tables):
    return ev.roc_points(labelled(t), "s", "y", "doc_id").select("rank", rounded("precision", 6).alias("precision"), rounded("tpr", 6).alias("recall"))


@query(f"WITH {_LAB}, r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS r FROM l), z AS (SELECT sum(r) FILTER (y = 1) AS r, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM r) SELECT round((r - p * (p + 1) / 2.0::DOUBLE) / (p * n), 6) AS auc, p AS positives, n AS negatives FROM z")
def auc_midrank(t: Tables):
    return ev.auc(labelled(t), "s", "y").select(rounded("auc", 6).alias("auc"), F.col("positives").cast("long").alias("positives"), F.col("negatives").cast("long").alias("negatives"))


@query(f"WITH {_RANKED}, b AS (SELECT CAST((rank - 1) // (total // 10) + 1 AS INT) AS bucket, y FROM c) SELECT bucket, count(*) AS n, CAST(sum(y) AS BIGINT) AS hits, round(avg(y) / (SELECT avg(y) FROM l), 6) AS lift FROM b WHERE bucket <= 10 GROUP BY bucket")
def lift_deciles(t: Tables):
    return ev.lift(labelled(t), "s", "y", "doc_id").withColumn("lift", rounded("lift", 6))


@query(f"WITH {_RANKED} SELECT CAST(k AS INT) AS k, CAST(sum(y) AS BIGINT) AS hits, round(avg(y), 6) AS precision, round(sum(y) / max(p)::DOUBLE, 6) AS recall FROM c JOIN (VALUES (20), (50), (100)) v(k) ON rank <= k GROUP BY k")
def precision_recall_at_k(t: Tables):
    return ev.at_k(labelled(t), "s", "y", "doc_id").select("k", "hits", rounded("precision", 6).alias("precision"), rounded("recall", 6).alias("recall"))


@query(f"WITH {_RANKED}, x AS (SELECT rank <= total // 5 AS f, y FROM c) SELECT count(*) FILTER (f AND y = 1) AS tp, count(*) FILTER (f AND y = 0) AS fp, count(*) FILTER (NOT f AND y = 1) AS fn, count(*) FILTER (NOT f AND y = 0) AS tn FROM x")
def confusion_top20(t: Tables):
    ranked = with_position(labelled(t), "s", ["doc_id"])
    flagged, y = F.col("rank") <= F.floor(F.col("total") / 5), F.col("y") == 1
    return ranked.agg(F.count_if(flagged & y).alias("tp"), F.count_if(flagged & ~y).alias("fp"), F.count_if(~flagged & y).alias("fn"), F.count_if(~flagged & ~y).alias("tn"))


@query(f"""WITH l AS (SELECT doc_id, least(100, n_chars / 200.0::DOUBLE) AS a, 100 - least(100, doc_id % 101) AS b, quality AS y FROM documents JOIN labels USING (doc_id)),
x AS (SELECT CAST(k AS INT) AS step, y, round(a * (1 - k / 10.0::DOUBLE) + b * (k / 10.0::DOUBLE), 9) AS s FROM l CROSS JOIN range(11) k(k)),
r AS (SELECT step, y, rank() OVER (PARTITION BY step ORDER BY s) + (count(*) OVER (PARTITION BY step, s) - 1) / 2.0::DOUBLE AS r FROM x),
z AS (SELECT step, sum(r) FILTER (y = 1) AS r, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM r GROUP BY step)
SELECT step, round((r - p * (p + 1) / 2.0::DOUBLE) / (p * n), 6) AS auc FROM z""")
def blend_sweep(t: Tables):
    base = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id").select(
        F.least(F.lit(100.0), F.col("n_chars") / 200.0).alias("a"), (100 - F.least(F.lit(100), F.col("doc_id") % 101)).alias("b"), F.col("quality").alias("y")
    )
    k = F.col("step") / 10.0
    each = base.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(10)))).withColumn("s", rounded(F.col("a") * (1 - k) + F.col("b") * k, 9))
    return ev.auc(each, "s", "y", ["step"]).withColumn("auc", rounded("auc", 6))


_DIMS = """d AS (SELECT c_custkey, CASE WHEN n > 0 THEN least(100, n * 6.0::DOUBLE) END AS compliance, least(100, greatest(0, c_acctbal / 100.0::DOUBLE)) AS financial,
  CASE WHEN c_mktsegment <> 'BUILDING' THEN c_nationkey * 4.0::DOUBLE END AS evaluation, CAST(c_custkey % 97 AS DOUBLE) AS sentiment
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey),
u AS (SELECT c_custkey, (coalesce(compliance, 0) * 0.35::DOUBLE + financial * 0.29::DOUBLE + coalesce(evaluation, 0) * 0.12::DOUBLE + sentiment * 0.24::DOUBLE)
  / (CASE WHEN compliance IS NULL THEN 0 ELSE 0.35::DOUBLE END + 0.29::DOUBLE + CASE WHEN evaluation IS NULL THEN 0 ELSE 0.12::DOUBLE END + 0.24::DOUBLE) AS rule FROM d)"""


def customer_rules(t: Tables):
    n = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    rows = t.customer.join(n, F.col("c_custkey") == F.col("o_custkey"), "left")
    dims = {
        "compliance": F.when(F.col("n") > 0, F.least(F.lit(100.0), F.col("n") * 6.0)),
        "financial": F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("c_acctbal") / 100.0)),
        "evaluation": F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_nationkey") * 4.0),
        "sentiment": (F.col("c_custkey") % 97).cast("double"),
    }
    return rows.select("c_custkey", sc.rule_score(dims).alias("rule"))


@query(f"WITH {_DIMS} SELECT c_custkey, round(rule, 6) AS rule FROM u")
def rule_score_available(t: Tables):
    return customer_rules(t).withColumn("rule", rounded("rule", 6))


@query(f"""WITH {_DIMS}, f AS (SELECT c_custkey, round(CASE WHEN c_custkey % 10 = 0 THEN rule ELSE rule * 0.75::DOUBLE + (c_custkey % 89) * 0.25::DOUBLE END, 6) AS final FROM u),
r AS (SELECT *, row_number() OVER (ORDER BY final DESC, c_custkey) AS rank, count(*) OVER () AS total FROM f) SELECT c_custkey, final, rank, {_BAND} AS band FROM r""")
def final_blend_rank(t: Tables):
    model = F.when(F.col("c_custkey") % 10 != 0, (F.col("c_custkey") % 89).cast("double"))
    final = customer_rules(t).select("c_custkey", rounded(sc.final_score(F.col("rule"), model), 6).alias("final"))
    out = with_position(final, "final", ["c_custkey"])
    return out.select("c_custkey", "final", "rank", band(F.col("rank"), F.col("total")).alias("band"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_append(t: Tables):
    return t.customer.join(t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("SELECT (SELECT count(*) FROM customer) AS customers, count(DISTINCT c_custkey) AS covered FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_cover(t: Tables):
    flags = t.customer.join(t.orders.select("o_custkey").distinct(), F.col("c_custkey") == F.col("o_custkey"), "left")
    return flags.agg(F.count("*").alias("customers"), F.count("o_custkey").alias("covered"))


@query("""WITH f AS (SELECT c_custkey, c_acctbal, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey),
w AS (SELECT c_custkey, 40 * CAST(c_acctbal < -500 AS INT) + 22 * CAST(c_acctbal < 0 AS INT) + 10 * CAST(n = 0 AS INT) + 4 * CAST(n > 15 AS INT) AS score, c_acctbal < -500 AS crit,
  concat_ws(';', CASE WHEN c_acctbal < -500 THEN 'deep debt' END, CASE WHEN c_acctbal < 0 THEN 'debt' END, CASE WHEN n = 0 THEN 'no orders' END, CASE WHEN n > 15 THEN 'many orders' END) AS reasons FROM f)
SELECT c_custkey, CAST(least(100, score) AS INT) AS score, reasons, CASE WHEN crit OR score >= 70 THEN 'critical' WHEN score >= 45 THEN 'high' WHEN score >= 22 THEN 'medium' WHEN score > 0 THEN 'low' ELSE 'none' END AS level FROM w""")
def rule_based_review(t: Tables):
    n = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    rows = t.customer.join(n, F.col("c_custkey") == F.col("o_custkey"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    debt = F.col("c_acctbal")
    found = sc.reasons([(debt < -500, "critical", F.lit("deep debt")), (debt < 0, "high", F.lit("debt")), (F.col("n") == 0, "medium", F.lit("no orders")), (F.col("n") > 15, "low", F.lit("many orders"))])
    out = rows.select("c_custkey", found.alias("r")).withColumn("score", sc.review_score(F.col("r")))
    return out.select("c_custkey", "score", F.array_join(F.transform("r", lambda x: x["title"]), ";").alias("reasons"), sc.review_level(F.col("score"), F.col("r")).alias("level"))
