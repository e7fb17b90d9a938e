"""The feature builder, overviews of posts and links by contained names, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.statements import evaluation_level
from ..operators import features, registers, rollups
from .registry import Tables, query

AS_OF, YEAR = "2024-01-25", 1999
SEVERITY = {"error": 3.0, "purchase": 2.5, "click": 1.5, "view": 1.0}
DISPOSITION = {"error": 2.6, "view": 1.1}
WINDOWS = {"pen_count_1y": 7, "pen_count_2y": 14, "pen_count_4y": 21}
_MAP = lambda m, other: "CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in m.items()) + f" ELSE {other}::DOUBLE END"
_PEN = f"""pen AS (SELECT 'C' || user_id AS inst_id, datediff('day', CASE WHEN event_id % 50 <> 0 THEN CAST(ts AS DATE) END, DATE '{AS_OF}') AS age, coalesce(CASE WHEN event_id % 11 <> 0 THEN event_type END, 'purchase') AS category,
  CASE WHEN event_id % 3 <> 0 THEN 'A' || (event_id % 4) END AS article, CASE WHEN event_id % 7 <> 0 THEN floor(value * 100) END AS fine, event_type FROM events),
pf AS (SELECT inst_id, count(*) FILTER (age <= 7) AS pen_count_1y, count(*) FILTER (age <= 14) AS pen_count_2y, count(*) FILTER (age <= 21) AS pen_count_4y, sum({_MAP(SEVERITY, 1.2).format(c="category")} * exp(-age / 10.0::DOUBLE)) AS decay,
  log10(1 + sum(coalesce(fine, 0))) AS pen_fine_total_log, log10(1 + max(coalesce(fine, 0))) AS pen_fine_max_log, count(*) FILTER ({_MAP(SEVERITY, 1.2).format(c="category")} >= 2.5) AS pen_severe, max({_MAP(DISPOSITION, 1.0).format(c="event_type")}) AS pen_disp_sev,
  greatest(0, 1 - least(min(age), 21) / 21.0::DOUBLE) AS pen_recency FROM pen WHERE age >= 0 GROUP BY inst_id),
pr AS (SELECT inst_id, max(n) - 1 AS pen_repeat FROM (SELECT inst_id, coalesce(article, category) AS a, count(*) AS n FROM pen WHERE age >= 0 GROUP BY ALL) GROUP BY inst_id)"""
_ROUNDED = "round(pen_fine_total_log, 6) AS pen_fine_total_log, round(pen_fine_max_log, 6) AS pen_fine_max_log, pen_severe, pen_repeat, pen_disp_sev, round(pen_recency, 6) AS pen_recency"


def penalties(t: Tables):
    k = F.col("event_id")
    return t.events.select(
        F.concat(F.lit("C"), "user_id").alias("inst_id"), F.when(k % 50 != 0, F.col("ts").cast("date")).alias("penalty_date"), F.when(k % 11 != 0, F.col("event_type")).alias("category"),
        F.when(k % 3 != 0, F.concat(F.lit("A"), k % 4)).alias("law_article"), F.when(k % 7 != 0, F.floor(F.col("value") * 100)).alias("fine_amount"), F.col("event_type").alias("disposition"),
    )


def penalty_part(t: Tables):
    return features.penalty_features(penalties(t), "inst_id", AS_OF, SEVERITY, DISPOSITION, "purchase", WINDOWS, 10.0)


@query(f"WITH {_PEN} SELECT inst_id, CAST(pen_count_1y AS BIGINT) AS pen_count_1y, CAST(pen_count_2y AS BIGINT) AS pen_count_2y, CAST(pen_count_4y AS BIGINT) AS pen_count_4y, round(decay, 4) AS pen_decay, {_ROUNDED} FROM pf JOIN pr USING (inst_id)")
def penalty_features(t: Tables):
    made = penalty_part(t)
    return made.select("inst_id", *WINDOWS, "pen_decay", F.round("pen_fine_total_log", 6).alias("pen_fine_total_log"), F.round("pen_fine_max_log", 6).alias("pen_fine_max_log"), "pen_severe", "pen_repeat", "pen_disp_sev", F.round("pen_recency", 6).alias("pen_recency"))


_EVAL = f"""ev AS (SELECT 'C' || o_custkey AS inst_id, year(o_orderdate) AS y, o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'fail' WHEN 'O' THEN 'pass' ELSE 'unknown' END AS level, CAST(o_orderkey % 5 AS DOUBLE) AS items, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 100 AS DOUBLE) ELSE 0 END AS score FROM orders WHERE year(o_orderdate) <= {YEAR}),
ef AS (SELECT inst_id, arg_max(level, (y, k)) AS eval_level, arg_max(items, (y, k)) AS eval_items_failed, arg_max(items % 2, (y, k)) AS eval_followup, nullif(arg_max(score, (y, k)), 0) AS eval_score, CAST(count(*) FILTER (level = 'fail') AS DOUBLE) AS eval_fail_history FROM ev GROUP BY inst_id)"""


def evaluation_part(t: Tables):
    k = F.col("o_orderkey")
    text = F.when(F.col("o_orderstatus") == "F", "基礎評鑑－部分指標通過").when(F.col("o_orderstatus") == "O", "基礎評鑑－全數指標通過").otherwise("")
    rows = t.orders.select(F.concat(F.lit("C"), "o_custkey").alias("inst_id"), F.year("o_orderdate").alias("eval_year"), "o_orderkey", text.alias("result"), (k % 5).alias("items_failed"), (k % 5 % 2).alias("followup_required"), F.when(k % 4 != 0, k % 100).alias("score"))
    return features.evaluation_features(rows, "inst_id", YEAR, evaluation_level(F.col("result")), "o_orderkey")


@query(f"WITH {_EVAL} SELECT inst_id, eval_level, eval_items_failed, eval_followup, eval_score, eval_fail_history, CASE eval_level WHEN 'fail' THEN 100.0::DOUBLE WHEN 'pass' THEN 0 END AS eval_penalty FROM ef")
def evaluation_features(t: Tables):
    return evaluation_part(t)


_YEARLY = """ys AS (SELECT 'C' || o_custkey AS inst_id, year(o_orderdate) AS y, sum(o_totalprice) FILTER (o_orderkey % 3 <> 0) AS a, sum(o_totalprice) FILTER (o_orderpriority = '1-URGENT') AS b FROM orders WHERE year(o_orderdate) <= 2000 GROUP BY ALL),
ya AS (SELECT inst_id, max(c) AS c FROM (SELECT inst_id, abs((a - lag(a) OVER (PARTITION BY inst_id ORDER BY y)) / abs(lag(a) OVER (PARTITION BY inst_id ORDER BY y))) AS c FROM ys WHERE coalesce(a, 0) <> 0) GROUP BY inst_id),
yb AS (SELECT inst_id, max(c) AS c FROM (SELECT inst_id, abs((b - lag(b) OVER (PARTITION BY inst_id ORDER BY y)) / abs(lag(b) OVER (PARTITION BY inst_id ORDER BY y))) AS c FROM ys WHERE coalesce(b, 0) <> 0) GROUP BY inst_id),
yf AS (SELECT inst_id, CASE WHEN ya.c IS NULL THEN 0 ELSE greatest(0, least(100, (ya.c - 0.15::DOUBLE) / 0.65::DOUBLE * 100)) END AS yoy_expense_score, CASE WHEN yb.c IS NULL THEN 0 ELSE greatest(0, least(100, (yb.c - 0.15::DOUBLE) / 0.65::DOUBLE * 100)) END AS yoy_personnel_score, 1.0::DOUBLE AS fin_available
  FROM (SELECT DISTINCT inst_id FROM ys) LEFT JOIN ya USING (inst_id) LEFT JOIN yb USING (inst_id))"""


def yearly_part(t: Tables):
    price = F.col("o_totalprice")
    rows = t.orders.groupBy(F.concat(F.lit("C"), "o_custkey").alias("inst_id"), F.year("o_orderdate").alias("fiscal_year")).agg(F.sum(F.when(F.col("o_orderkey") % 3 != 0, price)).alias("total_expense"), F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", price)).alias("expense_personnel"))
    return features.yearly_features(rows, "inst_id", {"yoy_expense_score": "total_expense", "yoy_personnel_score": "expense_personnel"}, features.fiscal_cut(F.lit("2000-07-15").cast("date")))


@query(f"WITH {_YEARLY} SELECT inst_id, round(yoy_expense_score, 2) AS yoy_expense_score, round(yoy_personnel_score, 2) AS yoy_personnel_score, fin_available FROM yf")
def yearly_features(t: Tables):
    return yearly_part(t).select("inst_id", "yoy_expense_score", "yoy_personnel_score", "fin_available")


@query(f"""WITH {_PEN}, {_EVAL}, {_YEARLY} SELECT 'C' || c_custkey AS inst_id, CAST(c_custkey % 240 AS INT) AS capacity, CAST(greatest(0, 2024 - coalesce(CASE WHEN c_custkey % 6 <> 0 THEN 1990 + c_custkey % 40 END, 2024)) AS INT) AS inst_age, CAST(coalesce(pen_count_1y, 0) AS BIGINT) AS pen_count_1y,
  CAST(coalesce(pen_repeat, 0) AS BIGINT) AS pen_repeat, round(coalesce(pen_recency, 0), 6) AS pen_recency, eval_level, eval_fail_history, round(yoy_expense_score, 2) AS yoy_expense_score, coalesce(fin_available, 0) AS fin_available
  FROM customer LEFT JOIN pf ON pf.inst_id = 'C' || c_custkey LEFT JOIN pr ON pr.inst_id = 'C' || c_custkey LEFT JOIN ef ON ef.inst_id = 'C' || c_custkey LEFT JOIN yf ON yf.inst_id = 'C' || c_custkey""")
def institution_features(t: Tables):
    k = F.col("c_custkey")
    masters = t.customer.select(F.concat(F.lit("C"), k).alias("inst_id"), (k % 240).cast("int").alias("approved_capacity"), F.when(k % 6 != 0, (1990 + k % 40).cast("int")).alias("found_year"))
    made = features.institution_features(masters, "inst_id", [penalty_part(t), evaluation_part(t), yearly_part(t)], ("pen_count_1y", "pen_repeat", "pen_recency", "fin_available"), AS_OF)
    return made.select("inst_id", "capacity", "inst_age", "pen_count_1y", "pen_repeat", F.round("pen_recency", 6).alias("pen_recency"), "eval_level", "eval_fail_history", "yoy_expense_score", "fin_available")


@query("""WITH m AS (SELECT conv_id, turn, lower(text) AS t FROM conversations), k AS (SELECT DISTINCT lower(split_part(text, ' ', 3)) AS name FROM benchmark), n AS (SELECT name, 'N' || name AS inst_id FROM k WHERE length(name) >= 4)
SELECT conv_id, turn, (SELECT min(inst_id) FROM n WHERE contains(t, name)) AS inst_id FROM m""")
def contained_names(t: Tables):
    word = F.lower(F.coalesce(F.try_element_at(F.split("text", " "), F.lit(3)), F.lit("")))
    masters = t.benchmark.select(word.alias("name")).distinct().withColumn("inst_id", F.concat(F.lit("N"), "name"))
    rows = t.conversations.select("conv_id", "turn", F.lower("text").alias("t"))
    return registers.first_name_in(rows, masters, "t", "name", "inst_id", "name").select("conv_id", "turn", "inst_id")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def known_institutions(t: Tables):
    facts = t.lineitem.where("l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"))
    return registers.known_or_all(t.supplier.select("s_suppkey"), facts, "s_suppkey")


@query("""WITH p AS (SELECT user_id, CASE WHEN event_id % 40 <> 0 THEN strftime(ts, '%Y-%m-%d') END AS d, event_type, value > 60 AS negative FROM events),
m AS (SELECT left(d, 7) AS month, count(*) AS total, count(*) FILTER (negative) AS negative FROM p WHERE d IS NOT NULL GROUP BY ALL ORDER BY month DESC LIMIT 30)
SELECT 'month' AS kind, month AS name, total, negative FROM m UNION ALL SELECT 'source', event_type, count(*), count(*) FILTER (negative) FROM p GROUP BY event_type UNION ALL SELECT 'all', 'posts', count(*), count(*) FILTER (negative) FROM p""")
def post_overview(t: Tables):
    day = F.when(F.col("event_id") % 40 != 0, F.col("ts").cast("date"))
    return rollups.post_overview(t.events.select(day.alias("day"), F.col("event_type").alias("source"), (F.col("value") > 60).alias("negative")))
