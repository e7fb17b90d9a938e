"""Statements, peers, registers, explanations and summaries on the driver's tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import names
from ..functions.columns import rounded
from ..operators import finance, overview, registers
from ..operators.forensics import digit_counts
from ..operators.scoring import DIMENSIONS, dimension_score, ranked
from .registry import Tables, query

_ID = "'C' || o_custkey"
_FIN = f"""fin AS (SELECT {_ID} AS inst_id, CAST(year(o_orderdate) AS INT) AS fiscal_year,
  sum(l_extendedprice) FILTER (l_returnflag = 'A') AS revenue_tuition, sum(l_extendedprice) FILTER (l_returnflag = 'R') AS revenue_subsidy, sum(l_extendedprice) FILTER (l_returnflag = 'N') AS revenue_other,
  CASE WHEN o_custkey % 3 <> 0 THEN sum(l_extendedprice) END AS total_revenue, sum(l_extendedprice * l_discount) * 6 AS expense_personnel, sum(l_extendedprice * l_tax) * 5 AS expense_teaching,
  sum(l_quantity) * 500 AS expense_facility, sum(l_quantity) * 100 AS expense_admin, CASE WHEN o_custkey % 4 = 0 THEN sum(l_quantity) * 1200 END AS total_expense,
  CASE WHEN o_custkey % 2 = 0 THEN sum(l_extendedprice) / 20 END AS surplus, CAST(o_custkey % 50 AS INT) AS students_avg
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, year(o_orderdate))"""


def statements(t: Tables):
    price, quantity, key = F.col("l_extendedprice"), F.col("l_quantity"), F.col("o_custkey")
    joined = t.lineitem.select("l_orderkey", "l_extendedprice", "l_discount", "l_tax", "l_quantity", "l_returnflag").join(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    flagged = lambda flag: F.sum(F.when(F.col("l_returnflag") == flag, price))
    made = joined.groupBy(key, F.year("o_orderdate").alias("fiscal_year")).agg(
        flagged("A").alias("revenue_tuition"), flagged("R").alias("revenue_subsidy"), flagged("N").alias("revenue_other"), F.sum(price).alias("p"), (F.sum(price * F.col("l_discount")) * 6).alias("expense_personnel"),
        (F.sum(price * F.col("l_tax")) * 5).alias("expense_teaching"), (F.sum(quantity) * 500).alias("expense_facility"), (F.sum(quantity) * 100).alias("expense_admin"), (F.sum(quantity) * 1200).alias("q"),
    )
    return made.withColumns(
        {"inst_id": F.concat(F.lit("C"), key), "total_revenue": F.when(key % 3 != 0, F.col("p")), "total_expense": F.when(key % 4 == 0, F.col("q")), "surplus": F.when(key % 2 == 0, F.col("p") / 20), "students_avg": (key % 50).cast("int")}
    ).drop("p", "q", "o_custkey")


_FILLED = f"""{_FIN}, filled AS (SELECT * REPLACE (coalesce(nullif(total_revenue, 0), nullif(coalesce(revenue_tuition, 0) + coalesce(revenue_subsidy, 0) + coalesce(revenue_other, 0), 0)) AS total_revenue,
  coalesce(nullif(total_expense, 0), nullif(coalesce(expense_personnel, 0) + coalesce(expense_teaching, 0) + coalesce(expense_facility, 0) + coalesce(expense_admin, 0), 0)) AS total_expense) FROM fin),
surplussed AS (SELECT * REPLACE (coalesce(surplus, total_revenue - total_expense) AS surplus), CAST(NULL AS DOUBLE) AS expense_meal, nullif(students_avg, 0) AS students FROM filled),
ratios AS (SELECT *, {", ".join(f"{a} / nullif({b}, 0)::DOUBLE AS {name}" for name, (a, b) in finance.RATIOS.items())} FROM surplussed)"""


@query(f"WITH {_FILLED} SELECT inst_id, fiscal_year, round(total_revenue + 1e-6, 2) AS total_revenue, round(total_expense + 1e-6, 2) AS total_expense, round(surplus + 1e-6, 2) AS surplus, {', '.join(f'round({r} + 1e-9, 6) AS {r}' for r in finance.RATIOS)} FROM ratios")
def financial_ratios(t: Tables):
    made = finance.financial_ratios(statements(t))
    return made.select("inst_id", "fiscal_year", *(rounded(F.col(c) + 1e-6, 2).alias(c) for c in ("total_revenue", "total_expense", "surplus")), *(rounded(F.col(r) + 1e-9, 6).alias(r) for r in finance.RATIOS))


_INST = """inst AS (SELECT 'C' || c_custkey AS inst_id, c_name AS name, r_name AS city, n_name AS district, c_mktsegment AS org_type, CAST(c_custkey % 240 AS INT) AS approved_capacity, c_acctbal
  FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"""
_PEER = "org_type || '|' || CASE WHEN approved_capacity < 60 THEN '小型' WHEN approved_capacity < 120 THEN '中型' WHEN approved_capacity < 200 THEN '大型' ELSE '特大型' END"


def institutions(t: Tables):
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    joined = t.customer.join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(F.concat(F.lit("C"), "c_custkey").alias("inst_id"), F.col("c_name").alias("name"), F.col("r_name").alias("city"), F.col("n_name").alias("district"), F.col("c_mktsegment").alias("org_type"), (F.col("c_custkey") % 240).cast("int").alias("approved_capacity"), "c_acctbal")


_WATCH = {"surplus_ratio": "high", "teaching_ratio": "low", "personnel_ratio": "both"}
_DEV = {"high": "greatest(0, z)", "low": "greatest(0, -z)", "both": "abs(z)"}


@query(f"""WITH {_FILLED}, {_INST}, latest AS (SELECT * FROM ratios QUALIFY row_number() OVER (PARTITION BY inst_id ORDER BY fiscal_year DESC) = 1),
f AS (SELECT inst.inst_id, {_PEER} AS peer, {", ".join(_WATCH)} FROM inst LEFT JOIN latest USING (inst_id)),
long AS (SELECT inst_id, peer, r, CASE r {" ".join(f"WHEN '{r}' THEN {r}" for r in _WATCH)} END AS v FROM f, (VALUES {", ".join(f"('{r}')" for r in _WATCH)}) k(r)),
own AS (SELECT peer, r, median(v) AS m, stddev_samp(v) AS sd, count(*) AS n FROM long WHERE v IS NOT NULL GROUP BY ALL), ownd AS (SELECT peer, r, median(abs(v - m)) * 1.4826::DOUBLE AS mad FROM long JOIN own USING (peer, r) WHERE v IS NOT NULL GROUP BY ALL),
al AS (SELECT r, median(v) AS m, stddev_samp(v) AS sd, count(*) AS n FROM long WHERE v IS NOT NULL GROUP BY ALL), ald AS (SELECT r, median(abs(v - m)) * 1.4826::DOUBLE AS mad FROM long JOIN al USING (r) WHERE v IS NOT NULL GROUP BY ALL),
p AS (SELECT inst_id, r, v, coalesce(own.n, 0) >= 8 AS near, CASE WHEN near THEN own.m ELSE al.m END AS m, CASE WHEN near THEN CASE WHEN ownd.mad > 0 THEN ownd.mad ELSE own.sd END ELSE CASE WHEN ald.mad > 0 THEN ald.mad ELSE al.sd END END AS s, CASE WHEN near THEN own.n ELSE al.n END AS n
  FROM long LEFT JOIN own USING (peer, r) LEFT JOIN ownd USING (peer, r) LEFT JOIN al USING (r) LEFT JOIN ald USING (r)),
z AS (SELECT inst_id, r, v, CASE WHEN s > 0 AND n >= 5 AND v IS NOT NULL THEN (v - m) / s ELSE 0 END AS z FROM p),
d AS (SELECT inst_id, r, CASE WHEN v IS NULL THEN 0 ELSE greatest(0, least(100, ((CASE r {" ".join(f"WHEN '{r}' THEN {_DEV[s]}" for r, s in _WATCH.items())} END) - 1) / 3 * 100)) END AS dev FROM z)
SELECT inst_id, {", ".join(f"round(max(dev) FILTER (r = '{r}'), 4) AS dev_{r}" for r in _WATCH)}, round(max(dev), 4) AS dev_max, round(avg(dev), 4) AS dev_mean FROM d GROUP BY inst_id""")
def peer_ratio_deviations(t: Tables):
    made = finance.financial_ratios(statements(t))
    latest = made.groupBy("inst_id").agg(*(F.max_by(r, "fiscal_year").alias(r) for r in _WATCH))
    rows = institutions(t).withColumn("peer", finance.peer_key(F.col("org_type"), F.col("approved_capacity"))).join(latest, "inst_id", "left")
    out = finance.peer_deviations(rows, "inst_id", "peer", _WATCH)
    return out.select("inst_id", *(rounded(c, 4).alias(c) for c in out.columns[1:]))


_CHI99 = "greatest(0, least(1, 1 - (SELECT sum(exp((49.5::DOUBLE + n) * ln(chi2 / 2) - chi2 / 2 - lgamma(49.5::DOUBLE + n + 1))) FROM range(600) r(n))))"


@query(f"""WITH e AS (SELECT l_suppkey, CAST(floor(abs(round(l_extendedprice))) AS BIGINT) % 100 AS ending FROM lineitem WHERE abs(round(l_extendedprice)) >= 100), c AS (SELECT l_suppkey, ending, count(*) AS c FROM e GROUP BY ALL),
p AS (SELECT l_suppkey, CAST(sum(c) AS BIGINT) AS n, 100 * sum(c * c) / sum(c)::DOUBLE - sum(c) AS chi2, max(c) / sum(c)::DOUBLE AS max_share, array_to_string(list_slice(list(lpad(CAST(ending AS VARCHAR), 2, '0') || ':' || c ORDER BY c DESC, ending), 1, 5), ',') AS top_endings FROM c GROUP BY l_suppkey HAVING sum(c) >= 60),
q AS (SELECT *, CASE WHEN chi2 <= 0 THEN 1 WHEN chi2 > 600 THEN 0 ELSE {_CHI99} END AS p_value FROM p),
s AS (SELECT *, 0.6::DOUBLE * least(1, greatest(0, -log10(greatest(p_value, 1e-12::DOUBLE)) / 6)) * 100 + 0.4::DOUBLE * greatest(0, least(100, (max_share - 0.02::DOUBLE) / 0.13::DOUBLE * 100)) AS score FROM q)
SELECT l_suppkey, n, round(chi2, 4) AS chi2, round(p_value, 6) AS p_value, round(max_share, 6) AS max_share, round(score, 3) AS score, CASE WHEN score < 20 THEN '均勻（正常）' WHEN score < 50 THEN '輕微群聚' WHEN score < 75 THEN '明顯群聚' ELSE '高度群聚' END AS level, top_endings FROM s""")
def last_two_levels(t: Tables):
    made = finance.last_two_score(t.lineitem, "l_suppkey", "l_extendedprice")
    return made.select("l_suppkey", "n", rounded("chi2", 4).alias("chi2"), rounded("p_value", 6).alias("p_value"), rounded("max_share", 6).alias("max_share"), rounded("score", 3).alias("score"), "level", "top_endings")


_D9 = range(1, 10)
_SHARE = ", ".join(f"CASE WHEN near THEN (g{d} - c{d}) / (gn - n)::DOUBLE WHEN tn > n THEN (t{d} - c{d}) / (tn - n)::DOUBLE ELSE {math.log10(1 + 1 / d)}::DOUBLE END AS s{d}" for d in _D9)
_CHI8 = " + ".join(f"CASE WHEN s{d} > 0 THEN (c{d} - n * s{d}) * (c{d} - n * s{d}) / (n * s{d}) ELSE 0 END" for d in _D9)


@query(f"""WITH a AS (SELECT l_suppkey, CAST(left(CAST(CAST(floor(abs(l_extendedprice)) AS BIGINT) AS VARCHAR), 1) AS INT) AS d FROM lineitem WHERE abs(l_extendedprice) >= 1),
c AS (SELECT l_suppkey, count(*) AS n, {", ".join(f"count(*) FILTER (d = {d}) AS c{d}" for d in _D9)} FROM a GROUP BY l_suppkey), g AS (SELECT c.*, s_nationkey AS grp FROM c JOIN supplier ON s_suppkey = l_suppkey),
gs AS (SELECT grp, sum(n) AS gn, {", ".join(f"sum(c{d}) AS g{d}" for d in _D9)} FROM g GROUP BY grp), ts AS (SELECT sum(n) AS tn, {", ".join(f"sum(c{d}) AS t{d}" for d in _D9)} FROM g),
j AS (SELECT *, gn - n >= 2000 AS near FROM g JOIN gs USING (grp), ts WHERE n >= 25), s AS (SELECT l_suppkey, n, {", ".join(f"c{d}" for d in _D9)}, {_SHARE} FROM j),
m AS (SELECT *, ({" + ".join(f"abs(c{d} / n::DOUBLE - s{d})" for d in _D9)}) / 9 AS mad, ({" + ".join(f"sqrt(2 * s{d} * (1 - s{d}) / (pi() * n))" for d in _D9)}) / 9 AS base, ({_CHI8}) / 2 AS h FROM s),
p AS (SELECT *, mad / base AS ratio, exp(-h) * (1 + h + h * h / 2 + h * h * h / 6) AS p_value, median(mad) OVER () AS middle FROM m)
SELECT l_suppkey, n, round(mad, 6) AS mad, round(p_value, 6) AS p_value, round(0.6::DOUBLE * least(1, greatest(0, -log10(greatest(p_value, 1e-12::DOUBLE)) / 5)) * 100 + 0.4::DOUBLE * greatest(0, least(100, (ratio - 1.1::DOUBLE) / 1.5::DOUBLE * 100)), 3) AS raw_score,
  CASE WHEN ratio < 1.2 THEN '符合' WHEN ratio < 1.6 THEN '輕微偏離' WHEN ratio < 2.2 THEN '明顯偏離' ELSE '高度偏離' END AS raw_level, round(mad / middle, 5) AS adjusted,
  CASE WHEN mad / middle < 1.25 THEN '符合' WHEN mad / middle < 1.6 THEN '輕微偏離' WHEN mad / middle < 2.0 THEN '明顯偏離' ELSE '高度偏離' END AS level, round(greatest(0, least(100, (mad / middle - 1.2::DOUBLE) * 100)), 3) AS score FROM p""")
def digit_conformity(t: Tables):
    counts = digit_counts(t.lineitem, "l_suppkey", "l_extendedprice").join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("grp")), "l_suppkey")
    made = finance.conformity(counts, "l_suppkey", "grp")
    return made.select("l_suppkey", "n", rounded("mad", 6).alias("mad"), rounded("p_value", 6).alias("p_value"), rounded("raw_score", 3).alias("raw_score"), "raw_level", rounded("adjusted", 5).alias("adjusted"), "level", rounded("score", 3).alias("score"))


_GROUPS = {"income": ("1-URGENT", "2-HIGH"), "cost": ("3-MEDIUM",), "other": ("5-LOW", "none such"), "absent": ("no account",)}


@query("SELECT " + _ID + " AS inst_id, CAST(year(o_orderdate) AS INT) AS fiscal_year, " + ", ".join(f"round(sum(o_totalprice) FILTER (o_orderpriority IN ({', '.join(repr(a) for a in v)})), 2) AS {k}" for k, v in _GROUPS.items()) + " FROM orders GROUP BY o_custkey, year(o_orderdate)")
def account_rollup(t: Tables):
    ledger = t.orders.select(F.concat(F.lit("C"), "o_custkey").alias("inst_id"), F.year("o_orderdate").alias("fiscal_year"), "o_orderpriority", "o_totalprice")
    made = finance.account_rollup(ledger, ["inst_id", "fiscal_year"], "o_orderpriority", "o_totalprice", _GROUPS)
    return made.select("inst_id", "fiscal_year", *(rounded(k, 2).alias(k) for k in _GROUPS))


_ROWS = [
    (1, None, 2e6, 1e6, None, None, None), (2, -1.0, 2e6, None, None, None, None), (3, 5e5, 2e6, None, None, None, None), (4, 2e6, 2e6, 3e6, None, None, None), (5, 2e6, 2e6, 1e6, 1e5, None, None),
    (6, 2e6, 2e6, 2e6, 5e5, -5e5, None), (7, 2e6, 2e6, 1e6, 9.5e5, None, 5e5), (8, 2e6, 2e6, 1e6, 9.5e5, None, 5e4), (9, 2e6, 1.5e6, None, None, None, 5e5), (10, 2e6, 1.5e6, None, None, None, None),
]
_FIELDS = ("k", "total_revenue", "total_expense", "expense_personnel", "expense_teaching", "expense_other", "surplus")
_VALUES = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in row) + ")" for row in _ROWS)


@query(f"""WITH v AS (SELECT k, {", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in _FIELDS[1:])} FROM (VALUES {_VALUES}) v({", ".join(_FIELDS)})),
o AS (SELECT *, coalesce(expense_other, 0) AS other, coalesce(expense_personnel, 0) + coalesce(expense_teaching, 0) AS known, expense_personnel IS NOT NULL OR expense_teaching IS NOT NULL AS detailed FROM v)
SELECT CAST(k AS BIGINT) AS k, CASE WHEN total_revenue IS NULL OR total_expense IS NULL THEN 'no total' WHEN total_revenue <= 0 OR total_expense <= 0 THEN 'total not positive' WHEN total_revenue < 1000000 OR total_expense < 1000000 THEN 'totals too small'
  WHEN expense_personnel > total_expense THEN 'personnel above expense' WHEN detailed AND abs(total_expense - known - other) > 0.05 * total_expense THEN 'parts differ from expense' WHEN detailed AND other < 0 AND -other > 0.15 * total_expense THEN 'negative remainder'
  WHEN abs(surplus - (total_revenue - total_expense)) > 0.05 * total_revenue THEN 'surplus differs' END AS reason FROM o""")
def statement_rejections(t: Tables):
    rows = t.spark.createDataFrame([tuple(r) for r in _ROWS], "k long, " + ", ".join(f"{f} double" for f in _FIELDS[1:]))
    return rows.select("k", finance.reject_reason(rows).alias("reason"))


_FEATURES = """feat AS (SELECT c_custkey, coalesce(n, 0) / 4.0::DOUBLE AS pen_decay, c_custkey % 4 AS pen_count_1y, CAST(c_custkey % 7 = 0 AS INT) AS pen_severe, c_custkey % 3 AS pen_repeat, log10(1 + coalesce(spent, 0) / 1000) AS pen_fine_total_log,
  (c_custkey % 11) / 11.0::DOUBLE AS pen_recency, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE (c_custkey % 5) * 0.75::DOUBLE END AS pen_disp_sev, CASE WHEN c_custkey % 2 = 0 THEN abs(c_acctbal) / 100 END AS dev_max, abs(c_acctbal) / 300 AS dev_mean, c_custkey % 101 AS last2_score,
  c_custkey % 53 AS round_score, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_custkey % 90 END AS yoy_expense_score, c_custkey % 120 AS anomaly_score, c_custkey % 37 AS first_digit_score, CAST(c_custkey % 9 <> 0 AS INT) AS fin_available,
  CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE c_custkey % 100 END AS eval_penalty, c_custkey % 6 AS eval_items_failed, CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE c_custkey % 4 END AS eval_fail_history, c_custkey % 83 AS senti_score, c_custkey % 61 AS senti_burst, c_custkey % 3 AS senti_child_topic
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS spent FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey)"""


def features(t: Tables):
    per = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("spent"))
    k, debt = F.col("c_custkey"), F.abs("c_acctbal")
    some = lambda m, x: F.when(k % m != 0, x)
    return t.customer.join(per, k == F.col("o_custkey"), "left").select(
        "c_custkey", (F.coalesce("n", F.lit(0)) / 4.0).alias("pen_decay"), (k % 4).alias("pen_count_1y"), (k % 7 == 0).cast("int").alias("pen_severe"), (k % 3).alias("pen_repeat"), F.log10(1 + F.coalesce("spent", F.lit(0.0)) / 1000).alias("pen_fine_total_log"),
        ((k % 11) / 11.0).alias("pen_recency"), some(5, (k % 5) * 0.75).alias("pen_disp_sev"), F.when(k % 2 == 0, debt / 100).alias("dev_max"), (debt / 300).alias("dev_mean"), (k % 101).alias("last2_score"), (k % 53).alias("round_score"),
        some(6, k % 90).alias("yoy_expense_score"), (k % 120).alias("anomaly_score"), (k % 37).alias("first_digit_score"), (k % 9 != 0).cast("int").alias("fin_available"), some(8, k % 100).alias("eval_penalty"), (k % 6).alias("eval_items_failed"),
        some(8, k % 4).alias("eval_fail_history"), (k % 83).alias("senti_score"), (k % 61).alias("senti_burst"), (k % 3).alias("senti_child_topic"),
    )


def _scaled(feature: str) -> str:
    """SQL of a feature's score; written out from the scales of the risk model."""
    return {
        "pen_decay": "coalesce(pen_decay, 0) / 6 * 100", "pen_count_1y": "coalesce(pen_count_1y, 0) * 35", "pen_severe": "coalesce(pen_severe, 0) * 40", "pen_repeat": "coalesce(pen_repeat, 0) * 30",
        "pen_fine_total_log": "pow(10, coalesce(pen_fine_total_log, 0)) / 3000", "pen_recency": "coalesce(pen_recency, 0) * 100", "pen_disp_sev": "(coalesce(nullif(pen_disp_sev, 0), 1) - 1) / 2 * 100",
        "eval_items_failed": "coalesce(eval_items_failed, 0) * 20", "eval_fail_history": "coalesce(eval_fail_history, 0) * 45", "senti_child_topic": "coalesce(senti_child_topic, 0) * 35",
    }.get(feature, feature)


def _mean(parts: list[tuple[str, float]]) -> str:
    clamped = lambda f: f"greatest(0, least(100, CAST({_scaled(f)} AS DOUBLE)))"
    there = lambda f: f"({_scaled(f)}) IS NOT NULL"
    top = " + ".join(f"CASE WHEN {there(f)} THEN {clamped(f)} * {w}::DOUBLE ELSE 0 END" for f, w in parts)
    return f"({top}) / nullif({' + '.join(f'CASE WHEN {there(f)} THEN {w}::DOUBLE ELSE 0 END' for f, w in parts)}, 0)"


_SCORED = {d: _mean([(f, w) for f, w, *_ in fs]) for d, fs in DIMENSIONS.items()}
_SCORED["financial"] = f"CASE WHEN fin_available = 1 THEN {_SCORED['financial']} ELSE {_mean([('anomaly_score', 1.0)])} END"


@query(f"WITH {_FEATURES} SELECT c_custkey, {', '.join(f'round(coalesce({x}, 0), 2) AS {d}' for d, x in _SCORED.items())} FROM feat")
def dimension_scores(t: Tables):
    f = features(t)
    return f.select("c_custkey", *(dimension_score(d, {c: F.col(c) for c in f.columns}).alias(d) for d in DIMENSIONS))


_REASONS = """[CASE WHEN pen_count_1y >= 1 THEN {'o': 1, 'k': 0, 't': '近一年內有裁罰紀錄'} END, CASE WHEN pen_repeat >= 1 THEN {'o': 1, 'k': 1, 't': '同一法條重複違規'} END, CASE WHEN pen_severe >= 1 THEN {'o': 0, 'k': 2, 't': '涉及重大違規類別'} END,
  CASE WHEN last2_score >= 60 THEN {'o': 1, 'k': 8, 't': '決算金額末兩位數出現異常群聚'} WHEN last2_score >= 30 THEN {'o': 2, 'k': 7, 't': '決算金額末兩位數出現異常群聚'} END, CASE WHEN round_score >= 30 THEN {'o': 2, 'k': 9, 't': '金額整數偏誤偏高'} END,
  CASE WHEN first_digit_score >= 40 THEN {'o': 3, 'k': 10, 't': '首位數分布偏離同儕（參考指標）'} END, CASE WHEN yoy_expense_score >= 40 THEN {'o': 2, 'k': 11, 't': '年度支出出現異常跳動'} END, CASE WHEN c_custkey % 5 = 0 THEN {'o': 1, 'k': 12, 't': '最近一次基礎評鑑未全數通過'} WHEN c_custkey % 4 = 0 THEN {'o': 3, 'k': 13, 't': '曾接受追蹤評鑑'} END,
  CASE WHEN senti_score >= 60 THEN {'o': 1, 'k': 15, 't': '社群輿情負面聲量偏高'} WHEN senti_score >= 40 THEN {'o': 2, 'k': 14, 't': '社群輿情負面聲量偏高'} END, CASE WHEN c_custkey % 19 = 0 THEN {'o': 0, 'k': 16, 't': '輿情出現爆量預警'} END]"""


@query(f"""WITH {_FEATURES}, r AS (SELECT c_custkey, list_sort(list_filter({_REASONS}, lambda x: x IS NOT NULL)) AS r FROM feat)
SELECT c_custkey, array_to_string(list_transform(r, lambda x: x.t), '；') AS reasons, array_to_string(list_transform(r[1:3], lambda x: x.t), '；') AS top_reasons, array_to_string(list_transform(list_filter(r, lambda x: x.o = 0), lambda x: x.t), '；') AS critical_flags FROM r""")
def explained_reasons(t: Tables):
    k = F.col("c_custkey")
    f = features(t).withColumns({"eval_level": F.when(k % 5 == 0, "fail").otherwise("pass"), "eval_followed": k % 4 == 0, "burst": k % 19 == 0}).drop("dev_max", "dev_mean")
    made = overview.explain(f, {c: F.col(c) for c in f.columns})
    return made.select("c_custkey", F.array_join(F.transform("reasons", lambda r: r["title"]), "；").alias("reasons"), F.array_join("top_reasons", "；").alias("top_reasons"), F.array_join("critical_flags", "；").alias("critical_flags"))


_BAND = "CASE WHEN (rank - 1) * 100 < total * 2 THEN 'critical' WHEN (rank - 1) * 100 < total * 8 THEN 'high' WHEN (rank - 1) * 100 < total * 25 THEN 'medium' WHEN (rank - 1) * 100 < total * 60 THEN 'low' ELSE 'minimal' END"
_DIM = f"dim AS (SELECT c_custkey, pen_count_1y, {', '.join(f'round(coalesce({x}, 0), 2) AS {d}' for d, x in _SCORED.items())} FROM feat)"
_RESCORED = f"""WITH {_FEATURES}, {_DIM}, ru AS (SELECT *, CAST(CAST(CAST((compliance * 0.35::DOUBLE + financial * 0.29::DOUBLE + evaluation * 0.12::DOUBLE + sentiment * 0.24::DOUBLE) / (0.35::DOUBLE + 0.29::DOUBLE + 0.12::DOUBLE + 0.24::DOUBLE) AS DECIMAL(28, 8)) AS DECIMAL(18, 2)) AS DOUBLE) AS rule_score,
  CAST(CAST(CAST((rank() OVER (ORDER BY c_custkey % 997) - 1 + 0.5::DOUBLE * count(*) OVER (PARTITION BY c_custkey % 997)) / count(*) OVER () * 100 AS DECIMAL(28, 8)) AS DECIMAL(18, 2)) AS DOUBLE) AS model_score FROM dim),
sc AS (SELECT *, CAST(CAST(CAST(rule_score * 0.75::DOUBLE + model_score * 0.25::DOUBLE AS DECIMAL(28, 8)) AS DECIMAL(18, 2)) AS DOUBLE) AS score FROM ru), rk AS (SELECT *, row_number() OVER (ORDER BY score DESC, c_custkey) AS rank, count(*) OVER () AS total FROM sc), bd AS (SELECT *, {_BAND} AS band FROM rk)"""


def rescored(t: Tables):
    return overview.rescore(features(t).withColumn("probability", F.col("c_custkey") % 997), "c_custkey", "probability")


@query(f"{_RESCORED} SELECT c_custkey, rule_score, model_score, score, rank, band, round((1 - (rank - 1) / total::DOUBLE) * 100, 6) AS percentile FROM bd")
def rescored_population(t: Tables):
    return rescored(t).select("c_custkey", "rule_score", "model_score", "score", "rank", "band", rounded("percentile", 6).alias("percentile"))


@query(f"""{_RESCORED} SELECT count(*) AS n_institutions, count(*) FILTER (band IN ('critical', 'high')) AS n_high_risk, round(count(*) FILTER (band IN ('critical', 'high')) * 100 / count(*)::DOUBLE, 1) AS high_risk_pct, count(*) FILTER (band = 'critical') AS n_critical,
  round(avg(score), 2) AS avg_score, count(*) FILTER (pen_count_1y > 0) AS n_penalized_4y, count(*) FILTER (c_custkey % 19 = 0) AS n_burst, count(*) FILTER (band IN ('critical', 'high') AND pen_count_1y = 0) AS n_priority_no_penalty,
  round(min(score) FILTER (band IN ('critical', 'high')), 2) AS priority_cut_score, round(median(score), 2) AS median_score FROM bd""")
def risk_summary(t: Tables):
    return overview.summary(rescored(t).withColumn("burst", F.col("c_custkey") % 19 == 0), penalised="pen_count_1y")


@query(f"""WITH {_FEATURES}, {_DIM} {" UNION ALL ".join(f"SELECT '{d}' AS dimension, round(avg({d}), 4) AS mean, round(median({d}), 4) AS median, round(quantile_cont({d}, 0.9), 4) AS p90 FROM dim" for d in ("compliance", "financial", "evaluation", "sentiment"))}""")
def dimension_overview(t: Tables):
    f = features(t)
    return overview.dimension_overview(f.select("c_custkey", *(dimension_score(d, {c: F.col(c) for c in f.columns}).alias(d) for d in DIMENSIONS)), tuple(DIMENSIONS))


@query(f"""WITH {_INST}, r AS (SELECT inst_id, row_number() OVER (ORDER BY c_acctbal DESC, inst_id) AS rank, count(*) OVER () AS total, c_acctbal, approved_capacity FROM inst), b AS (SELECT *, {_BAND} AS band FROM r)
SELECT inst_id, CASE band WHEN 'critical' THEN 7 WHEN 'high' THEN 14 WHEN 'medium' THEN 30 ELSE 0 END AS urgency_days, CASE band WHEN 'critical' THEN '立即專案稽查（含社政協同）' WHEN 'high' THEN '優先實地稽查' WHEN 'medium' THEN '書面查核加抽訪' WHEN 'low' THEN '常態抽查' ELSE '免額外查核' END AS mode,
  CASE WHEN approved_capacity % 7 >= greatest(approved_capacity % 5, approved_capacity % 11) THEN 'compliance' WHEN approved_capacity % 5 >= approved_capacity % 11 THEN 'financial' ELSE 'evaluation' END AS focus FROM b""")
def suggested_actions(t: Tables):
    rows = ranked(institutions(t), "c_acctbal", "inst_id")
    c = F.col("approved_capacity")
    return overview.actions(rows, F.col("band"), {"compliance": c % 7, "financial": c % 5, "evaluation": c % 11}).select("inst_id", "urgency_days", "mode", "focus")


@query(f"""WITH {_INST}, k AS (SELECT * FROM inst WHERE city = 'ASIA' AND c_acctbal BETWEEN 0 AND 8000 AND (contains(lower(name), '00') OR contains(lower(district), '00'))) SELECT inst_id, name, district, round(c_acctbal, 2) AS score, (SELECT count(*) FROM k) AS total FROM k ORDER BY c_acctbal DESC, inst_id LIMIT 40""")
def institution_list(t: Tables):
    page = registers.institution_list(institutions(t), {"city": "ASIA", "org_type": None}, ("c_acctbal", 0, 8000), " 00 ", ("name", "district"), fold=True, sort="c_acctbal", limit=40)
    return page.select("inst_id", "name", "district", rounded("c_acctbal", 2).alias("score"), "total")


@query(f"WITH {_INST} SELECT inst_id, city, name, (SELECT count(*) FROM inst WHERE org_type = 'BUILDING') AS total FROM inst WHERE org_type = 'BUILDING' ORDER BY coalesce(city, ''), inst_id LIMIT 30")
def institution_list_by_text(t: Tables):
    return registers.institution_list(institutions(t), {"org_type": "BUILDING"}, sort="city", descending=False, limit=30).select("inst_id", "city", "name", "total")


@query("""WITH m AS (SELECT min('P' || p_partkey) AS id, p_name AS name FROM part WHERE p_partkey % 2 = 0 GROUP BY p_name), f AS (SELECT p_partkey, CASE WHEN p_partkey % 9 <> 0 THEN p_name END AS name FROM part)
SELECT p_partkey, coalesce(m.id, CASE WHEN f.name <> '' THEN 'K' || upper(substr(sha1('X|' || f.name), 1, 10)) END, '') AS inst_id FROM f LEFT JOIN m USING (name)""")
def relinked_facts(t: Tables):
    master = t.part.where("p_partkey % 2 = 0").select(F.concat(F.lit("P"), "p_partkey").alias("inst_id"), F.col("p_name").alias("name"))
    facts = t.part.select("p_partkey", F.when(F.col("p_partkey") % 9 != 0, F.col("p_name")).alias("name"), F.lit("old").alias("inst_id"))
    return registers.relink(facts, master, "name", "inst_id", names.stable_id(F.lit("X"), F.col("name")), keep_unnamed=True).select("p_partkey", "inst_id")


@query("WITH c AS (SELECT p_partkey, split_part(p_name, ' ', 1) || (p_partkey % 700) AS canonical FROM part) SELECT canonical, min(p_partkey) AS p_partkey FROM c WHERE canonical <> '' GROUP BY canonical HAVING count(DISTINCT p_partkey) = 1")
def unambiguous_names(t: Tables):
    canonical = F.concat(F.try_element_at(F.split("p_name", " "), F.lit(1)), (F.col("p_partkey") % 700).cast("string"))
    return registers.unambiguous(t.part, canonical, "p_partkey")


@query("""SELECT 'kept' AS part, count(*) AS n, CAST(sum(new) AS BIGINT) AS ids FROM (SELECT s_suppkey + 1000 AS new FROM lineitem JOIN supplier ON l_suppkey = s_suppkey AND s_suppkey % 3 = 0) UNION ALL SELECT 'dropped', count(*), 0 FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0)""")
def remapped_ids(t: Tables):
    mapping = t.supplier.where("s_suppkey % 3 = 0").select("s_suppkey", (F.col("s_suppkey") + 1000).alias("new"))
    kept, dropped = registers.remap(t.lineitem.select("l_suppkey"), mapping, "l_suppkey", "s_suppkey", "new")
    one = kept.agg(F.lit("kept").alias("part"), F.count("*").alias("n"), F.sum("l_suppkey").alias("ids"))
    return one.union(dropped.select(F.lit("dropped"), "dropped", F.lit(0).cast("long")))


@query("""WITH m AS (SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 4 <> 0 THEN 'old' || s_suppkey END AS phone, 'official' AS source FROM supplier WHERE s_suppkey % 5 <> 0),
u AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'seen ' || s_name END AS s_name, 'new' || s_suppkey AS phone FROM supplier WHERE s_suppkey % 2 = 0)
SELECT coalesce(m.s_suppkey, u.s_suppkey) AS s_suppkey, coalesce(nullif(u.s_name, ''), m.s_name) AS s_name, coalesce(nullif(m.phone, ''), u.phone) AS phone, CASE WHEN m.s_suppkey IS NULL THEN 'new' WHEN u.s_suppkey IS NOT NULL THEN 'both' ELSE m.source END AS source FROM m FULL JOIN u ON m.s_suppkey = u.s_suppkey""")
def upserted_master(t: Tables):
    k = F.col("s_suppkey")
    master = t.supplier.where(k % 5 != 0).select("s_suppkey", "s_name", F.when(k % 4 != 0, F.concat(F.lit("old"), k)).alias("phone"), F.lit("official").alias("source"))
    updates = t.supplier.where(k % 2 == 0).select("s_suppkey", F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("seen "), "s_name")).alias("s_name"), F.concat(F.lit("new"), k).alias("phone"))
    return registers.upsert(master, updates, "s_suppkey", ("s_name",), ("phone",))


@query("SELECT o_orderkey, 'P' || lpad(CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS VARCHAR), 7, '0') AS post_id FROM orders")
def running_ordinals(t: Tables):
    return registers.with_ordinals(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], "P", 7, "post_id").select("o_orderkey", "post_id")


@query("SELECT label, count(*) AS n FROM (SELECT split_part(p_name, ' ', 2) AS label FROM part) GROUP BY label HAVING count(*) >= 2")
def unmatched_labels(t: Tables):
    return registers.frequent(t.part.select(F.coalesce(F.try_element_at(F.split("p_name", " "), F.lit(2)), F.lit("")).alias("label")), "label")


@query("SELECT 'orders' AS name, count(*) AS rows, count(DISTINCT o_custkey) AS keys, count(*) FILTER (o_custkey IS NULL) AS missing FROM orders UNION ALL SELECT 'events', count(*), count(DISTINCT user_id), count(*) FILTER (user_id IS NULL) FROM events")
def table_completeness(t: Tables):
    return registers.completeness({"orders": t.orders.withColumnRenamed("o_custkey", "key"), "events": t.events.withColumnRenamed("user_id", "key")}, "key")


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS INT) AS place FROM orders QUALIFY place <= 30")
def recent_facts(t: Tables):
    return registers.newest(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", [F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey")], 30).select("o_custkey", "o_orderkey", "place")


@query("SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS price FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY abs(o_totalprice - 100000), o_orderkey) = 1")
def nearest_amount(t: Tables):
    made = registers.nearest(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], F.col("o_totalprice"), F.lit(100000), "o_orderkey")
    return made.select("o_custkey", "o_orderkey", rounded("o_totalprice", 2).alias("price"))


@query("SELECT event_type AS category, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, event_type) AS INT) AS place FROM events GROUP BY event_type")
def category_counts(t: Tables):
    from pyspark.sql.window import Window

    per = t.events.groupBy(F.col("event_type").alias("category")).agg(F.count("*").alias("n"))  # one row a category
    return per.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "category")))


_COEF = [("pen_decay", 1.25), ("senti_score", -0.5), ("dev_max", 31.0), ("capacity", 0.0)]


@query("SELECT f AS feature, round(c, 4) AS coef, abs(c) AS abs, round(exp(greatest(-20, least(20, c))), 3) AS odds_ratio FROM (VALUES " + ", ".join(f"('{f}', {c}::DOUBLE)" for f, c in _COEF) + ") v(f, c)")
def feature_importance(t: Tables):
    return overview.importance(t.spark.createDataFrame(_COEF, "feature string, coef double"))


_NAMES = ["陽光森林文教股份有限公司臺北縣分公司附設新北市私立陽光小子幼兒園", "新北市萬里區萬里國民小學附設幼兒園", "新北市安溪非營利幼兒園(委託社團法人桃園市教保服務人員協會辦理)", "新北市立三芝幼兒園", ""]


@query("SELECT n AS name, c AS canonical FROM (VALUES " + ", ".join(f"('{n}', '{c}')" for n, c in zip(_NAMES, ("陽光小子", "萬里國民小學", "安溪", "三芝", ""))) + ") v(n, c)")
def canonical_names(t: Tables):
    rows = t.spark.createDataFrame([(n,) for n in _NAMES], "name string")
    return rows.select("name", names.canonical_name(F.col("name")).alias("canonical"))


_PLACES = [("新莊", "", "新莊區"), ("新苗區", "", "新莊區"), ("", "新北市三芝區淡金路1號", "三芝區"), ("鷺歌", None, "鶯歌區"), ("xx", "[207]新北市萬裡區1號", "萬里區"), ("板僑區", "", "板橋區"), ("新某區", "", ""), (None, None, "")]


@query("SELECT CAST(k AS INT) AS k, d AS district FROM (VALUES " + ", ".join(f"({k}, '{d}')" for k, (_, _, d) in enumerate(_PLACES)) + ") v(k, d)")
def districts(t: Tables):
    rows = t.spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(_PLACES)], "k int, text string, address string")
    return rows.select("k", names.district(F.col("text"), F.col("address")).alias("district"))


@query("""WITH s AS (SELECT o_custkey, sum(o_totalprice) AS a, sum(o_totalprice) FILTER (o_orderstatus = 'F') AS b FROM orders GROUP BY o_custkey)
SELECT o_custkey, coalesce(a >= 500000 AND b >= 500000 AND greatest(a, b) <= 3 * least(a, b), FALSE) AND b IS NOT NULL AS plausible FROM s""")
def plausible_totals(t: Tables):
    per = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("a"), F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("b"))
    return per.select("o_custkey", finance.plausible_totals(F.col("a"), F.col("b")).alias("plausible"))


@query("SELECT 'o_orderstatus' AS column, coalesce(o_orderstatus, '') AS value, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'o_orderpriority', coalesce(o_orderpriority, ''), count(*) FROM orders GROUP BY ALL")
def value_distribution(t: Tables):
    return registers.value_counts(t.orders, ["o_orderstatus", "o_orderpriority"])


@query(" UNION ALL ".join(f"SELECT * FROM (SELECT '{c}' AS board, s_suppkey, round({x}, 4) AS score, CAST(row_number() OVER (ORDER BY {x} DESC, s_suppkey) AS INT) AS place FROM supplier QUALIFY place <= {n})" for c, x, n in (("balance", "s_acctbal", 20), ("nation", "CAST(s_nationkey AS DOUBLE)", 15))))
def leaderboards(t: Tables):
    rows = t.supplier.select("s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    return registers.boards(rows, "s_suppkey", {"balance": 20, "nation": 15}).select("board", "s_suppkey", rounded("score", 4).alias("score"), "place")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT s_suppkey, 'late' FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 2 = 0")
def legacy_merge(t: Tables):
    k = F.col("s_suppkey")
    return registers.legacy_merge(t.supplier.where(k % 3 != 0).select("s_suppkey", "s_name"), t.supplier.where(k % 2 == 0).select("s_suppkey", F.lit("late").alias("s_name")), "s_suppkey")


_SCHOOLS = [("新北市萬里區萬里國民小學附設幼兒園", "萬里國民小學", True), ("新北市立三民國民中學附設幼兒園", "三民國民中學", True), ("新北市萬里區萬里國民小學", "萬里國民小學", False), ("新北市安溪非營利幼兒園", "安溪非營利幼兒園", True), ("", "", False)]


@query("SELECT n AS name, c AS core, k AS childcare FROM (VALUES " + ", ".join(f"('{n}', '{c}', {k})" for n, c, k in _SCHOOLS) + ") v(n, c, k)")
def school_names(t: Tables):
    rows = t.spark.createDataFrame([(n,) for n, _, _ in _SCHOOLS], "name string")
    return rows.select("name", names.school_core(F.col("name")).alias("core"), names.is_childcare(F.col("name")).alias("childcare"))
