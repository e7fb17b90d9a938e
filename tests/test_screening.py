"""Golden cases and edges of the screening operators."""

import math

import pytest
from pyspark.sql import functions as F

from lynxmark.functions import names
from lynxmark.functions.columns import chi2_tail, normal_cdf
from lynxmark.operators import finance, overview, registers, scoring, texts
from lynxmark.sources import sinks


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column).first()[0]


@pytest.mark.parametrize(
    "name,want",
    [
        ("陽光森林文教股份有限公司臺北縣分公司附設新北市私立陽光小子幼兒園", "陽光小子"), ("新北市萬里區萬里國民小學附設幼兒園", "萬里國民小學"), ("新北市安溪非營利幼兒園(委託社團法人桃園市教保服務人員協會辦理)", "安溪"),
        ("﹒ 新北市立三芝幼兒園 ﹍", "三芝"), (None, ""), ("   ", ""),
    ],
)
def test_canonical_names(spark, name, want):
    assert one(spark, names.canonical_name(F.col("n")), n=name) == want


def test_names_and_places(spark):
    assert one(spark, names.clean_address(F.col("a")), a="﹒[207] 新北市萬裡區瑪鋉路－1號") == "新北市萬里區瑪鋉路-1號"
    assert one(spark, names.district(F.col("d"), F.col("a")), d="新苗區", a=None) == "新莊區"
    assert one(spark, names.district(F.col("d"), F.col("a")), d="新X區", a="") == ""  # three districts lie at one edit
    assert one(spark, names.stable_id(F.lit("新北市"), F.col("n")), n=" 甲幼兒園 ") == one(spark, names.stable_id(F.lit("新北市"), F.col("n")), n="甲幼兒園")
    assert [one(spark, names.section_of(F.col("s")), s=s) for s in ("支 出 ﹌", "收入", "收入合計 1,000", "備註")] == ["expense", "revenue", None, None]
    assert one(spark, names.label_of(F.col("s")), s="人事費 二、三 $1,234") == "人事費二" and one(spark, names.label_of(F.col("s")), s="業務費(五) 9") == "業務費"
    assert one(spark, names.ratio_text("cost_per_student", F.col("v")), v=12345.6) == "12,346 元" and one(spark, names.ratio_text("meal_ratio", F.col("v")), v=0.1234) == "12.3%"
    assert one(spark, names.without_name(F.col("t"), F.col("n")), t="甲園很吵，甲園", n="甲園") == "該園很吵，該園"


def test_tails(spark):
    for x, want in ((0.0, 1.0), (99.0, 0.4810), (123.225, 0.05), (134.642, 0.01), (148.23, 0.001), (900.0, 0.0)):
        assert abs(one(spark, chi2_tail(F.col("x"), 99), x=x) - want) < 1e-3
    for x in (-9.0, -2.5, -0.3, 0.0, 1.96, 7.0):
        assert abs(one(spark, normal_cdf(F.col("x")), x=x) - 0.5 * (1 + math.erf(max(-8, min(8, x)) / math.sqrt(2)))) < 1e-9


def test_label_pick(spark):
    labels = ["教保費收入", "業務費", "延長照顧服務收入", "延長照顧服務支出", "材料費"]
    cases = {"教係費收入": "教保費收入", "緒務費丘同": "業務費", "延長照顧服務收入淨顒": "延長照顧服務收入", "延長照顧服務支": None, "業務費五": "業務費", "": None, "  ": None, None: None}
    rows = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.label for r in texts.nearest_label(rows, "t", labels).collect()} == cases


def loop_sentiment(text, negative, positive, degrees, negations):
    neg = pos = 0.0
    for word, w in negative.items():
        at = text.find(word)
        while at >= 0:
            ahead = text[max(0, at - 3) : at]
            much = max([1.0, *(v for d, v in degrees.items() if d in ahead)])
            if any(n in ahead for n in negations):
                pos += w * 0.6
            else:
                neg += w * much
            at = text.find(word, at + len(word))
    for word in positive:
        at = text.find(word)
        if at >= 0:
            ahead = text[max(0, at - 3) : at]
            if any(n in ahead for n in negations):
                neg += 0.8
            else:
                pos += max([1.0, *(v for d, v in degrees.items() if d in ahead)])
    return round(pos, 6), round(neg, 6)


def test_sentiment_against_a_loop(spark):
    lexicon = ({"bad": 1.5, "dirty": 1.0}, ["good", "kind"], {"very": 1.5, "so": 0.5, "!!": 2.0}, ["no", "n't"])
    rows = ["very bad, bad, no bad", "!!good and so kind", "no good, isn't dirty", "so bad !!dirty so good", "", "badbadbad very", "kind kind"]
    made = texts.negated_sentiment(spark.createDataFrame(list(enumerate(rows)), "k int, t string"), "k", "t", *lexicon)
    assert {r.k: (round(r.pos, 6), round(r.neg, 6)) for r in made.collect()} == {k: loop_sentiment(t, *lexicon) for k, t in enumerate(rows)}


def test_schedule_keeps_every_selected_row(spark):
    rows = spark.createDataFrame([(k, b) for k, b in enumerate(("critical", "high", "medium", "low", "minimal"), 1)], "rank int, band string")
    got = {r.band: (r.wave, str(r.due), r.hours) for r in scoring.schedule(rows, 5, "2026-09-01").collect()}
    assert got == {"critical": (1, "2026-09-08", 8.0), "high": (2, "2026-09-15", 6.0), "medium": (3, "2026-10-01", 3.5), "low": (4, "2026-10-31", 2.5), "minimal": (4, "2026-10-31", 2.5)}


def test_scores_of_missing_features(spark):
    row = spark.range(1).select(F.lit(None).cast("double").alias("eval_penalty"), F.lit(0.0).alias("pen_decay"), F.lit(30.0).alias("anomaly_score"), F.lit(0).alias("fin_available"))
    f = {c: F.col(c) for c in row.columns}
    got = row.select(*(scoring.dimension_score(d, f).alias(d) for d in scoring.DIMENSIONS)).first()
    assert got.financial == 30.0 and got.evaluation == 0.0 and got.sentiment == 0.0 and got.compliance == 0.0


def test_templates_hold_every_row(spark, tmp_path):
    df = spark.range(500).selectExpr("id as inst_id", "id * 2 as amount")
    (path,) = sinks.write_templates({"ledger": df}, f"file://{tmp_path}/t")
    assert spark.read.option("header", True).csv(path).count() == 500


def test_ratios_fall_back_to_parts(spark):
    rows = spark.createDataFrame([(0, 0, 30.0, 10.0, 5.0, None, 20.0, 10.0, None, 10), (1, None, None, None, None, None, None, None, None, 0)], "k int, total_revenue int, revenue_tuition double, revenue_subsidy double, revenue_other double, total_expense double, expense_personnel double, expense_meal double, surplus double, students_avg int")
    got = {r.k: r for r in finance.financial_ratios(rows).collect()}
    assert (got[0].total_revenue, got[0].total_expense, got[0].surplus) == (45.0, 30.0, 15.0)
    assert abs(got[0].personnel_ratio - 2 / 3) < 1e-12 and got[0].cost_per_student == 3.0 and got[0].teaching_ratio is None
    assert got[1].surplus is None and got[1].cost_per_student is None


def test_summary_of_nothing(spark):
    rows = spark.createDataFrame([], "score double, band string, pen_count_4y int, burst boolean")
    got = overview.summary(rows).first().asDict()
    assert set(got.values()) <= {0, 0.0}


def test_registers(spark):
    master = spark.createDataFrame([("K1", "甲"), ("K2", "乙")], "inst_id string, name string")
    facts = spark.createDataFrame([("x", "甲"), ("x", "丙"), ("x", None), ("x", "")], "inst_id string, name string")
    linked = registers.relink(facts, master, "name", "inst_id", F.concat(F.lit("N-"), "name"))
    assert sorted(r.inst_id for r in linked.collect()) == ["K1", "N-丙"]
    assert registers.relink(facts, master, "name", "inst_id", F.concat(F.lit("N-"), "name"), keep_unnamed=True).count() == 4
    assert registers.missing_tables({"a": master, "b": master.limit(0)}, ("a", "b", "c")) == ["b", "c"]
    assert registers.institution_list(master, sort="name", limit=0).count() == 2


def test_school_lookup(spark):
    rows = spark.createDataFrame([("K1", "新北市萬里區萬里國民小學附設幼兒園"), ("K2", "新北市立三民國民中學附設幼兒園"), ("K3", "新北市安溪非營利幼兒園")], "inst_id string, name string")
    assert {r.core: r.inst_id for r in names.school_lookup(rows).collect()} == {"萬里國民小學": "K1", "三民國民中學": "K2"}


def test_settings(spark, tmp_path):
    path, defaults = f"file://{tmp_path}/s.json", {"weights": {"a": 1.0, "b": 2.0}, "capacity": 40}
    assert sinks.load_settings(spark, path, defaults) == defaults
    sinks.save_settings(spark, path, {"weights": {"a": 5.0, "z": 1.0}, "名": "值"})
    assert sinks.load_settings(spark, path, defaults) == {"weights": {"a": 5.0, "b": 2.0}, "capacity": 40}
    sinks.save_settings(spark, path, {"capacity": 7})
    assert sinks.load_settings(spark, path, defaults)["capacity"] == 7


def against_sql(spark, folder, name, customers):
    """Rows of a query and of its SQL over these customers (key, nation, balance, segment, orders) and their orders of 1,000."""
    import duckdb

    from lynxmark.plans.catalogue import ORACLES, QUERIES

    orders = [(at, k, 1000.0) for at, k in enumerate(k for k, _, _, _, n in customers for _ in range(n))]
    spark.createDataFrame([x[:4] for x in customers], "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{folder}/orders.parquet")
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = con.execute(ORACLES[name])
    names = [x[0] for x in want.description]
    return sorted(map(tuple, QUERIES[name](spark, str(folder)).select(*names).collect())), sorted(want.fetchall())


def test_final_blend_rank_half_way(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "final_blend_rank", [(1599, 17, 9671.26, "FURNITURE", 6), (5602, 0, 3527.58, "AUTOMOBILE", 16), (10398, 5, 7463.98, "FURNITURE", 15)])
    assert got == want


@pytest.mark.parametrize("name", ["dimension_scores", "rescored_population"])
def test_dimensions_half_way(spark, tmp_path, name):
    got, want = against_sql(spark, tmp_path, name, [(8006935, 19, -985.5, "FURNITURE", 8), (26008615, 19, 2344.5, "AUTOMOBILE", 7), (49005273, 6, 4720.5, "AUTOMOBILE", 7)])
    assert got == want
