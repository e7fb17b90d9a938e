"""Evidence, reviews, keywords, forum rows, unit rows, notes, workbook and static files."""

import statistics
import zipfile

from pyspark.sql import functions as F

from lynxmark.functions import markup, names, statements
from lynxmark.operators import evidence, keywords, models, texts, validation
from lynxmark.sources import sinks


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column).first()[0]


def test_forum_rows(spark):
    page = """<div class="r-ent"><div class="nrec"><span class="hl f1">爆</span></div><div class="title">
    <a href="/bbs/Kids/M.1700000000.A.1.html">[問題] 甲園 &amp; 乙園</a></div><div class="meta"><div class="date">11/15</div></div></div>
    <div class="r-ent"><div class="nrec"></div><div class="title">(本文已被刪除) [x]</div><div class="date"> 1/02</div></div>
    <div class="r-ent"><div class="nrec"><span>7</span></div><div class="title"><a href="/b">丙</a></div><div class="date"> 2/30</div></div>
    <div class="r-ent"><div class="nrec">X1</div><div class="title"><a href="/c">丁</a></div><div class="date">3/04</div></div>"""
    got = [tuple(map(str, r)) for r in one(spark, markup.forum_rows(F.col("h"), 2025, "https://a"), h=page)]
    assert got == [("[問題] 甲園 & 乙園", "https://a/bbs/Kids/M.1700000000.A.1.html", "100", "2023-11-15"), ("丙", "https://a/b", "7", "None"), ("丁", "https://a/c", "None", "2025-03-04")]
    assert one(spark, markup.forum_rows(F.col("h"), 2025), h="no rows") == []


def test_unit_rows(spark):
    row = lambda s: one(spark, statements.unit_row(F.col("s")), s=s)
    assert tuple(row("13601 新北市立 三芝幼兒園 37/7﹒328﹒331 1,000,000 5")) == ("kindergarten", "新北市立三芝幼兒園", 377328331.0, 1000000.0)
    assert tuple(row("13012 新北市板橋區板橋國民小學 2,000 (1,000)")) == ("school", "新北市板橋區板橋國民小學", 2000.0, -1000.0)
    assert row("13601 新北市立三芝幼兒園 5") is None and row("合計 1 2 3") is None and row("") is None and row(None) is None


def test_headcounts(spark):
    page = "一、一般概況 核定 招收 120 人，實際 98 人。員工人數 20 人，教保 15 人。"
    assert tuple(one(spark, statements.headcounts(F.col("p")), p=page)) == (120, 98, 20, 15)
    assert tuple(one(spark, statements.headcounts(F.col("p")), p="核定招收人數60人。其後 900")) == (60, 60, None, None)
    assert tuple(one(spark, statements.headcounts(F.col("p")), p="核定招收120人，實際9人。"))[1] is None  # under a share of the capacity
    assert tuple(one(spark, statements.headcounts(F.col("p")), p=None)) == (None,) * 4


def test_search_queries(spark):
    ask = lambda n, p: one(spark, names.search_queries(F.col("n"), F.col("p")), n=n, p=p)
    assert ask("新北市安溪非營利幼兒園", "") == ['"新北市安溪非營利幼兒園"', '"安溪幼兒園" 新北']
    assert ask("甲幼兒園", "板橋區") == ['"甲幼兒園"'] and ask(None, None) == []


def test_keywords(spark):
    words = keywords.vocabulary({"a": (2.0, ["霸凌", "罵"]), "b": (1.0, ["霸凌", "食物"])}, {"食物": 3.0, "很吵": 0.5})
    assert words == {"霸凌": ("a", 2.0), "食物": ("b", 1.0), "很吵": (keywords.NEGATIVE, 0.5)}
    posts = spark.createDataFrame([("霸凌霸凌 天天塞車",), ("天天塞車 的確很吵",), ("天天塞車，霸凌",), (None,), ("",)], "t string")
    got = [tuple(r) for r in keywords.keywords(posts, "t", words, ("的",), 4).collect()]
    # Three new words occur as often; the one of four characters holds the others and goes.
    assert got == [(1, "霸凌", 3, "a", 2.0, "詞庫"), (2, "很吵", 1, keywords.NEGATIVE, 0.5, "詞庫"), (3, "天塞車", 3, keywords.NEW, 1.0, "新詞發現"), (4, "天天塞", 3, keywords.NEW, 1.0, "新詞發現")]
    assert keywords.keywords(posts.limit(0), "t", words).count() == 0
    assert one(spark, texts.normalized(F.col("t")), t=" ＡＢ https://x.y/z 甲") == "AB   甲"


def test_peers_and_views(spark):
    rows = spark.createDataFrame([("a", "g", "k", 3.0), ("b", "g", "k", None), ("c", "g", "k", 3.0), ("d", "h", "k", 9.0), ("e", None, "m", 1.0)], "id string, g string, k string, o double")
    got = {(r.id, r.place): (r.peer_group, r.peer_count, r.peer) for r in evidence.peers(rows, "id", "g", "k", "o", 2).collect()}
    assert got == {
        ("a", 1): ("g", 2, "c"), ("a", 2): ("g", 2, "b"), ("b", 1): ("g", 2, "a"), ("b", 2): ("g", 2, "c"), ("c", 1): ("g", 2, "a"), ("c", 2): ("g", 2, "b"),
        ("d", 1): ("k", 3, "a"), ("d", 2): ("k", 3, "c"),
    }
    facts = spark.createDataFrame([("a", 1), ("a", 3), ("a", 2)], "id string, n int")
    view = evidence.evidence(rows, "id", {"facts": evidence.gathered(facts, "id", [F.desc("n")], ["n"], 2, "of")})
    assert {r.id: r.facts and [x.n for x in r.facts.of] for r in view.collect()} == {"a": [3, 2], "b": None, "c": None, "d": None, "e": None}
    assert [r.id for r in evidence.targets(rows, "id", "o", 2).collect()] == ["d", "a"]
    made = evidence.review(rows, "id", [(F.col("o") > 2, "high", F.lit("x"))], evidence.targets(rows, "id", "o", 1)).collect()
    assert [tuple(r) for r in made] == [("d", 22, "medium", ["x"])]


def test_validation_edges(spark):
    none = spark.createDataFrame([], "id string, s double, y int")
    got = {(r.part, r.name): r.value for r in validation.bundle(none, "s", "y", "id").collect()}
    assert got == {("whole", "n"): 0.0, ("whole", "positives"): 0.0, ("whole", "base_rate"): 0.0, ("whole", "auc"): 0.5}
    one_class = spark.createDataFrame([(1, 1.0, 2.0)], "y int, a double, b double")
    assert validation.calibrated_weights(one_class, "y", {"a": 0.7, "b": 0.3}) == {"a": 0.7, "b": 0.3}
    rows = spark.createDataFrame([(i, float(i % 10), 5.0, int(i % 10 > 4)) for i in range(100)], "k int, a double, b double, y int")
    assert validation.calibrated_weights(rows, "y", {"a": 0.5, "b": 0.5}) == {"a": 1.0, "b": 0.0}
    ranked = spark.createDataFrame([("a", 1, 1), ("b", 2, 0)], "id string, rank int, y int")
    events = spark.createDataFrame([("a", "2024-01-01"), ("a", None), ("a", "2024-02-01"), ("b", "2024-03-01")], "id string, d string")
    row = validation.lead_and_coverage(ranked, events, "id", "y", "d", "2024-01-01").first()
    assert tuple(row) == (1, 50.0, 1, 1, 1.0, 31.0, 31.0, 31, 31)


def test_workbook_and_static_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "甲", 61.234, 10.0, ["x", "y"]), ("b", 2, "乙", 5.0, None, [])], "inst_id string, rank int, name string, score double, compliance double, top_reasons array<string>")
    at_k = spark.createDataFrame([(20, 0.5, 0.25, 2.0)], "k int, precision double, recall double, lift double")
    weights = spark.createDataFrame([("f", 0.5, 1.649)], "feature string, coef double, odds_ratio double")
    path = str(tmp_path / "risk.xlsx")
    sinks.write_risk_workbook(path, rows, rows.withColumn("wave", F.lit(1)), {"覆蓋率": 20.0}, at_k, {"AUC": 0.8}, weights, "2024")
    with zipfile.ZipFile(path) as book:
        parts = [book.read(f"xl/worksheets/sheet{i}.xml").decode() for i in (1, 2, 3)]
    assert "風險排名" in parts[0] and "x；y" in parts[0] and 'r="A4"' in parts[0] and "覆蓋率" in parts[1] and "批次" in parts[1] and "Precision@K" in parts[2] and "勝算比" in parts[2]
    first = sinks.risk_list(rows).where("`機構代碼` = 'a'").first()
    assert len(first) == 23 and first["行政區"] is None and first[-1] == "x；y" and first[18] == 10.0
    sinks.write_static(str(tmp_path / "web"), {"summary": at_k}, rows, rows.select("inst_id", "score"))
    assert set(spark.read.json(f"{tmp_path}/web/institutions").columns) == {"inst_id", "name", "rank", "score", "top_reasons"}
    assert spark.read.json(f"{tmp_path}/web/institution").count() == 2


def test_exact_medians(spark):
    wide = [(float(i * 37 % 101), None if i % 3 else i / 7, 1e308 if i % 2 else -1e308, 5.0, float("nan")) for i in range(200)]
    names_ = ["a", "b", "c", "d", "e"]
    got = models.medians(spark.createDataFrame(wide, ", ".join(f"{n} double" for n in names_)), names_)
    want = [statistics.median([v for v in column if v is not None]) for column in list(zip(*wide))[:4]]
    assert [got[n] for n in names_] == [*want, None]
    assert models.medians(spark.createDataFrame([], "a double"), ["a"]) == {"a": None}
    one_ = spark.createDataFrame([(1.0, 4.0), (2.0, 4.0), (9.0, None)], "a double, b double")
    z = models.standardise(one_, ["a", "b"]).collect()
    assert [round(r.a, 4) for r in z] == [-0.6745, 0.0, 4.7214] and [r.b for r in z] == [0.0] * 3
