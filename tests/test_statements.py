"""Page, statement and roll-up functions on small cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from lynxmark.functions import markup as m
from lynxmark.functions import statements as s
from lynxmark.operators import rollups


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


PAGE = """<form><input type="hidden" name="__A" value="1&amp;2"><input name="__B" type="hidden" value=""><input type="text" name="c" value="x"><input type="hidden" name="__A" value="9">
<a href="javascript:__doPostBack('g$next','')">n</a><select id="q" name="city"><option value="1"> One <b>x</b></option><option selected value="">All</option></select>
<table><tr><th>Day</th><th>Law</th><th>Day</th></tr><tr><td>113/1/2</td><td>No. <i>30</i></td></tr><tr></tr></table></form><script>var a = "<b>";</script>"""


def test_pages(spark):
    html, null = F.lit(PAGE), F.lit(None).cast("string")
    assert one(spark, m.hidden_fields(html)) == {"__A": "1&2", "__B": ""}
    assert one(spark, m.has_postback(html, "g$next")) and not one(spark, m.has_postback(html, "g$last"))
    assert [tuple(o) for o in one(spark, m.select_options(html, "city"))] == [("1", "One x"), ("", "All")]
    assert one(spark, m.select_options(html, "none")) == []
    assert one(spark, m.table_rows(html)) == [["Day", "Law", "Day"], ["113/1/2", "No. 30"]]
    assert one(spark, m.table_records(html)) == [{"Day": "113/1/2", "Law": "No. 30"}]
    assert one(spark, m.table_records(F.lit("no table"))) == []
    assert one(spark, m.page_lines(html))[:2] == ["n", "One"]
    for f in (m.page_lines, m.hidden_fields, m.table_rows):
        assert one(spark, f(null)) is None and not one(spark, f(F.lit("")))


def test_feed(spark):
    feed = "<rss><item><title><![CDATA[A &amp; B]]></title><link>u</link><pubDate>Wed, 21 Jan 2026 23:30:00 -0100</pubDate></item><item><title>C</title><pubDate>21 Jan 2026</pubDate></item></rss>"
    a, b = one(spark, m.feed_items(F.lit(feed)))
    assert (a.title, a.link, a.source, a.published) == ("A & B", "u", "", datetime.date(2026, 1, 22))
    assert (b.title, b.published) == ("C", datetime.date(2026, 1, 21))
    assert one(spark, m.feed_date(F.lit("Tue, 20 Jan 2026 08:00:00 GMT"))) == datetime.date(2026, 1, 20)
    assert one(spark, m.feed_date(F.lit("soon"))) is None


@pytest.mark.parametrize(
    "line,want", [("a 1,234 (5,678) 9.5%", [1234.0, -5678.0, 95.0]), ("none", []), ("", []), ("3﹒328﹒331", [3328331.0])]
)
def test_line_amounts(spark, line, want):
    assert one(spark, s.line_amounts(F.lit(line))) == want


def test_amounts(spark):
    nums = lambda *x: F.array(*map(F.lit, x)).cast("array<double>")
    cases = [((), None), ((7.0,), 7.0), ((1675731.0, 675731.0), 1675731.0), ((675731.0, 1675731.0), 1675731.0), ((5.0, 9.0), 5.0), ((1.0, 2.0, 3.0), 2.0)]
    assert [one(spark, s.settled_amount(nums(*x))) for x, _ in cases] == [w for _, w in cases]
    lit, null = lambda x: F.lit(x).cast("double"), F.lit(None).cast("double")
    assert one(spark, s.without_stray_slashes(F.lit("37/7/7 a/b"))) == "3777 a/b"
    assert [one(spark, s.plausible_amount(lit(v), t)) for v, t in ((7, None), (0, lit(5)), (-2000, lit(4000)), (2000, lit(1000)), (2000, null), (2000, lit(0)), (float("nan"), None))] == [None, 0.0, -2000.0, None, 2000.0, 2000.0, None]
    assert [one(spark, s.plausible_headcount(lit(v), c)) for v, c in ((0, None), (2001, None), (10, lit(102)), (16, lit(102)), (10, null))] == [None, None, None, 16, 10]
    assert one(spark, s.consistent_surplus(lit(-1988771), lit(-1088771), lit(20155978), lit(22144749))) == -1988771
    assert one(spark, s.consistent_surplus(lit(-1088771), lit(-1988771), lit(20155978), lit(22144749))) == -1988771
    assert one(spark, s.consistent_surplus(null, lit(3), null, null)) == 3
    assert one(spark, s.consistent_surplus(lit(4), lit(3), null, null)) == 4


def test_registers(spark):
    texts = ["基礎評鑑－全數指標通過", "基礎評鑑－部分指標通過", "追蹤評鑑－全數指標通過", "", None]
    null = lambda x: F.lit(x).cast("string")
    assert [one(spark, s.evaluation_level(null(x))) for x in texts] == ["pass", "fail", "pass", "unknown", "unknown"]
    assert [tuple(one(spark, s.evaluation_flags(null(x)))) for x in texts] == [(0, 0), (1, 1), (0, 1), (0, 0), (0, 0)]
    assert [one(spark, s.violation(null(x))) for x in ("違反第 30 條", "超收幼生 3 人", "其他", None)] == ["兒少保護事件", "超收幼生", "行政管理缺失", "行政管理缺失"]
    names = ["甲職場互助教保服務中心", "甲互助教保服務中心", "甲國民小學", "甲幼兒園", "甲國民小學附設幼兒園", "甲國民中學附設幼兒園", "甲高中附設幼兒園", "甲公司附設幼兒園", None]
    want = ["職場互助教保服務中心", "社區部落互助教保服務中心", "非教保機構", "獨立幼兒園", "國小附設幼兒園", "國中附設幼兒園", "高中職大專附設幼兒園", "法人公司附設幼兒園", "非教保機構"]
    assert [one(spark, s.institution_kind(null(x))) for x in names] == want
    assert [str(one(spark, s.event_day(null(x)))) for x in ("處分 113年3月5日", "2024-02-30", "none", None)] == ["2024-03-05", "None", "None", "None"]


def test_rollups(spark):
    day = datetime.date(2026, 8, 1)
    rows = [(1, day, True, -1.0, 0.5, 9, "a"), (1, day, True, -1.0, 0.9, None, "b"), (1, None, True, -0.5, 1.0, 0, "c"), (1, day, False, 1.0, 0.0, 0, "d"), (2, None, False, 0.0, 0.0, None, "e")]
    posts = spark.createDataFrame(rows, "k long, day date, negative boolean, polarity double, intensity double, engagement long, id string")
    got = {r.k: r for r in rollups.entity_sentiment(posts, "k", "2026-08-31").collect()}
    decay = 0.5 ** (30 / 180)
    assert abs(got[1].weighted_negative - (0.5 * decay * (1 + 1 / 3) + 0.9 * decay + 0.5 ** (365 / 180))) < 1e-12
    assert (got[1].n_posts, got[1].n_negative, got[1].recent, got[1].burst) == (4, 3, 0, False)
    assert (got[2].score, got[2].p_value) == (0.0, 1.0)
    assert [r.id for r in rollups.latest_negatives(posts, "k", "id", 2).orderBy("place").collect()] == ["b", "a"]
    assert [tuple(r) for r in rollups.month_counts(posts, "k").collect()] == [(1, "2026-08", 3, 2)]
    assert rollups.negative_topics(posts, "k", "id").count() == 3
    assert rollups.entity_sentiment(posts.limit(0), "k", "2026-08-31").count() == 0
