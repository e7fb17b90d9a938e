"""Page, statement and sentiment roll-up queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup, statements
from ..operators import rollups
from .registry import Tables, query

_AMOUNTS = r"list_filter(regexp_extract_all(text, '[0-9，﹒、‧,.·﹐﹑(（﹙︵﹝)）﹚︶﹞$￥﹩¥＄%﹪％]+'), lambda r: regexp_matches(r, '[0-9]'))"


@query(f"""WITH a AS (SELECT doc_id, unnest({_AMOUNTS}) AS r FROM documents),
v AS (SELECT doc_id, CAST(regexp_replace(r, '[^0-9]', '', 'g') AS DOUBLE) * CASE WHEN regexp_matches(r, '[(（﹙︵﹝)）﹚︶﹞]') THEN -1 ELSE 1 END AS v FROM a)
SELECT doc_id, count(*) AS n, count(*) FILTER (v < 0) AS negative, max(abs(v)) AS largest FROM v GROUP BY doc_id""")
def text_amounts(t: Tables):
    v = F.col("v")
    found = t.documents.select("doc_id", F.explode(statements.line_amounts(F.col("text"))).alias("v"))
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(v < 0).alias("negative"), F.max(F.abs(v)).alias("largest"))


@query("""SELECT l_orderkey, count(*) AS lines, count(*) FILTER (abs(l_extendedprice) >= 1000 AND (o_totalprice = 0 OR abs(l_extendedprice) BETWEEN abs(o_totalprice) * 0.0005::DOUBLE AND abs(o_totalprice) * 1.5::DOUBLE)
  OR l_extendedprice = 0) AS plausible FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey""")
def plausible_amounts(t: Tables):
    joined = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    good = statements.plausible_amount(F.col("l_extendedprice"), F.col("o_totalprice"))
    return joined.groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.count(good).alias("plausible"))


_RULES = {"license": ("license", "rights reserved"), "secret": ("password", "token"), "contact": ("@", "phone")}


@query("""SELECT label, count(*) AS n FROM (SELECT CASE WHEN contains(t, 'license') OR contains(t, 'rightsreserved') THEN 'license' WHEN contains(t, 'password') OR contains(t, 'token') THEN 'secret'
  WHEN contains(t, '@') OR contains(t, 'phone') THEN 'contact' ELSE 'other' END AS label FROM (SELECT regexp_replace(lower(coalesce(text, '')), '[ \\t\\r\\n\\x0B\\f]+', '', 'g') AS t FROM documents)) GROUP BY label""")
def ordered_rules(t: Tables):
    return t.documents.groupBy(statements.first_class(F.lower("text"), _RULES, "other").alias("label")).agg(F.count("*").alias("n"))


@query(r"""WITH l AS (SELECT page_id, unnest(str_split(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gis'), '<[^>]+>', chr(10), 'g'), chr(10))) AS l FROM pages)
SELECT page_id, count(*) AS n_lines FROM l WHERE trim(regexp_replace(replace(l, '&nbsp;', ' '), '[\s\x{00a0}]+', ' ', 'g')) <> '' GROUP BY page_id""")
def page_line_counts(t: Tables):
    lines = t.pages.select("page_id", F.explode(markup.page_lines(F.col("html"))).alias("line"))
    return lines.groupBy("page_id").agg(F.count("*").alias("n_lines"))


_POSTS = """SELECT user_id, event_id, event_type, CAST(ts AS DATE) AS day, event_type = 'error' AS negative, CASE WHEN event_type = 'error' THEN -0.5::DOUBLE ELSE 0.25::DOUBLE END AS polarity,
  least(1, value / 100.0::DOUBLE) AS intensity, floor(value) AS engagement FROM events"""


def posts(t: Tables):
    bad = F.col("event_type") == "error"
    return t.events.select(
        "user_id", "event_id", "event_type", F.to_date("ts").alias("day"), bad.alias("negative"), F.when(bad, -0.5).otherwise(0.25).alias("polarity"),
        F.least(F.lit(1.0), F.col("value") / 100.0).alias("intensity"), F.floor("value").alias("engagement"),
    )


@query(f"""WITH p AS ({_POSTS}), a AS (SELECT *, date_diff('day', day, DATE '2024-02-20') AS age FROM p),
g AS (SELECT user_id, count(*) AS n_posts, count(*) FILTER (negative) AS n_negative, avg(polarity) AS pol, coalesce(sum(intensity * pow(0.5::DOUBLE, age / 180.0::DOUBLE) * (1 + log10(1 + engagement) / 3)) FILTER (negative), 0) AS w,
  count(*) FILTER (age >= 0 AND age < 30) AS recent, greatest(0.15::DOUBLE, count(*) FILTER (age >= 30 AND age < 395) / 365.0::DOUBLE * 30) AS lam FROM a GROUP BY user_id),
q AS (SELECT *, greatest(0, 1 - coalesce(list_sum(list_transform(range(CAST(recent AS BIGINT)), lambda i: exp(-lam + i * ln(lam) - lgamma(i + 1)))), 0)) AS p FROM g)
SELECT user_id, n_posts, n_negative, round(pol, 9) AS avg_polarity, round(w, 4) AS weighted_negative, recent, recent >= 3 AND p < 0.05 AS burst,
  round(least(1, w / 6) * 62 + n_negative / n_posts::DOUBLE * 20 + CASE WHEN recent >= 2 THEN (1 - p) * 100 * least(1, recent / 6.0::DOUBLE) ELSE 0 END * 0.18::DOUBLE, 3) AS score FROM q""")
def entity_sentiment(t: Tables):
    found = rollups.entity_sentiment(posts(t), "user_id", "2024-02-20")
    return found.select("user_id", "n_posts", "n_negative", F.round("avg_polarity", 9).alias("avg_polarity"), F.round("weighted_negative", 4).alias("weighted_negative"), "recent", "burst", F.round("score", 3).alias("score"))


@query(f"WITH p AS ({_POSTS}) SELECT user_id, strftime(day, '%Y-%m') AS month, count(*) AS total, count(*) FILTER (negative) AS negative FROM p GROUP BY ALL")
def entity_months(t: Tables):
    return rollups.month_counts(posts(t), "user_id")


@query(f"""WITH p AS ({_POSTS}) SELECT user_id, event_id, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC, intensity DESC, event_id) AS place FROM p WHERE negative) WHERE place <= 6""")
def latest_negatives(t: Tables):
    return rollups.latest_negatives(posts(t), "user_id", "event_id").select("user_id", "event_id", "place")
