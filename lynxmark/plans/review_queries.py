"""Validation tables, keywords, peers, evidence, reviews and unit rows on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, statements
from ..operators import evidence, keywords, validation
from ..operators.scoring import DIMENSIONS
from .ranking_queries import _RANKED, labelled
from .registry import Tables, query
from .screening_queries import _DIM, _FEATURES, _RESCORED, features, rescored
from .screening_queries import dimension_scores as dimensions
from .text_queries import NEGATIVE, TOPICS, _times


def _long(part: str, at: str, table: str, values: dict[str, str], where: str = "") -> str:
    """SQL of a measure's rows: one for each value."""
    return " UNION ALL ".join(f"SELECT '{part}' AS part, CAST({at} AS BIGINT) AS at, '{n}' AS name, CAST({v} AS DOUBLE) AS value FROM {table} {where}" for n, v in values.items())


_PLACES = f"""WITH {_RANKED}, e AS (SELECT rank, total AS n, CAST(tp AS BIGINT) AS tp, CAST(p AS BIGINT) AS p, y FROM c), w AS (SELECT count(*) AS n, sum(y) AS p FROM l),
u AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS r FROM l), z AS (SELECT sum(r) FILTER (y = 1) AS r, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q FROM u),
b AS (SELECT (rank - 1) // (n // 10) + 1 AS bucket, avg(y) AS rate, max(p / n::DOUBLE) AS base FROM e WHERE (rank - 1) // (n // 10) < 10 GROUP BY bucket)"""


@query(_PLACES + " " + " UNION ALL ".join([
    _long("whole", "0", "w", {"n": "n", "positives": "p", "base_rate": "round(p / n::DOUBLE, 4)"}),
    _long("whole", "0", "z", {"auc": "round((r - p * (p + 1) / 2.0::DOUBLE) / (p * q), 4)"}),
    _long("curve", "rank", "e", {"fpr": "round((rank - tp) / (n - p)::DOUBLE, 4)", "tpr": "round(tp / p::DOUBLE, 4)", "precision": "round(tp / rank::DOUBLE, 4)"}, "WHERE rank % greatest(1, n // 60) = 0 OR rank = n"),
    _long("lift", "bucket", "b", {"rate": "round(rate, 4)", "lift": "round(rate / base, 2)"}),
    _long("at_k", "rank", "e", {"precision": "round(tp / rank::DOUBLE, 4)", "recall": "round(tp / p::DOUBLE, 4)", "lift": "round(tp / rank::DOUBLE / round(p / n::DOUBLE, 4), 2)"}, "WHERE rank IN (20, 50, 100)"),
    _long("confusion", "rank", "e", {"tp": "tp", "fp": "rank - tp", "fn": "p - tp", "tn": "n - rank - (p - tp)", "precision": "round(tp / rank::DOUBLE, 4)", "recall": "round(tp / p::DOUBLE, 4)", "f1": "round(2 * tp / (p + rank)::DOUBLE, 4)"}, "WHERE rank = n // 5"),
]))
def validation_bundle(t: Tables):
    return validation.bundle(labelled(t), "s", "y", "doc_id")


@query(f"""WITH {_FEATURES}, {_DIM}, x AS (SELECT CAST(c_custkey % 3 = 0 AS INT) AS y, unnest(['compliance', 'financial', 'evaluation', 'sentiment']) AS dimension, unnest([compliance, financial, evaluation, sentiment]) AS s FROM dim),
r AS (SELECT dimension, y, rank() OVER (PARTITION BY dimension ORDER BY s) + (count(*) OVER (PARTITION BY dimension, s) - 1) / 2.0::DOUBLE AS r FROM x),
z AS (SELECT dimension, sum(r) FILTER (y = 1) AS r, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM r GROUP BY dimension) SELECT dimension, round((r - p * (p + 1) / 2.0::DOUBLE) / (p * n), 4) AS auc FROM z""")
def dimension_auc(t: Tables):
    return validation.dimension_auc(dimensions(t).withColumn("y", (F.col("c_custkey") % 3 == 0).cast("int")), tuple(DIMENSIONS), "y")


@query(f"""{_RESCORED}, ev AS (SELECT o_custkey, min(o_orderdate) AS d FROM orders WHERE o_custkey % 2 = 0 AND o_orderdate > DATE '1995-06-30' AND o_orderdate <= DATE '1995-06-30' + 365 GROUP BY o_custkey),
f AS (SELECT datediff('day', DATE '1995-06-30', CAST(d AS DATE)) AS d FROM bd LEFT JOIN ev ON o_custkey = c_custkey WHERE rank <= greatest(1, total // 5)), w AS (SELECT count(*) AS n, count(*) FILTER (c_custkey % 2 = 0) AS p FROM bd)
SELECT count(*) AS flagged, round(count(*) * 100 / max(n)::DOUBLE, 1) AS flagged_pct, count(d) AS hit, max(p) AS total_positive, round(count(d) / max(p)::DOUBLE, 4) AS recall, coalesce(round(avg(d), 1), 0) AS mean_days, coalesce(round(median(d), 1), 0) AS median_days, CAST(coalesce(min(d), 0) AS INT) AS min_days, CAST(coalesce(max(d), 0) AS INT) AS max_days FROM f, w""")
def warning_coverage(t: Tables):
    warned = rescored(t).withColumn("y", (F.col("c_custkey") % 2 == 0).cast("int"))
    events = t.orders.where(F.col("o_custkey") % 2 == 0).select(F.col("o_custkey").alias("c_custkey"), "o_orderdate")
    return validation.lead_and_coverage(warned, events, "c_custkey", "y", "o_orderdate", "1995-06-30")


@query()
def calibrated_weights(t: Tables):
    rows = dimensions(t).withColumn("y", (F.col("compliance") + F.col("c_custkey") % 40 > 60).cast("int"))
    found = validation.calibrated_weights(rows, "y")
    return t.spark.createDataFrame(list(found.items()), "dimension string, weight double")


WORDS = keywords.vocabulary(TOPICS, NEGATIVE)
# Words and letters that no new word has.
STOPS = ("q", "x", "j", "the", "and")
_WORD_COUNTS = " UNION ALL ".join(f"SELECT '{w}' AS word, CAST(sum({_times(w)}) AS BIGINT) AS n, '{topic}' AS topic, {weight}::DOUBLE AS weight FROM d" for w, (topic, weight) in WORDS.items())
_HOLDS = " OR ".join([f"contains(g, '{s}')" if len(s) == 1 else f"g = '{s}'" for s in STOPS] + [f"contains(g, '{w}') OR contains('{w}', g)" for w in WORDS])
_KEYWORDS = rf"""WITH RECURSIVE d AS (SELECT lower(text) AS t FROM documents), v AS (SELECT * FROM ({_WORD_COUNTS}) WHERE n > 0),
r AS (SELECT unnest(regexp_split_to_array(t, '[^一-鿿A-Za-z0-9]+')) AS run FROM d), u AS (SELECT run, count(*) AS c FROM r WHERE length(run) >= 3 GROUP BY run),
p AS (SELECT run, c, k, unnest(range(1, length(run) - k + 2)) AS i FROM u, (VALUES (3), (4)) s(k) WHERE length(run) >= k), a AS (SELECT substr(run, CAST(i AS INT), k) AS g, CAST(sum(c) AS BIGINT) AS n FROM p GROUP BY g HAVING sum(c) >= 3),
nw AS (SELECT g AS word, n FROM a WHERE NOT ({_HOLDS}))"""


@query(f"{_KEYWORDS} SELECT word, n FROM nw")
def new_word_candidates(t: Tables):
    return keywords.new_words(t.documents.select(F.lower("text").alias("t")), "t", WORDS, STOPS)


@query(f"""{_KEYWORDS}, b AS (SELECT word, n, row_number() OVER (ORDER BY n DESC, word) AS i FROM nw QUALIFY i <= 240), s AS (SELECT list(word ORDER BY n DESC, word) AS known FROM v),
g(i, known) AS (SELECT CAST(0 AS BIGINT), known FROM s UNION ALL SELECT b.i, CASE WHEN len(known) < 30 AND len(list_filter(known, lambda k: contains(k, b.word) OR contains(b.word, k))) = 0 THEN list_append(known, b.word) ELSE known END FROM g JOIN b ON b.i = g.i + 1),
z AS (SELECT known FROM g ORDER BY i DESC LIMIT 1), o AS (SELECT unnest(known) AS word, unnest(range(1, len(known) + 1)) AS place FROM z)
SELECT CAST(place AS INT) AS place, o.word, coalesce(v.n, nw.n) AS n, coalesce(topic, '新詞候選') AS topic, coalesce(weight, 1) AS weight, CASE WHEN topic IS NULL THEN '新詞發現' ELSE '詞庫' END AS source FROM o LEFT JOIN v USING (word) LEFT JOIN nw USING (word)""")
def post_keywords(t: Tables):
    return keywords.keywords(t.documents.select(F.lower("text").alias("t")), "t", WORDS, STOPS)


@query("""WITH c AS (SELECT c_custkey, c_nationkey || '|' || (c_custkey % 9) AS g, c_mktsegment AS k, c_acctbal AS o FROM customer), n AS (SELECT *, count(*) OVER (PARTITION BY g) - 1 AS ng, count(*) OVER (PARTITION BY k) - 1 AS nk FROM c),
rg AS (SELECT g, c_custkey AS peer, row_number() OVER (PARTITION BY g ORDER BY o DESC, c_custkey) AS r FROM c QUALIFY r <= 9), rk AS (SELECT k, c_custkey AS peer, row_number() OVER (PARTITION BY k ORDER BY o DESC, c_custkey) AS r FROM c QUALIFY r <= 9),
x AS (SELECT c_custkey, n.g AS peer_group, ng AS peer_count, peer, r FROM n JOIN rg ON rg.g = n.g AND peer <> c_custkey WHERE ng > 0 UNION ALL SELECT c_custkey, n.k, nk, peer, r FROM n JOIN rk ON rk.k = n.k AND peer <> c_custkey WHERE ng = 0),
y AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY r) AS place FROM x) SELECT c_custkey, peer_group, peer_count, CAST(place AS INT) AS place, peer FROM y WHERE place <= 8""")
def peer_lists(t: Tables):
    rows = t.customer.select("c_custkey", F.concat_ws("|", F.col("c_nationkey").cast("string"), (F.col("c_custkey") % 9).cast("string")).alias("g"), F.col("c_mktsegment").alias("k"), F.col("c_acctbal").alias("o"))
    return evidence.peers(rows, "c_custkey", "g", "k", "o")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders), h AS (SELECT o_custkey, string_agg(o_orderkey, ',' ORDER BY r) AS recent FROM o WHERE r <= 3 GROUP BY o_custkey),
f AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS spent, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT c_custkey, f.o_custkey IS NOT NULL AS available, round(spent, 1) AS spent, n, recent FROM customer LEFT JOIN f ON f.o_custkey = c_custkey LEFT JOIN h ON h.o_custkey = c_custkey""")
def evidence_views(t: Tables):
    orders = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    money = orders.groupBy("c_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spent"), F.count("*").alias("n"))
    history = evidence.gathered(orders, "c_custkey", [F.desc("o_orderdate"), F.col("o_orderkey")], ["o_orderkey", "o_orderdate"], 3, "orders")
    made = evidence.evidence(t.customer, "c_custkey", {"finances": money, "history": history})
    recent = F.array_join(F.transform("history.orders", lambda x: x["o_orderkey"].cast("string")), ",")
    return made.select("c_custkey", F.col("finances").isNotNull().alias("available"), F.round("finances.spent", 1).alias("spent"), "finances.n", recent.alias("recent"))


@query(f"""{_RESCORED}, t AS (SELECT * FROM bd ORDER BY score DESC, c_custkey LIMIT 30), w AS (SELECT c_custkey, [CASE WHEN compliance > 60 THEN 'compliance' END, CASE WHEN financial > 50 THEN 'finances' END, CASE WHEN sentiment > 50 THEN 'opinion' END] AS f, compliance > 60 AS a, financial > 50 AS b, sentiment > 50 AS c FROM t),
s AS (SELECT *, CAST(least(100, 40 * CAST(a AS INT) + 22 * CAST(b AS INT) + 10 * CAST(c AS INT)) AS INT) AS review_score FROM w)
SELECT c_custkey, review_score, CASE WHEN a OR review_score >= 70 THEN 'critical' WHEN review_score >= 45 THEN 'high' WHEN review_score >= 22 THEN 'medium' WHEN review_score > 0 THEN 'low' ELSE 'none' END AS review_level, array_to_string(list_filter(f, lambda x: x IS NOT NULL), ';') AS findings FROM s""")
def batch_reviews(t: Tables):
    rows = rescored(t)
    rules = [(F.col("compliance") > 60, "critical", F.lit("compliance")), (F.col("financial") > 50, "high", F.lit("finances")), (F.col("sentiment") > 50, "medium", F.lit("opinion"))]
    made = evidence.review(rows, "c_custkey", rules, evidence.targets(rows, "c_custkey", "score"))
    return made.withColumn("findings", F.array_join("findings", ";"))


@query("SELECT 'c' AS dimension FROM orders GROUP BY ALL HAVING count(*) > 0")
def unscored_dimensions(t: Tables):
    rows = t.orders.select(F.col("o_totalprice").alias("a"), F.when(F.col("o_orderkey") % 2 == 0, 1.0).alias("b"), F.when(F.col("o_orderkey") % 2 == 0, 0.0).alias("c"))
    return evidence.unscored(rows, ("a", "b", "c"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'school' ELSE 'kindergarten' END AS kind, CASE WHEN s_suppkey % 3 = 0 THEN '新北市板橋區板橋國民小學' ELSE '新北市立三芝幼兒園' END AS name,
CAST(1000000 + s_suppkey * 7 AS DOUBLE) AS revenue, CAST(CASE WHEN s_suppkey % 2 = 0 THEN -1 ELSE 1 END * (900000 + s_suppkey) AS DOUBLE) AS expense FROM supplier WHERE s_suppkey % 5 <> 0""")
def unit_rows(t: Tables):
    k = F.col("s_suppkey")
    code = F.concat(F.when(k % 3 == 0, "130").otherwise("136"), F.lpad((k % 100).cast("string"), 2, "0"))
    name = F.when(k % 3 == 0, "新北市板橋區 板橋國民小學").otherwise("新北市立 三芝幼兒園")
    expense = F.when(k % 2 == 0, F.concat(F.lit("("), F.format_number(900000 + k, 0), F.lit(")"))).otherwise(F.format_number(900000 + k, 0))
    line = F.concat_ws(" ", code, name, F.replace(F.format_number(1000000 + k * 7, 0), F.lit(","), F.lit("﹒")), F.when(k % 5 != 0, expense))
    return t.supplier.select("s_suppkey", statements.unit_row(line).alias("u")).where("u IS NOT NULL").select("s_suppkey", "u.*")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '"新北市私立甲' || s_nationkey || '幼兒園"|"甲' || s_nationkey || '幼兒園" ' || CASE WHEN s_suppkey % 3 = 0 THEN '板橋區' ELSE '新北' END ELSE '"新北市立甲幼兒園"|"立甲幼兒園" ' || CASE WHEN s_suppkey % 3 = 0 THEN '板橋區' ELSE '新北' END END AS queries FROM supplier""")
def search_queries(t: Tables):
    name = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("新北市私立甲"), F.col("s_nationkey").cast("string"), F.lit("幼兒園"))).otherwise("新北市立甲幼兒園")
    place = F.when(F.col("s_suppkey") % 3 == 0, "板橋區").otherwise("")
    return t.supplier.select("s_suppkey", F.array_join(names.search_queries(name, place), "|").alias("queries"))
