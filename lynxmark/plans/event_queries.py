"""Point-in-time features of events: counts, decay, recency, labels, bursts, lead times."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import poisson_tail
from ..operators.ranking import latest_per_key
from .registry import Tables, query

AS_OF = "2024-01-25"
#: Severity of each event type; others have 1.2.
SEVERITY = {"error": 3.0, "purchase": 2.5, "click": 1.5, "view": 1.0}
_SEV = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in SEVERITY.items()) + " ELSE 1.2::DOUBLE END"


def severity():
    out = F.lit(1.2)
    for k, v in SEVERITY.items():
        out = F.when(F.col("event_type") == k, v).otherwise(out)
    return out


def past(t: Tables, as_of: str = AS_OF):
    """Events up to the day ``as_of``, and those without a date, with their age in days; the filter reaches the scan.

    An event without a date has no age: it is counted among all, in no window.
    """
    return t.events.where(F.col("ts").isNull() | (F.col("ts") < F.date_add(F.lit(as_of).cast("date"), 1))).withColumn("age", F.datediff(F.lit(as_of).cast("date"), F.col("ts").cast("date")))


_PAST = f"(SELECT *, datediff('day', CAST(ts AS DATE), DATE '{AS_OF}') AS age FROM events WHERE ts IS NULL OR ts < DATE '{AS_OF}' + INTERVAL 1 DAY)"


@query(f"""SELECT user_id, count(*) FILTER (age <= 7) AS n_7, count(*) FILTER (age <= 14) AS n_14, count(*) FILTER (age <= 28) AS n_28, round(max(value), 6) AS max_value,
  count(*) FILTER ({_SEV} >= 2.5) AS n_severe, CAST(min(age) AS INT) AS min_age, round(log10(1 + sum(coalesce(value, 0))), 6) AS log_value FROM {_PAST} GROUP BY user_id""")
def event_counts_asof(t: Tables):
    age = F.col("age")
    return past(t).groupBy("user_id").agg(
        *(F.count_if(age <= d).alias(f"n_{d}") for d in (7, 14, 28)),
        F.round(F.max("value"), 6).alias("max_value"),
        F.count_if(severity() >= 2.5).alias("n_severe"),
        F.min(age).alias("min_age"),
        F.round(F.log10(1 + F.sum(F.coalesce("value", F.lit(0.0)))), 6).alias("log_value"),
    )


@query(f"SELECT user_id, round(sum({_SEV} * exp(-age / 10.0::DOUBLE)), 5) AS decayed FROM {_PAST} GROUP BY user_id")
def decay_weighted_events(t: Tables):
    return past(t).groupBy("user_id").agg(F.round(F.sum(severity() * F.exp(-F.col("age") / 10.0)), 5).alias("decayed"))


@query(f"SELECT user_id, CAST(greatest(0, max(c) - 1) AS BIGINT) AS repeats FROM (SELECT user_id, event_type, count(*) AS c FROM {_PAST} GROUP BY ALL) GROUP BY user_id")
def repeat_frequency(t: Tables):
    per = past(t).groupBy("user_id", "event_type").agg(F.count("*").alias("c"))
    return per.groupBy("user_id").agg(F.greatest(F.lit(0), F.max("c") - 1).cast("long").alias("repeats"))


@query(f"SELECT user_id, round(greatest(0, 1 - least(min(age), 28) / 28.0::DOUBLE), 6) AS recency FROM {_PAST} GROUP BY user_id")
def recency_score(t: Tables):
    return past(t).groupBy("user_id").agg(F.round(F.greatest(F.lit(0.0), 1 - F.least(F.min("age"), F.lit(28)) / 28.0), 6).alias("recency"))


@query("""SELECT o_custkey, o_orderkey, o_orderdate, round(o_totalprice, 2) AS o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def latest_row_per_key(t: Tables):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", F.round("o_totalprice", 2).alias("o_totalprice"))
    return latest_per_key(rows, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])


@query("""SELECT c_custkey, count(o_orderkey) AS n_orders, round(coalesce(sum(o_totalprice), 0), 2) AS spent
  FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-07-01') ON o_custkey = c_custkey GROUP BY c_custkey""")
def asof_filtered_join(t: Tables):
    facts = t.orders.where(F.col("o_orderdate") < F.lit("1998-07-01").cast("timestamp")).groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))
    joined = t.customer.join(facts, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n_orders"), F.round(F.coalesce("s", F.lit(0.0)), 2).alias("spent"))


@query(f"""WITH e AS (SELECT DISTINCT user_id FROM events WHERE CAST(ts AS DATE) > DATE '2024-01-15' AND CAST(ts AS DATE) <= DATE '2024-01-15' + INTERVAL 7 DAY AND event_type = 'purchase'),
s AS (SELECT user_id FROM events WHERE CAST(ts AS DATE) > DATE '2024-01-15' AND CAST(ts AS DATE) <= DATE '2024-01-15' + INTERVAL 7 DAY AND {_SEV} >= 2.0 GROUP BY user_id)
SELECT c_custkey, CAST(e.user_id IS NOT NULL AS INT) AS label, CAST(s.user_id IS NOT NULL AS INT) AS severe FROM customer LEFT JOIN e ON e.user_id = c_custkey LEFT JOIN s ON s.user_id = c_custkey""")
def label_window(t: Tables):
    start = F.lit("2024-01-15").cast("date")
    window = t.events.where((F.col("ts") >= F.date_add(start, 1).cast("timestamp")) & (F.col("ts") < F.date_add(start, 8).cast("timestamp")))
    flags = window.groupBy("user_id").agg(F.max((F.col("event_type") == "purchase").cast("int")).alias("label"), F.max((severity() >= 2.0).cast("int")).alias("severe"))
    joined = t.customer.join(flags, F.col("c_custkey") == F.col("user_id"), "left")
    return joined.select("c_custkey", F.coalesce("label", F.lit(0)).alias("label"), F.coalesce("severe", F.lit(0)).alias("severe"))


@query("""
WITH f AS (SELECT user_id, CAST(min(ts) AS DATE) AS first_day FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-10' GROUP BY user_id),
d AS (SELECT datediff('day', DATE '2024-01-10', first_day) AS d FROM f)
SELECT count(*) AS n, round(avg(d), 6) AS mean_days, round(median(d), 6) AS median_days, CAST(min(d) AS INT) AS min_days, CAST(max(d) AS INT) AS max_days FROM d""")
def lead_time(t: Tables):
    start = F.lit("2024-01-10")
    first = t.events.where((F.col("event_type") == "purchase") & (F.col("ts") >= start.cast("timestamp"))).groupBy("user_id").agg(F.min("ts").alias("ts"))
    days = first.select(F.datediff(F.col("ts").cast("date"), start.cast("date")).alias("d"))
    return days.agg(
        F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("mean_days"), F.round(F.percentile("d", 0.5), 6).alias("median_days"), F.min("d").alias("min_days"), F.max("d").alias("max_days")
    )


@query(f"""
WITH c AS (SELECT user_id, count(*) FILTER (age < 3) AS recent, count(*) FILTER (age >= 3 AND age < 23) AS base FROM {_PAST} GROUP BY user_id),
l AS (SELECT *, greatest(0.15::DOUBLE, base / 20.0::DOUBLE * 3) AS lam FROM c),
p AS (SELECT user_id, recent, base, lam, greatest(0, 1 - coalesce((SELECT sum(exp(-lam + i * ln(lam) - lgamma(i + 1))) FROM range(0, recent) r(i)), 0)) AS p FROM l)
SELECT user_id, recent, base, round(lam, 6) AS rate, round(p, 6) AS p_value, recent >= 3 AND p < 0.05 AS burst,
  round(CASE WHEN recent >= 2 THEN (1 - p) * 100 * least(1, recent / 6.0::DOUBLE) ELSE 0 END, 4) AS score FROM p""")
def poisson_burst(t: Tables):
    age, recent = F.col("age"), F.col("recent")
    per = past(t).groupBy("user_id").agg(F.count_if(age < 3).alias("recent"), F.count_if((age >= 3) & (age < 23)).alias("base"))
    per = per.withColumn("rate", F.greatest(F.lit(0.15), F.col("base") / 20.0 * 3)).withColumn("p", poisson_tail(recent, F.col("rate")))
    score = F.when(recent >= 2, (1 - F.col("p")) * 100 * F.least(F.lit(1.0), recent / 6.0)).otherwise(0.0)
    return per.select("user_id", "recent", "base", F.round("rate", 6).alias("rate"), F.round("p", 6).alias("p_value"), ((recent >= 3) & (F.col("p") < 0.05)).alias("burst"), F.round(score, 4).alias("score"))


@query("""
SELECT 'orders' AS kind, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS flagged FROM orders GROUP BY ALL
UNION ALL SELECT 'events', strftime(ts, '%Y-%m'), count(*), count(*) FILTER (event_type = 'error') FROM events GROUP BY ALL""")
def monthly_timeline(t: Tables):
    orders = t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("flagged"))
    events = t.events.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "error").alias("flagged"))
    return orders.select(F.lit("orders").alias("kind"), "*").unionByName(events.select(F.lit("events").alias("kind"), "*"))


@query("SELECT event_type, count(*) AS n, count(k) AS with_k, CAST(sum(k) AS BIGINT) AS sum_k FROM (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type")
def json_props(t: Tables):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.count(k).alias("with_k"), F.sum(k).alias("sum_k"))


@query("""
WITH g AS (SELECT user_id, CAST(ts AS DATE) AS d FROM events GROUP BY ALL),
i AS (SELECT *, d - CAST(row_number() OVER (PARTITION BY user_id ORDER BY d) AS INT) AS island FROM g)
SELECT user_id, min(d) AS first_day, CAST(count(*) AS BIGINT) AS days FROM i GROUP BY user_id, island QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY min(d)) = 1""")
def first_island(t: Tables):
    days = t.events.select("user_id", F.col("ts").cast("date").alias("d")).distinct()
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("d"))
    islands = days.withColumn("island", F.date_sub("d", rn)).groupBy("user_id", "island").agg(F.min("d").alias("first_day"), F.count("*").alias("days"))
    return islands.groupBy("user_id").agg(F.min(F.struct("first_day", "days")).alias("x")).select("user_id", "x.*")
