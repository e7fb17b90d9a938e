"""Text queries: lexicons, topics, n-grams, HTML, deduplication, names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import occurrences, stable_id, strip_html
from ..operators import texts
from ..operators.ranking import keep_first
from .registry import Tables, query

# Short Latin lexicons for the test corpus.
NEGATIVE = {"error": 1.0, "never": 0.8, "not": 0.5, "wh": 0.2}
POSITIVE = ["the", "good", "ing"]
TOPICS = {"time": (1.5, ["tion", "ment"]), "place": (2.0, ["here", "ble"]), "person": (1.0, ["her", "ou"])}


def _times(w: str, col: str = "t") -> str:
    return f"CAST((length({col}) - length(replace({col}, '{w}', ''))) / {len(w)} AS BIGINT)"


_NEG = " + ".join(f"{_times(w)} * {v}::DOUBLE" for w, v in NEGATIVE.items())
_POS = " + ".join(f"CAST(contains(t, '{w}') AS DOUBLE)" for w in POSITIVE)


@query(f"""WITH d AS (SELECT doc_id, lower(text) AS t FROM documents), s AS (SELECT doc_id, {_POS} AS pos, {_NEG} AS neg FROM d)
SELECT doc_id, round(pos, 4) AS pos, round(neg, 4) AS neg, round(CASE WHEN pos + neg = 0 THEN 0 ELSE (pos - neg) / (pos + neg) END, 6) AS polarity FROM s""")
def lexicon_counts(t: Tables):
    pos, neg, pol = texts.polarity(F.lower("text"), POSITIVE, NEGATIVE)
    return t.documents.select("doc_id", F.round(pos, 4).alias("pos"), F.round(neg, 4).alias("neg"), F.round(pol, 6).alias("polarity"))


@query("""WITH w AS (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM documents), u AS (SELECT w, count(*) AS c FROM w GROUP BY w),
g AS (SELECT c, n, w, unnest(range(1, length(w) - n + 2)) AS i FROM u, (VALUES (3), (4)) k(n) WHERE length(w) >= n)
SELECT substr(w, CAST(i AS INT), n) AS gram, CAST(sum(c) AS BIGINT) AS n FROM g GROUP BY gram HAVING sum(c) >= 3""")
def ngram_candidates(t: Tables):
    return texts.char_ngrams(t.documents, "text")


_TOPIC = ", ".join(f"(({' + '.join(f"CAST(contains(t, '{w}') AS INT)" for w in words)}) * {sev}::DOUBLE) AS {name}" for name, (sev, words) in TOPICS.items())


@query(f"""WITH c AS (SELECT conv_id, turn, lower(text) AS t FROM conversations), s AS (SELECT conv_id, turn, {_TOPIC} FROM c)
SELECT conv_id, turn, CASE WHEN greatest(time, place, person) <= 0 THEN NULL WHEN time = greatest(time, place, person) THEN 'time' WHEN place = greatest(time, place, person) THEN 'place' ELSE 'person' END AS topic FROM s""")
def topic_argmax(t: Tables):
    return t.conversations.select("conv_id", "turn", texts.topic(F.lower("text"), TOPICS).alias("topic"))


_TEXT = r"regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gis'), '<[^>]*>', ' ', 'g')"
for _e, _c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _TEXT = f"replace({_TEXT}, '{_e}', '{_c}')"


@query(rf"""SELECT page_id, length(body) AS n_chars, md5(body) AS digest FROM (SELECT page_id, trim(regexp_replace({_TEXT}, '[ \t\r\n]+', ' ', 'g')) AS body FROM pages)""")
def html_strip(t: Tables):
    body = strip_html(F.col("html"))
    return t.pages.select("page_id", F.length(body).cast("long").alias("n_chars"), F.md5(body).alias("digest"))


@query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages)
SELECT page_id, count(*) AS links, count(DISTINCT link) AS distinct_links, min(link) AS first_link FROM l GROUP BY page_id""")
def html_link_extract(t: Tables):
    links = t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("link"))
    return links.groupBy("page_id").agg(F.count("*").alias("links"), F.count_distinct("link").alias("distinct_links"), F.min("link").alias("first_link"))


@query("""SELECT doc_id, source, md5(text) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def dedupe_keep_first(t: Tables):
    rows = t.documents.select("doc_id", "source", F.md5("text").alias("digest"))
    return keep_first(rows, [F.col("digest")], "doc_id")


@query("""WITH q AS (SELECT DISTINCT split_part(p_name, ' ', 1) || split_part(p_name, ' ', 2) AS q FROM part UNION SELECT lower(n_name) || 'xy' FROM nation UNION SELECT lower(n_name) FROM nation),
c AS (SELECT n_nationkey AS id, lower(n_name) AS c FROM nation WHERE length(n_name) >= 2), x AS (SELECT q, id, c FROM q JOIN c ON q = c),
e AS (SELECT q, min(id) AS id, 'exact' AS how FROM x GROUP BY q),
n AS (SELECT q, min(id) AS id, count(DISTINCT id) AS n FROM q JOIN c ON (contains(q, c) OR contains(c, q)) AND abs(length(q) - length(c)) <= 2 WHERE length(q) >= 2 AND q NOT IN (SELECT q FROM e) GROUP BY q)
SELECT q, id, how FROM e UNION ALL SELECT q, id, 'contains' FROM n WHERE n = 1""")
def substring_match_unique(t: Tables):
    word = lambda k: F.coalesce(F.try_element_at(F.split("p_name", " "), F.lit(k)), F.lit(""))
    names = t.part.select(F.concat(word(1), word(2)).alias("q"))
    nations = t.nation.select("n_nationkey", F.lower("n_name").alias("c"))
    names = names.union(nations.select(F.concat("c", F.lit("xy")))).union(nations.select("c"))
    return texts.match_names(names, nations, "q", "n_nationkey", "c")


@query("SELECT s_suppkey, 'K' || upper(substr(sha1(n_name || '|' || trim(regexp_replace(s_name, '[#0 ]+', ' ', 'g'))), 1, 10)) AS key FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def canonical_key(t: Tables):
    joined = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select("s_suppkey", stable_id(F.col("n_name"), F.trim(F.regexp_replace("s_name", "[#0 ]+", " "))).alias("key"))


_LABELS = ("ECONOMYBRASS", "LARGESTEEL", "PROMOCOPPER", "SMALLTIN", "STANDARDNICKEL", "STANDARD", "PROMOTION")


@query(rf"""WITH p AS (SELECT DISTINCT p_type, regexp_replace(p_type, '\s+', '', 'g') AS x FROM part), v AS (SELECT * FROM (VALUES {", ".join(f"({k}, '{x}')" for k, x in enumerate(_LABELS))}) v(k, l)),
f AS (SELECT p_type, arg_min(l, k) AS l FROM p, v WHERE starts_with(x, l) GROUP BY p_type),
r AS (SELECT p_type, l, least(levenshtein(x, l), CASE WHEN length(x) > length(l) THEN levenshtein(substr(x, 1, length(l)), l) ELSE levenshtein(x, l) END) / length(l)::DOUBLE AS r FROM p, v WHERE contains(x, right(l, 1)) AND x <> ''),
b AS (SELECT p_type, l, r FROM r WHERE r <= 0.45 QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY r, l) = 1)
SELECT p.p_type, coalesce(f.l, b.l) AS label, round(CASE WHEN f.l IS NOT NULL THEN 0 ELSE b.r END, 6) AS ratio FROM p LEFT JOIN f USING (p_type) LEFT JOIN b USING (p_type)""")
def edit_distance_match(t: Tables):
    return texts.nearest_label(t.part.select("p_type").distinct(), "p_type", list(_LABELS)).withColumn("ratio", F.round("ratio", 6))


@query("SELECT role, count(*) AS turns, CAST(sum(" + _times("the", "lower(text)") + ") AS BIGINT) AS hits, count(*) FILTER (contains(lower(text), 'the')) AS with_hit FROM conversations GROUP BY role")
def source_word_counts(t: Tables):
    n = occurrences(F.lower("text"), "the")
    return t.conversations.groupBy("role").agg(F.count("*").alias("turns"), F.sum(n).alias("hits"), F.count_if(n > 0).alias("with_hit"))


@query("""WITH d AS (SELECT conv_id || ':' || turn AS key, lower(text) AS t FROM conversations),
h AS (SELECT key, substr(t, CAST(greatest(1, i - 3) AS INT), CAST(least(3, i - 1) AS INT)) AS ahead, FALSE AS good FROM (SELECT key, t, unnest(range(1, length(t))) AS i FROM d) WHERE substr(t, CAST(i AS INT), 2) = 'er'
  UNION ALL SELECT key, substr(t, CAST(greatest(1, instr(t, 'ing') - 3) AS INT), CAST(least(3, instr(t, 'ing') - 1) AS INT)), TRUE FROM d WHERE contains(t, 'ing')),
w AS (SELECT key, good, contains(ahead, 'in') AS turned, CASE WHEN contains(ahead, 'wh') THEN 1.5::DOUBLE ELSE 1 END AS much FROM h)
SELECT d.key, round(coalesce(sum(CASE WHEN good AND NOT turned THEN much WHEN NOT good AND turned THEN 0.6::DOUBLE ELSE 0 END), 0), 6) AS pos,
  round(coalesce(sum(CASE WHEN good AND turned THEN 0.8::DOUBLE WHEN NOT good AND NOT turned THEN much ELSE 0 END), 0), 6) AS neg, CAST(count(good) AS INT) AS hits FROM d LEFT JOIN w USING (key) GROUP BY d.key""")
def sentiment_context(t: Tables):
    """Negation and degree in the characters before a word."""
    rows = t.conversations.withColumn("t", F.lower("text")).withColumn("key", F.concat_ws(":", "conv_id", "turn"))
    made = texts.negated_sentiment(rows, "key", "t", {"er": 1.0}, ["ing"], {"wh": 1.5}, ["in"])
    return made.select("key", F.round("pos", 6).alias("pos"), F.round("neg", 6).alias("neg"), "hits")
