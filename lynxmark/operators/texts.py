"""Text analytics: lexicon sentiment, topics, n-grams, name matching, normalisation."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import occurrences


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode NFKC; Spark has no normaliser."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalized(text: Column) -> Column:
    """NFKC text without web addresses; empty for null."""
    return F.trim(F.regexp_replace(F.coalesce(nfkc(text), F.lit("")), r"https?://\S+", " "))


def polarity(text: Column, positive: list[str], negative: dict[str, float]) -> tuple[Column, Column, Column]:
    """Positive and negative weight and (pos - neg) / (pos + neg); a positive word counts once, a negative word each time."""
    pos = sum((F.when(text.contains(w), 1.0).otherwise(0.0) for w in positive), F.lit(0.0))
    neg = sum((occurrences(text, w) * v for w, v in negative.items()), F.lit(0.0))
    return pos, neg, F.coalesce(F.try_divide(pos - neg, pos + neg), F.lit(0.0))


def negated_sentiment(posts: DataFrame, key: str, text: str, negative: dict[str, float], positive: list[str], degrees: dict[str, float], negations: list[str], reach: int = 3) -> DataFrame:
    """Lexicon sentiment with context: each negative word is weighed by the strongest degree word in the ``reach`` characters before it, or turns positive at 0.6 after a negation; so is a positive word's first place, or it turns negative at 0.8.  A degree below 1 weakens nothing.

    One row per key: pos, neg, hits.
    """
    t = F.col(text)

    def before(start: Column) -> Column:
        return t.substr(F.greatest(start - reach, F.lit(1)), F.least(F.lit(reach), start - 1))

    def parts(word: str, weight: float, once: bool):
        pieces = F.split(t, r"\Q" + word + r"\E", 2 if once else -1)
        places = F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda x, i: F.aggregate(F.slice(pieces, 1, i + 1), F.lit(1), lambda a, y: a + F.length(y)) + i * len(word))
        return F.transform(places, lambda s: _weigh(before(s), weight, once))

    def _weigh(ahead: Column, weight: float, is_positive: bool):
        no = F.lit(False)
        for n in negations:
            no = no | ahead.contains(n)
        degree = F.greatest(F.lit(1.0), *(F.when(ahead.contains(d), float(v)).otherwise(1.0) for d, v in degrees.items()), F.lit(1.0))
        flat = F.lit(weight)
        if is_positive:
            return F.struct(F.when(no, 0.0).otherwise(flat * degree).alias("pos"), F.when(no, flat * 0.8).otherwise(0.0).alias("neg"))
        return F.struct(F.when(no, flat * 0.6).otherwise(0.0).alias("pos"), F.when(no, 0.0).otherwise(flat * degree).alias("neg"))

    all_ = F.concat(*(parts(w, v, False) for w, v in negative.items()), *(parts(w, 1.0, True) for w in positive))
    rows = posts.select(key, all_.alias("h"))
    add = lambda f: F.aggregate("h", F.lit(0.0), lambda a, x: a + x[f])
    return rows.select(key, add("pos").alias("pos"), add("neg").alias("neg"), F.size("h").alias("hits"))


def topic(text: Column, topics: dict[str, tuple[float, list[str]]]) -> Column:
    """The topic with most of its words in the text, each counted once, times severity; the first of equals; null without a match."""
    scored = F.array(*(F.struct((sum((text.contains(w).cast("int") for w in words), F.lit(0)) * sev).alias("s"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, (name, (sev, words)) in enumerate(topics.items())))
    best = F.array_max(scored)
    return F.when(best["s"] > 0, best["name"])


def char_ngrams(docs: DataFrame, text: str, sizes: tuple[int, ...] = (3, 4), least: int = 3) -> DataFrame:
    """Character n-grams inside runs of ASCII letters, with their counts; counted before the shuffle."""
    runs = docs.select(F.explode(F.split(F.lower(text), r"[^a-z]+", -1)).alias("w")).where(F.length("w") >= min(sizes))
    words = runs.groupBy("w").agg(F.count("*").alias("c"))  # each word once

    def of(n: int) -> Column:
        places = F.sequence(F.lit(1), F.length("w") - n + 1)
        return F.when(F.length("w") >= n, F.transform(places, lambda i: F.substring(F.col("w"), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    grams = [of(n) for n in sizes]
    each = words.select("c", F.explode(F.concat(*grams)).alias("gram"))
    return each.groupBy("gram").agg(F.sum("c").alias("n")).where(F.col("n") >= least)


def match_names(names: DataFrame, candidates: DataFrame, name: str, cand_id: str, cand: str, gram: int = 2, slack: int = 2) -> DataFrame:
    """Exact match, else mutual substring with lengths at most ``slack`` apart, accepted only when one candidate fits.

    The substring test meets only pairs that share the shorter name's first
    ``gram`` characters at some place: an equi-join on character grams, no
    product of both tables.
    """
    q = names.select(F.col(name).alias("q")).where(F.length("q") >= gram).distinct()
    c = candidates.select(F.col(cand_id).alias("id"), F.col(cand).alias("c")).where(F.length("c") >= gram)
    exact = q.join(c, F.col("q") == F.col("c")).groupBy("q").agg(F.min("id").alias("id"), F.lit("exact").alias("how"))
    rest = q.join(exact.select("q"), "q", "left_anti")
    grams = lambda s: F.transform(F.sequence(F.lit(1), F.length(s) - gram + 1), lambda i: F.substring(s, i, F.lit(gram)))
    head = lambda s: F.substring(s, 1, gram)
    inner = rest.withColumn("g", F.explode(F.array_distinct(grams("q")))).join(c.withColumn("g", head("c")), "g").where(F.col("q").contains(F.col("c")))
    outer = rest.withColumn("g", head("q")).join(c.withColumn("g", F.explode(F.array_distinct(grams("c")))), "g").where(F.col("c").contains(F.col("q")))
    near = inner.select("q", "id", "c").union(outer.select("q", "id", "c")).where(F.abs(F.length("q") - F.length("c")) <= slack).distinct()
    single = near.groupBy("q").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id")).where("n = 1").select("q", "id", F.lit("contains").alias("how"))
    return exact.union(single)


def intensity(polarity: Column, severity: Column, credibility: Column) -> Column:
    """How strongly a negative text warns, 0 to 1: its polarity by the topic's severity and the source's credibility."""
    return F.when(polarity < 0, F.least(F.lit(1.0), -polarity * (0.45 + 0.25 * severity) * credibility)).otherwise(0.0)


def nearest_label(rows: DataFrame, text: str, labels: list[str], most: float = 0.45) -> DataFrame:
    """Adds ``label``, the label that a misread text stands for, and ``ratio``, its edit distance by its length; null where none fits.

    White space is dropped.  A label that is the text or begins it is taken, the
    first of several.  Of the others those are compared whose last character
    occurs in the text; the distance is to the text or, where it is longer, to
    its beginning of the label's length, whichever is less.  The smallest ratio
    up to ``most`` wins, then the first name.  ``labels`` is a short fixed list,
    unrolled into one expression.
    """
    t = F.regexp_replace(F.col(text), r"\s+", "")
    begins = F.coalesce(*(F.when(t.startswith(label), F.lit(label)) for label in labels))

    def ratio(label: str) -> Column:
        whole, front = F.levenshtein(t, F.lit(label)), F.levenshtein(F.substring(t, 1, len(label)), F.lit(label))
        return F.least(whole, F.when(F.length(t) > len(label), front).otherwise(whole)) / float(len(label))

    scored = F.array(*(F.when(t.contains(label[-1]) & (ratio(label) <= most), F.struct(ratio(label).alias("ratio"), F.lit(label).alias("label"))) for label in labels))
    best = F.when(F.length(t) > 0, F.array_min(F.array_compact(scored)))
    return rows.withColumns({"label": F.coalesce(begins, best["label"]), "ratio": F.when(begins.isNotNull(), 0.0).otherwise(best["ratio"])})
