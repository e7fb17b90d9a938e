"""Keywords of posts: words of a vocabulary first, then frequent new words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import occurrences

# What new words are labelled with, and negatives without a topic.
NEW, NEGATIVE = "新詞候選", "負面情緒"
#: Runs of characters that n-grams are taken from.
BREAKS = r"[^一-鿿A-Za-z0-9]+"


def vocabulary(topics: dict[str, tuple[float, list[str]]], negative: dict[str, float], least: int = 2) -> dict[str, tuple[str, float]]:
    """Topic and weight of each word of ``least`` characters or more; the first topic that has a word keeps it."""
    topical = [(w, (topic, severity)) for topic, (severity, words) in topics.items() for w in words]
    general = [(w, (NEGATIVE, weight)) for w, weight in negative.items()]
    # Of equal keys the last one written counts: the first topic, and topics before general words.
    return {w: of for w, of in reversed(topical + general) if len(w) >= least}


def word_counts(posts: DataFrame, text: str, words: dict[str, tuple[str, float]]) -> DataFrame:
    """``word, n`` of the vocabulary's words that occur, over all posts; one pass."""
    t = F.coalesce(F.col(text), F.lit(""))
    made = F.array(*(F.struct(F.lit(w).alias("word"), occurrences(t, w).cast("long").alias("n")) for w in words))
    return posts.select(F.explode(F.filter(made, lambda x: x["n"] > 0)).alias("x")).groupBy("x.word").agg(F.sum("x.n").alias("n"))


def new_words(posts: DataFrame, text: str, words: dict[str, tuple[str, float]], stops: tuple[str, ...] = (), sizes: tuple[int, ...] = (3, 4), least: int = 3) -> DataFrame:
    """``word, n``: n-grams of Chinese characters, letters and digits that occur ``least`` times, have no stop word's character where that is one character, equal no stop word, and neither hold nor lie in a word of the vocabulary.

    Runs of characters are counted before they are cut up.
    """
    runs = posts.select(F.explode(F.split(F.coalesce(F.col(text), F.lit("")), BREAKS)).alias("run")).where(F.length("run") >= min(sizes)).groupBy("run").agg(F.count("*").alias("c"))

    def of(n: int) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length("run") - n + 1), lambda i: F.substring(F.col("run"), i, F.lit(n)))
        return F.when(F.length("run") >= n, cut).otherwise(F.array().cast("array<string>"))

    grams = runs.select("c", F.explode(F.concat(*(of(n) for n in sizes))).alias("word")).groupBy("word").agg(F.sum("c").alias("n")).where(F.col("n") >= least)
    word, bad = F.col("word"), F.lit(False)
    for s in stops:
        bad = bad | (word.contains(s) if len(s) == 1 else word == s)
    for v in words:
        bad = bad | word.contains(v) | F.lit(v).contains(word)
    return grams.where(~bad)


def keywords(posts: DataFrame, text: str, words: dict[str, tuple[str, float]], stops: tuple[str, ...] = (), top: int = 30) -> DataFrame:
    """The ``top`` keywords: ``place, word, n, topic, weight, source``.

    Words of the vocabulary by falling count; where they are fewer than ``top``,
    of the 8 * top most frequent new words those that neither hold nor lie in
    one chosen before.  Equal counts: by code point.  Only these rows, a number
    that the data don't change, come to the driver.
    """
    most = lambda df, k: [(r.word, r.n) for r in df.orderBy(F.desc("n"), "word").limit(k).collect()]
    out = [(w, n, *words[w], "詞庫") for w, n in most(word_counts(posts, text, words), top)]
    known = [r[0] for r in out]
    for w, n in most(new_words(posts, text, words, stops), top * 8) if len(out) < top else []:
        if len(out) < top and not any(w in k or k in w for k in known):
            known.append(w)
            out.append((w, n, NEW, 1.0, "新詞發現"))
    rows = [(i, *r) for i, r in enumerate(out, 1)]
    return posts.sparkSession.createDataFrame(rows, "place int, word string, n long, topic string, weight double, source string")
