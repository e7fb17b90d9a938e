"""License scans by diagonal voting.

All rolling word 2-gram hashes of a text meet the templates' gram positions in a
Spark join; a hit votes for its diagonal, the text's position minus the
template's.  Votes are aggregated by diagonal, neighbouring diagonals of a long
template are merged (an inserted or lost word moves the diagonal by one), and a
span counts when enough of the template's grams stand on it.  A hit carries its
two words, which the join compares beside the hash, so no collision can vote.

A phrase of the base list must stand whole on one diagonal; each such diagonal
is one place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import stage

#: What stands between words: ASCII but digits and letters.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()


# License phrases and their labels; the base ones first.
TEMPLATES = (
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc-by-sa", "cc by sa"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: Part of a template's grams that a span must hold, and how far neighbouring diagonals may lie apart.
COVER, NEIGHBOUR = 0.8, 2
MOST_WORDS = 65  # the grams that a span holds are bits of a long
LONG = 6  # words from which a template tolerates gaps


def words_of(text: Column) -> Column:
    """Lower-cased words; ``lower`` also folds letters beyond ASCII, which neither splits nor joins words nor makes a template's word."""
    return F.array_remove(F.split(F.lower(text), GAPS, -1), "")


def _grams(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    if any(len(x.words) < 2 or len(x.words) > MOST_WORDS for x in templates):
        raise ValueError(f"a template has 2 to {MOST_WORDS} words")
    rows = [(t, p, a, b) for t, x in enumerate(templates) for p, (a, b) in enumerate(zip(x.words, x.words[1:]))]
    made = spark.createDataFrame(rows, "template int, at int, first string, second string")
    return made.withColumn("hash", F.xxhash64("first", "second"))


def license_spans(hits: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``id, h, template, start, cover``: verified spans of ``hits`` (id, h, hits: array of (at, hash, first, second))."""
    spark = hits.sparkSession
    grams = _grams(spark, templates)  # one row for each gram of the fixed templates
    facts = spark.createDataFrame([(t, len(x.words) - 1, len(x.words) >= LONG, x.base) for t, x in enumerate(templates)], "template int, grams int, long boolean, base boolean")
    flat = hits.select("id", "h", F.explode("hits").alias("x")).select("id", "h", F.col("x.at").alias("place"), F.col("x.hash").alias("hash"), F.col("x.first").alias("first"), F.col("x.second").alias("second"))
    votes = flat.join(F.broadcast(grams), ["hash", "first", "second"]).select("id", "h", "template", (F.col("place") - F.col("at")).alias("diagonal"), "at")
    lines = votes.groupBy("id", "h", "template", "diagonal").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("held"), F.min("at").alias("low"))
    lines = lines.join(F.broadcast(facts), "template")
    order = Window.partitionBy("id", "h", "template").orderBy("diagonal")
    far = F.col("diagonal") - F.lag("diagonal").over(order) > F.when(F.col("long"), NEIGHBOUR).otherwise(0)
    runs = lines.withColumn("run", F.sum(F.coalesce(far.cast("int"), F.lit(0))).over(order))
    merged = runs.groupBy("id", "h", "template", "run", "grams", "long").agg(F.bit_or("held").alias("held"), F.min(F.col("diagonal") + F.col("low")).alias("start"))
    cover = F.bit_count("held") / F.col("grams")
    return merged.withColumn("cover", cover).where(F.when(F.col("long"), F.col("cover") >= COVER).otherwise(F.bit_count("held") == F.col("grams"))).select("id", "h", "template", "start", "cover")


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with its words, base places, labels and score.

    ``n_base`` counts the places of base phrases, ``first_word`` and
    ``last_word`` are their smallest and largest start (else null),
    ``base_labels`` and ``labels`` are sorted and comma-joined, ``score`` is the
    best cover.  Null text counts as empty; repeated rows get equal results; an
    empty table gives an empty result.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    spark = docs.sparkSession
    hashes = [r.hash for r in _grams(spark, templates).select("hash").distinct().collect()]  # of the fixed templates
    scanned = F.transform(
        F.array(words_of(body)),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n"),
            F.transform(
                F.filter(
                    F.when(F.size(w) > 1, F.sequence(F.lit(0), F.size(w) - 2)).otherwise(F.array().cast("array<int>")),
                    lambda i: F.xxhash64(w[i], w[i + 1]).isin(hashes),
                ),
                lambda i: F.struct(i.alias("at"), F.xxhash64(w[i], w[i + 1]).alias("hash"), w[i].alias("first"), w[i + 1].alias("second")),
            ).alias("hits"),
        ),
    )[0]
    rows = stage(
        docs.select(F.col(key).alias("id"), F.xxhash64(body).alias("h"), scanned.alias("s")).select("id", "h", F.col("s.n").alias("n_words"), F.col("s.hits").alias("hits")), "license-hits"
    )
    spans = license_spans(rows.where(F.size("hits") > 0).select("id", "h", "hits"), templates)
    names = spark.createDataFrame([(t, x.label, x.base) for t, x in enumerate(templates)], "template int, label string, base boolean")
    base = F.col("base")
    per = spans.join(F.broadcast(names), "template").groupBy(F.col("id").alias("of"), F.col("h").alias("g")).agg(
        F.count_if(base).alias("places"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_found"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("found"),
        F.max("cover").alias("best"),
    )
    return rows.join(per, F.col("id").eqNullSafe(F.col("of")) & (F.col("h") == F.col("g")), "left").select(
        F.col("id").alias(key),
        "n_words",
        F.coalesce("places", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_found", F.lit("")).alias("base_labels"),
        F.coalesce("found", F.lit("")).alias("labels"),
        F.coalesce("best", F.lit(0.0)).alias("score"),
    )


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
