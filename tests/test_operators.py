"""Operators against plain loops, and the edges of their inputs."""

import math

import numpy as np
from pyspark.sql import functions as F

from lynxmark.functions import columns as c
from lynxmark.operators import evaluation, forensics, models, ranking, scoring, texts


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_numbers_and_dates(spark):
    lit = F.lit
    assert one(spark, c.number(lit("1,234.5 元"))) == 1234.5
    assert one(spark, c.number(lit("(12)"))) == -12
    assert one(spark, c.number(lit("none"))) is None
    assert one(spark, c.roc_year(lit("113"))) == 2024
    for text in ("2024-03-05", "113年3月5日", "113/3/5", "20240305", "1130305"):
        assert str(one(spark, c.flexible_date(lit(text)))) == "2024-03-05", text
    assert one(spark, c.flexible_date(lit("2024-13-40"))) is None


def test_tails(spark):
    assert abs(one(spark, c.chi2_tail_8(F.lit(15.507))) - 0.05) < 1e-4
    for k, rate in ((0, 1.0), (3, 0.5), (30, 12.0)):
        want = 1 - sum(math.exp(-rate) * rate**i / math.factorial(i) for i in range(k))
        assert abs(one(spark, c.poisson_tail(F.lit(k), F.lit(rate))) - want) < 1e-12


def test_null_guards(spark):
    null = F.lit(None).cast("double")
    assert one(spark, c.clamp(null)) is None
    assert one(spark, c.weighted_mean([(null, 0.5), (F.lit(4.0), 0.5)])) == 4.0
    assert one(spark, c.weighted_mean([(null, 0.5)])) == 0.0
    assert one(spark, c.safe_div(F.lit(1), F.lit(0))) is None


def test_positions_with_ties_and_nulls(spark):
    values = [3.0, None, 5.0, 5.0, 1.0, 3.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, s double")
    got = [r.id for r in ranking.with_position(df, "s", ["id"]).orderBy("rank").collect()]
    assert got == [2, 3, 0, 5, 4, 1, 6]
    mid = {r.id: r.midrank for r in ranking.with_midrank(df.where("s is not null"), "s").collect()}
    assert mid == {2: 0.8, 3: 0.8, 0: 0.4, 5: 0.4, 4: 0.1}
    assert ranking.with_position(df.limit(0), "s", ["id"]).count() == 0


def test_auc_of_one_class(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1)], "s double, y int")
    assert evaluation.auc(df, "s", "y").first().auc == 0.5


def test_benford_needs_enough(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 25)] + [("b", float(i)) for i in range(1, 26)], "k string, v double")
    assert [r.k for r in forensics.benford_test(df, "k", "v").collect()] == ["b"]


def test_name_matching(spark):
    names = spark.createDataFrame([("anxi",), ("anxix",), ("banqiao",), ("ab",)], "q string")
    known = spark.createDataFrame([(1, "anxi"), (2, "banqiaoo"), (3, "cab"), (4, "abc")], "id int, c string")
    assert {(r.q, r.id, r.how) for r in texts.match_names(names, known, "q", "id", "c").collect()} == {("anxi", 1, "exact"), ("anxix", 1, "contains"), ("banqiao", 2, "contains")}


def test_knn_against_loops(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 3))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double, c double")
    got = {r.id: r.knn for r in models.knn_scores(df, "id", ["a", "b", "c"]).collect()}
    for i in range(40):
        d = np.sort(((x - x[i]) ** 2).sum(1)[np.arange(40) != i])[:8]
        assert abs(got[i] - math.sqrt(d.mean())) < 1e-9


def test_forest_isolates_the_far_point(spark):
    x = np.r_[np.random.default_rng(2).normal(size=(200, 2)), [[9.0, 9.0]]]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double")
    assert models.isolation_scores(df, "id", ["a", "b"]).orderBy(F.desc("iforest")).first().id == 200


def test_schedule_and_review(spark):
    df = spark.createDataFrame([(i, float(100 - i)) for i in range(100)], "id int, s double")
    got = scoring.schedule(scoring.ranked(df, "s", "id"), 10, "2026-01-01").orderBy("rank").collect()
    assert [(r.band, r.wave) for r in got][:3] == [("critical", 1), ("critical", 1), ("high", 2)]
    assert len(got) == 10


def test_anomaly_queries_read_every_component(spark, tmp_path):
    from lynxmark.plans.catalogue import QUERIES

    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 64))
    x[7, 40:] += 40.0
    df = spark.createDataFrame([(k, r) for k, r in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    for name, column in (("knn_outlier", "knn"), ("isolation_forest", "iforest"), ("combined_anomaly", "anomaly")):
        got = QUERIES[name](spark, str(tmp_path)).collect()
        assert len(got) == 300 and max(got, key=lambda r: r[column]).vec_id == 7, name


def test_halves_round_as_in_sql(spark):
    """Customers whose blended score lies half-way: SQL and query agree to the last place."""
    import duckdb

    for x, places in ((45.675, 2), (-45.675, 2), (1.005, 2), (66.5649905, 6), (0.5, 0), (1e200, 6), (None, 2)):
        assert one(spark, c.rounded(F.lit(x).cast("double"), places)) == duckdb.execute("SELECT round(?::DOUBLE, ?::INT)", [x, places]).fetchall()[0][0], x


def test_model_features_measure_texts_once(spark):
    """Medians and models go over staged numbers; no later pass reads the texts."""
    import os

    import pytest

    from lynxmark.plans import model_queries
    from lynxmark.plans.registry import Tables

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    t = Tables(spark, folder)
    made = model_queries.features(t)
    assert not [f for f in made.inputFiles() if "documents.parquet" in f]
    assert made.count() == t.documents.join(t.labels, "doc_id").count()
