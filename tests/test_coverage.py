"""Benchmarks, collisions and coverage on small cases."""

import numpy as np
import pytest

from lynxmark.operators import coverage as c
from lynxmark.operators.ranking import whole_quantiles


@pytest.mark.parametrize("n", [1, 2, 5, 1000])
def test_whole_quantiles(spark, n):
    values = [float(i * i % 37) for i in range(n)]
    got = whole_quantiles(spark.createDataFrame([(v,) for v in values] + [(None,)], "v double"), "v", (0.0, 0.1, 0.5, 0.75, 1.0)).first()
    assert got.n == n and np.allclose(got[1:], np.quantile(values, [0.0, 0.1, 0.5, 0.75, 1.0]))


def test_benchmark(spark):
    rows = [("a", float(i)) for i in range(5)] + [("b", 100.0), (None, None)]
    got = {r.g: r for r in c.peer_benchmark(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    assert (got["a"].basis, got["a"].q1, got["a"].median, got["a"].max) == ("peers", 1.0, 2.0, 4.0)
    assert (got["b"].basis, got["b"].n, got["b"].median, got["b"].max) == ("all", 1, 2.5, 100.0)
    assert (got[None].basis, got[None].n) == ("all", 0)
    assert c.peer_benchmark(spark.createDataFrame([], "g string, v double"), "g", "v").count() == 0


def test_collisions_and_coverage(spark):
    names = spark.createDataFrame([("k", "x"), ("k", "y"), ("k", "y"), ("l", "x"), ("l", None)], "k string, n string")
    assert [tuple(r) for r in c.collisions(names, "k", "n").collect()] == [("k", 2, "x")]
    facts = spark.createDataFrame([("k",), ("k",), (None,)], "id string")
    master = spark.createDataFrame([("k", 1), (None, 2), ("m", 3)], "k string, extra int")
    got = {r.k: (r.has_f, r.share) for r in c.coverage(master, "k", {"f": (facts, "id")}).collect()}
    assert got == {"k": (True, 1.0), None: (False, 0.0), "m": (False, 0.0)}
