"""Exact quantiles without a group in one buffer, against percentile."""

import random

import pytest
from pyspark.sql import functions as F

from grafita.operators import evaluate as ev


@pytest.mark.parametrize("at_once", [50, 10_000])
def test_quantiles_equal_percentile(spark, at_once):
    rng = random.Random(3)
    rows = [("big", rng.gauss(0, 1) ** 3) for _ in range(4000)] + [("ties", float(rng.randint(0, 3))) for _ in range(900)] + [("one", 4.5), ("two", 1.0), ("two", 2.0), ("none", None), (None, 3.0), (None, -1.0)]
    rows += [("same", 7.0)] * 500 + [("wide", 10.0 ** rng.randint(-300, 300)) for _ in range(300)] + [("near", 1e15 + i / 8) for i in range(200)] + [("ends", x) for x in [float("inf"), float("-inf"), 1.0, 2.0, 3.0, 5.0, 8.0] * 3]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    wanted = {"q0": 0.0, "q5": 0.05, "q50": 0.5, "q95": 0.95, "q1": 1.0}
    got = {r.g: r for r in ev.quantiles(df, "x", ["g"], wanted, at_once).collect()}
    want = {r.g: r for r in df.groupBy("g").agg(*[F.percentile("x", p).alias(n) for n, p in wanted.items()]).collect()}
    assert set(got) == set(want)
    for g, w in want.items():
        for n in wanted:
            a, b = got[g][n], w[n]
            assert a == b or a is not None and b is not None and abs(a - b) <= 1e-12 * abs(b), (g, n, a, b)


def test_latency_without_groups_and_of_no_rows(spark):
    df = spark.range(1, 102).select((F.col("id") * 1.0).alias("x"))
    assert tuple(ev.latency(df, "x").first()) == (51.0, 51.0, 96.0, 101)
    assert tuple(ev.latency(df.limit(0), "x").first()) == (None, None, None, 0)
