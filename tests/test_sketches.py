"""Quantile sketches against sorted values."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkweave.operators import sketches as sk

POINTS = [0.0, 0.5, 0.95, 0.99, 1.0]


def place(values, p):
    return sorted(values)[int(np.floor(p * (len(values) - 1)))]


@pytest.mark.parametrize("error", [0.01, 0.1])
def test_error_is_within_the_bound(spark, error):
    rng = np.random.default_rng(2)
    groups = {"lognormal": rng.lognormal(5, 2, 5000), "pareto": rng.pareto(0.7, 5000) + 1, "equal": np.full(300, 7.25), "signs": np.concatenate((-rng.random(40), np.zeros(30), rng.random(60) * 1e-6)), "one": np.array([3.0])}
    rows = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [("one", None)], "k string, v double")
    got = {r.k: r for r in sk.sketch_quantiles(sk.log_sketch(rows, ["k"], "v", error), ["k"], POINTS, error).collect()}
    assert {k: r.n for k, r in got.items()} == {k: len(vs) for k, vs in groups.items()}
    for k, vs in groups.items():
        for p in POINTS:
            want = max(0.0, place(vs, p))
            assert abs(got[k][f"p{round(p * 100)}"] - want) <= error * want * (1 + 1e-9), (k, p)


def test_merged_sketches_are_the_sketch_of_all(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), (F.col("id") * F.col("id") + 1).alias("v"))
    parts = [sk.log_sketch(rows.filter(F.col("v") % 4 == i), ["k"], "v") for i in range(4)]
    merged = {tuple(r) for r in sk.merge_sketches(parts, ["k"]).collect()}
    assert merged == {tuple(r) for r in sk.log_sketch(rows, ["k"], "v").collect()}


def test_sliding_windows_come_from_panes(spark):
    start = dt.datetime(2024, 1, 1)
    data = [(start + dt.timedelta(minutes=7 * i), float(i * i % 997 + 1)) for i in range(200)]
    rows = spark.createDataFrame(data, "at timestamp, v double")
    found = sk.sketch_quantiles(sk.sliding_sketches(rows, "at", "v", "1 hour", 3), ["window_end"], [0.5])
    got = {r.window_end: (r.n, r.p50) for r in found.collect()}
    for end, (n, p50) in got.items():
        inside = [v for at, v in data if end - dt.timedelta(hours=3) <= at < end]
        assert n == len(inside) and abs(p50 - place(inside, 0.5)) <= 0.0100001 * place(inside, 0.5)
    assert len(got) >= 24


def test_empty(spark):
    empty = spark.createDataFrame([], "k string, v double")
    assert sk.sketch_quantiles(sk.log_sketch(empty, ["k"], "v"), ["k"], [0.5]).count() == 0
    with pytest.raises(ValueError):
        sk.log_bucket(F.col("v"), 1.5)
