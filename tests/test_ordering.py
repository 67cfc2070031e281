"""Bucketed running values equal plain windows, also when one key holds most rows."""

import random

from pyspark.sql import Window, functions as F

from talkweave.operators.ordering import first_distinct, running, with_ordinal


def test_running_equals_window(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randint(0, 5)}", i, rng.randint(-5, 5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, o bigint, v int")
    for inclusive in (True, False):
        got = running(df, ["k"], [F.col("o")], F.floor(F.col("o") / 37),
                      {"n": ("count", None), "s": ("sum", F.col("v")), "m": ("max", F.struct("v", "o"))}, inclusive)
        w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        want = df.select("k", "o", F.count(F.lit(1)).over(w).alias("n"), F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s"), F.max(F.struct("v", "o")).over(w).alias("m"))
        assert sorted(map(tuple, got.select("k", "o", "n", "s", "m").collect())) == sorted(map(tuple, want.collect()))


def test_ordinal_is_dense(spark):
    df = spark.range(0, 1000).select(F.lit("one").alias("k"), (F.col("id") * 3).alias("o"))
    got = with_ordinal(df, ["k"], [F.col("o")], F.floor(F.col("o") / 100), "pos")
    assert [r.pos for r in got.orderBy("o").collect()] == list(range(1, 1001))


def test_first_distinct(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("a", 2, "x"), ("a", 4, "z"), ("a", 5, None)], "k string, o int, v string")
    assert first_distinct(df, ["k"], "v", ["o"], 2, "vs").collect()[0].vs == ["y", "x"]
