"""Mergeable quantile sketches: counts in logarithmic buckets with a stated relative error.

A value v > 0 falls into bucket ceil(log_g v) with g = (1 + e) / (1 - e); the middle of a bucket is within e
of each of its values, relative to the value. Sketches are tables (keys, ``bucket``, ``n``), so merging
is adding counts: over tasks, over days, over the panes of a sliding window. A group has as many rows as
buckets, which the range of the values bounds, not their number. The exact path is
:func:`talkweave.operators.audit.exact_percentiles`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Bucket of values that are zero or less; they are estimated as 0.
ZERO = -(2**31)


def _growth(error: float) -> float:
    if not 0 < error < 1:
        raise ValueError("the relative error lies between 0 and 1")
    return (1 + error) / (1 - error)


def log_bucket(value: Column, error: float) -> Column:
    v = value.cast("double")
    return F.when(v > 0, F.ceil(F.log(v) / math.log(_growth(error))).cast("int")).otherwise(F.lit(ZERO))


def log_sketch(df: DataFrame, keys: Sequence[str | Column], value: str | Column, error: float = 0.01) -> DataFrame:
    """``bucket`` and ``n`` per key; null values are left out."""
    v = F.col(value) if isinstance(value, str) else value
    return df.filter(v.isNotNull()).groupBy(*keys, log_bucket(v, error).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge_sketches(sketches: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """One sketch of all rows; the sketches must have been made with one error."""
    merged = sketches[0]
    for s in sketches[1:]:
        merged = merged.unionByName(s)
    return merged.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))


def sketch_quantiles(sketch: DataFrame, keys: Sequence[str], points: Sequence[float], error: float = 0.01) -> DataFrame:
    """Per key ``n`` and ``p50`` and so on: an estimate within ``error`` of the value whose place, from 0, is the
    whole part of p (n - 1)."""
    growth = _growth(error)
    below = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    ranked = sketch.withColumn("_upto", F.sum("n").over(below)).withColumn("_all", F.sum("n").over(whole))

    def estimate(p: float) -> Column:
        bucket = F.min(F.when(F.col("_upto") > F.floor(F.lit(p) * (F.col("_all") - 1)), F.col("bucket")))
        return F.when(bucket == ZERO, 0.0).otherwise(F.pow(F.lit(growth), bucket) * (2 / (growth + 1)))

    return ranked.groupBy(*keys).agg(F.max("_all").alias("n"), *[estimate(p).alias(f"p{round(p * 100)}") for p in points])


def sliding_sketches(df: DataFrame, time: str, value: str | Column, pane: str, panes: int, keys: Sequence[str] = (), error: float = 0.01) -> DataFrame:
    """Sketches per ``window_end`` of windows of ``panes`` panes that move by one pane.

    Rows are counted once, in their pane; what is repeated for each window is the pane's buckets.
    """
    if panes < 1:
        raise ValueError("a window has one pane at least")
    start = F.window(time, pane)
    counted = log_sketch(df, [*keys, start["end"].alias("_end"), (F.unix_micros(start["end"]) - F.unix_micros(start["start"])).alias("_width")], value, error)
    ends = F.transform(F.sequence(F.lit(0), F.lit(panes - 1)), lambda i: F.timestamp_micros(F.unix_micros("_end") + i * F.col("_width")))
    return counted.withColumn("window_end", F.explode(ends)).groupBy(*keys, "window_end", "bucket").agg(F.sum("n").alias("n"))
