"""Ordered work inside groups of any size.

A plain window sorts a whole group in one task, which fails when one key holds a large
share of the rows. These helpers split every group into buckets that follow the order
(time slots, id ranges), do the ordered work per bucket, and carry one summary row per
bucket across. Results equal the plain window's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

ID_SPAN = 65536


def id_bucket(name: str, span: int = ID_SPAN) -> Column:
    return F.floor(F.col(name) / span)


def _local(name: str, kind: str, source: Column | None) -> Column:
    if kind == "count":
        return F.count(F.lit(1)).alias(name)
    if kind == "sum":
        return F.sum(source).alias(name)
    if kind == "max":
        return F.max(source).alias(name)
    raise ValueError(kind)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bucket: Column,
    columns: dict[str, tuple[str, Column | None]],
    inclusive: bool = True,
) -> DataFrame:
    """Add running ``count``/``sum``/``max`` columns over ``order`` within ``keys``.

    ``bucket`` must never decrease along ``order``. A ``max`` over a struct of
    (order, value) gives the last value seen.
    """
    keys = list(keys)
    marked = df.withColumn("_bucket", bucket)
    end = 0 if inclusive else -1
    local = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    source = {n: (F.lit(1) if k == "count" else c) for n, (k, c) in columns.items()}
    merge = {"count": F.sum, "sum": F.sum, "max": F.max}

    totals = marked.groupBy(*keys, "_bucket").agg(*[_local(f"_t_{n}", k, source[n]) for n, (k, _) in columns.items()])
    carried = totals.select(
        *keys, "_bucket", *[merge[k](F.col(f"_t_{n}")).over(before).alias(f"_c_{n}") for n, (k, _) in columns.items()])
    out = marked
    for n, (k, _) in columns.items():
        out = out.withColumn(f"_l_{n}", merge[k](source[n]).over(local))
    out = out.join(carried, on=[*keys, "_bucket"], how="left")
    for n, (k, _) in columns.items():
        here, prior = F.col(f"_l_{n}"), F.col(f"_c_{n}")
        if k == "max":
            out = out.withColumn(n, F.greatest(here, prior))
        else:
            out = out.withColumn(n, F.coalesce(here, F.lit(0)) + F.coalesce(prior, F.lit(0)))
    drop = [c for n in columns for c in (f"_l_{n}", f"_c_{n}")]
    return out.drop("_bucket", *drop)


def with_ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column,
                 name: str = "pos") -> DataFrame:
    """1-based position of each row within its group."""
    return running(df, keys, order, bucket, {name: ("count", None)})


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group. The engine limits groups before the shuffle, so each
    task passes on at most ``k`` rows per key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def first_distinct(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], k: int,
                   name: str | None = None) -> DataFrame:
    """Per group the first ``k`` distinct values in order of first sight, as an array."""
    name = name or value
    seen = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("_o"))
    top = top_rows(seen, keys, [F.col("_o")], k, "_r")
    return collect_in_order(top, keys, "_r", value, name)


def collect_in_order(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    """Array of a group's values by ``order``. For groups already bounded by a cap."""
    packed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return df.groupBy(*keys).agg(F.transform(packed, lambda s: s["v"]).alias(name))


def in_parts(df: DataFrame, keys: Sequence[str], pos: str, rows_per_part: int = 4096, part: str = "part") -> DataFrame:
    """Number bounded parts of a group, so that long groups become several rows."""
    return df.withColumn(part, F.floor((F.col(pos) - 1) / rows_per_part))
