"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from talkweave.llm.common import BLANK, kept, whole_text, word_count
from talkweave.operators.ordering import running

KEY_DIGITS = 3  # leading hex digits of a row's key that number the buckets of a source: 4096


def cyclic_weights(pattern: Sequence[int]):
    """Weights by the rank of the source in code point order, null last, repeating ``pattern``."""

    def weigh(rank: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, pattern)), (rank - 1) % len(pattern) + 1)

    return weigh


def fill_targets(sources: DataFrame, weigh, share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """Add ``target`` to one row per source (``_source``, ``source_size``).

    A level L is sought with sum(min(cap, weight * L)) = ``share`` * all sizes; cap = ``max_epochs`` *
    size. In the order of cap / weight a source is clamped if the level that the rest would have lies
    above that ratio; the first that is not clamped fixes the level of all later ones. That is the end
    of clamping and resharing by weight until none is above its cap. The windows run over one row per
    source, not over documents.
    """
    ranked = sources.withColumn("_weight", weigh(F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last()))).cast("double"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    order = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("_source").asc_nulls_last())
    levels = (
        ranked.withColumn("_cap", F.col("source_size") * F.lit(max_epochs))
        .withColumn("_total", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("_before", F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_rest", F.sum("_weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_total") - F.col("_before")) / F.col("_rest"))
        .withColumn("_clamped", F.col("_cap") / F.col("_weight") < F.col("_level"))
    )
    level = F.max(F.when(~F.col("_clamped"), F.col("_level"))).over(everything)  # levels fall after the first that is not clamped
    target = F.when(F.col("_clamped"), F.col("_cap").cast("double")).otherwise(F.least(F.col("_weight") * level, F.col("_cap").cast("double")))
    return levels.withColumn("target", target).select("_source", "source_size", "target")


def mix(docs: DataFrame, weigh, share: float = 1.5, max_epochs: int = 2, seed: int = 7) -> DataFrame:
    """How many words of every document the mix takes.

    Returns ``doc_id``, ``source``, ``size`` (words), ``source_size``, ``target`` (of the source),
    ``taken``. A source takes floor(target) words exactly: each document as often as the target holds
    the whole source, then, in an order seeded by ``seed`` and the id, documents once more until the
    rest is used up, the last of them in part. ``taken`` never exceeds ``max_epochs`` * ``size``. A null
    text has size 0; null is a source of its own, after all others; sources without words get target 0.
    Rows that repeat an id follow each other in the order. An empty table gives no rows. The order is
    summed per source and leading digits of the key, so a source of any size spreads over all tasks.
    """
    return _mix(docs, weigh, share, max_epochs, seed, F.lit(0).cast("long")).drop("_digest")


def _mix(docs: DataFrame, weigh, share: float, max_epochs: int, seed: int, digest: Column) -> DataFrame:
    rows = kept(docs.select("doc_id", F.col("source").cast("string").alias("_source"), word_count(whole_text()).cast("long").alias("size"), digest.alias("_digest")))
    sources = rows.groupBy("_source").agg(F.sum("size").alias("source_size"))
    targets = fill_targets(sources, weigh, share, max_epochs).withColumn("_key", _null_safe("_source")).drop("_source")
    keyed = rows.withColumn("_key", _null_safe("_source")).withColumn("_order", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    bucket = F.conv(F.substring("_order", 1, KEY_DIGITS), 16, 10).cast("int")
    ordered = running(keyed, ["_key"], [F.col("_order"), F.col("size"), F.col("_digest")], bucket, {"_before": ("sum", F.col("size"))}, inclusive=False)
    whole = F.floor(F.floor("target") / F.greatest(F.col("source_size"), F.lit(1)))
    rest = F.floor("target") - whole * F.col("source_size")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before")))
    return ordered.join(targets, "_key").select(
        "doc_id", F.col("_source").alias("source"), "size", "source_size", "target", taken.cast("long").alias("taken"), "_digest")


def _null_safe(name: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(name)), F.lit("null"))


def _leading_words(text: Column, n: Column) -> Column:
    """The text up to and with its ``n``-th word and the blanks after it."""
    units = F.split(text, f"(?<={BLANK})(?=[^\\x20\\x09-\\x0D])")
    lead = F.when(text.rlike(f"^{BLANK}"), 1).otherwise(0)
    return F.concat_ws("", F.slice(units, F.lit(1), (n + lead).cast("int")))


def mixed_documents(docs: DataFrame, weigh, share: float = 1.5, max_epochs: int = 2, seed: int = 7) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them; a partial repetition has the leading words.

    Columns as they came; ``n_chars``, where there is one, follows the text of a partial repetition.
    Documents without words are kept once. Shares are kept by source, id and text, so an id in two sources
    brings each its own; rows that agree in all three divide theirs, whole repetitions first.
    """
    digest = F.xxhash64(whole_text())
    plan = _mix(docs, weigh, share, max_epochs, seed, digest)
    keys = ["_none", "_id", "_key", "_digest"]

    def keyed(df: DataFrame, source: Column, text_digest: Column, *rest) -> DataFrame:
        i = F.col("doc_id")
        return df.select(*rest, i.isNull().alias("_none"), F.coalesce(i.cast("string"), F.lit("")).alias("_id"), source.alias("_key"), text_digest.alias("_digest"))

    shares = keyed(plan, _null_safe("source"), F.col("_digest"), "taken", "size").groupBy(*keys).agg(
        F.sum("taken").alias("_taken"), F.max("size").alias("_size"), F.count(F.lit(1)).alias("_rows"))
    rows = keyed(docs.withColumn("_source", F.col("source").cast("string")), _null_safe("_source"), digest, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    placed = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))))
    rows = placed.join(shares, keys)
    full = F.floor(F.col("_taken") / F.greatest(F.col("_size"), F.lit(1)))
    own = F.floor(full / F.col("_rows")) + (F.col("_n") <= full % F.col("_rows")).cast("long")
    copies = F.when(F.col("_size") == 0, 1).otherwise(own)
    rest = F.when((F.col("_size") > 0) & (F.col("_n") == full % F.col("_rows") + 1), F.col("_taken") - full * F.col("_size")).otherwise(0)
    parts = F.concat(F.array_repeat(F.lit(0).cast("long"), copies.cast("int")), F.when(rest > 0, F.array(rest.cast("long"))).otherwise(F.array().cast("array<bigint>")))
    out = rows.select("row", F.explode(parts).alias("_words"))
    text = F.col("row")["text"]
    cut = F.when(F.col("_words") > 0, _leading_words(text, F.col("_words"))).otherwise(text)
    columns = []
    for field in docs.schema.fields:
        value = F.col("row").getField(field.name)
        if field.name == "text":
            value = cut
        elif field.name == "n_chars":
            value = F.when(F.col("_words") > 0, F.length(cut).cast(field.dataType)).otherwise(value)
        columns.append(value.alias(field.name))
    return out.select(*columns)
