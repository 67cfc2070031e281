"""Exact deduplication by content sort, in DataFrame functions only.

Sampled splitters range-partition the texts, every partition is sorted on its content (Spark
sorts externally), and a window compares neighbours in full. The sort key starts with a short
prefix and a digest so that the sample of splitters and most comparisons stay small; equality is
decided by the whole text.

A text with very many copies is spread: texts that hold more than 1/(4 x partitions) of all rows
(at most 4 x partitions of them, so their list is small by its definition) get a salt made of the
document id. Each salted run is reduced to one summary row, and the summaries of a text meet in a
second comparison of whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from talkweave.llm.common import partitions_of, whole_text

PREFIX_CHARS = 32


def _normalised(text: Column, normalise: str) -> Column:
    if normalise == "none":
        return text
    if normalise == "blanks":
        return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    raise ValueError(normalise)


def _hot_digests(digests: DataFrame, partitions: int, least: int) -> DataFrame:
    """Digests shared by more than 1/(4 x partitions) of all rows: at most 4 x partitions rows."""
    counts = digests.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n"))
    total = digests.agg(F.count(F.lit(1)).alias("_all"))
    return (counts.filter(F.col("_n") >= least).join(F.broadcast(total), F.col("_n") * (4 * partitions) > F.col("_all"))
            .select("_digest", F.lit(True).alias("_hot")))


def exact_groups(docs: DataFrame, keep: str = "smallest", normalise: str = "none", hot_rows: int = 256) -> DataFrame:
    """Each input row with the group of equal texts it belongs to.

    Returns ``row`` (struct of all input columns, so no name can clash), ``doc_id``, ``keep_id``
    (``keep``: "smallest" or "largest" id of the group), ``group_size``, ``kept`` and
    ``text_sha256`` of the normalised text. A null text is empty. Ids that are null come last: they
    are kept only in a group without any id. Of rows that repeat the kept id exactly one has
    ``kept``. An empty table gives no rows. Texts with fewer than ``hot_rows`` copies are never
    spread.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(keep)
    best = F.min if keep == "smallest" else F.max
    n = partitions_of(docs)
    text = _normalised(whole_text(), normalise)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id"), text.alias("_text")).withColumn("_digest", F.xxhash64("_text"))
    hot = F.broadcast(_hot_digests(docs.select(F.xxhash64(text).alias("_digest")), n, hot_rows))
    salted = rows.join(hot, "_digest", "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("doc_id"), F.lit(n)) + 1).otherwise(F.lit(0)).cast("int"))
    ranged = salted.withColumn("_prefix", F.substring("_text", 1, PREFIX_CHARS)).repartitionByRange("_prefix", "_digest", "_salt")

    equal = Window.partitionBy("_prefix", "_digest", "_salt", "_text")
    order = F.col("doc_id").asc_nulls_last() if keep == "smallest" else F.col("doc_id").desc_nulls_last()
    runs = ranged.select(
        "row", "doc_id", "_salt", F.sha2("_text", 256).alias("text_sha256"),
        F.row_number().over(equal.orderBy(order)).alias("_pos"),
        best("doc_id").over(equal).alias("_best"), F.count(F.lit(1)).over(equal).alias("_size"))

    # Salted runs only: one summary per run, compared in full across salts; at most 4 n texts.
    summaries = (salted.filter("_salt > 0").groupBy("_text", "_salt").agg(best("doc_id").alias("_best"), F.count(F.lit(1)).alias("_size"))
                 .groupBy("_text").agg(best("_best").alias("_all_best"), F.sum("_size").alias("_all_size"))
                 .select(F.sha2("_text", 256).alias("text_sha256"), "_all_best", "_all_size", F.lit(True).alias("_spread")))
    out = runs.join(F.broadcast(summaries), "text_sha256", "left")
    keep_id = F.when(F.col("_spread"), F.col("_all_best")).otherwise(F.col("_best"))
    size = F.when(F.col("_spread"), F.col("_all_size")).otherwise(F.col("_size"))
    first_salt = F.pmod(F.xxhash64(keep_id), F.lit(n)) + 1
    kept = (F.col("_pos") == 1) & F.col("doc_id").eqNullSafe(keep_id) & ((F.col("_salt") == 0) | (F.col("_salt") == first_salt))
    return out.select("row", "doc_id", keep_id.alias("keep_id"), size.alias("group_size"), kept.alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, keep: str = "smallest", normalise: str = "none") -> DataFrame:
    """``docs`` with one row of each group of equal texts; columns as they came."""
    return exact_groups(docs, keep, normalise).filter("kept").select("row.*")
