"""Token files: Parquet list columns in document order, written and read by Spark.

Every file holds one range of document ids in ascending order. Ids are a list column with
dictionary or delta encoding; row groups and pages have bounded sizes, and Parquet's page indexes
let a reader that asks for a few documents, or for metadata alone, skip the rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from talkweave.llm.common import whole_text
from talkweave.llm.encoding import encoder

#: Parquet writer settings for each encoding of the ids.
ENCODINGS = {"dictionary": {"parquet.enable.dictionary": "true", "parquet.writer.version": "v1"},
             "delta": {"parquet.enable.dictionary": "false", "parquet.writer.version": "v2"}}


def _encode_batches(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.array([end_id], dtype="<u4").tobytes()
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [enc.encode(t) + end for t in batch.column("text").to_pylist()]
            offsets = np.zeros(len(ids) + 1, dtype=np.int32)
            np.cumsum([len(b) // 4 for b in ids], out=offsets[1:])
            values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(ids))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), batch.column("source"), pa.array(np.diff(offsets), pa.int32()),
                 pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(np.full(len(ids), part, dtype=np.int32)),
                 pa.array(np.arange(place, place + len(ids), dtype=np.int64))],
                names=["doc_id", "lang", "source", "n_tokens", "ids", "part", "place"])
            place += len(ids)

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, encoding: str = "dictionary",
                 row_group_bytes: int = 16 << 20, page_rows: int = 200, page_bytes: int = 256 << 10, codec: str = "zstd") -> None:
    """Write the ids of every text of ``docs``, with ``end_id`` after each, to Parquet files at ``path``.

    Files and their rows are in ascending ``doc_id`` (null first; rows that repeat an id follow the
    text). ``part`` numbers the ranges of ids and ``place`` the rows of a range, so a row's place in the whole is
    kept whatever the files are called. A null text is empty and has the end id only. ``lang`` and ``source`` go along as
    metadata where they exist, other columns do not. An empty table gives files without rows.
    """
    extra = [F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *extra, whole_text().alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ids = ordered.mapInArrow(_encode_batches(tokenizer, end_id), "doc_id long, lang string, source string, n_tokens int, ids array<int>, part int, place long")
    writer = ids.write.option("compression", codec).option("parquet.block.size", row_group_bytes)
    writer = writer.option("parquet.page.row.count.limit", page_rows).option("parquet.page.size", page_bytes)
    for key, value in ENCODINGS[encoding].items():
        writer = writer.option(key, value)
    writer.parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: Sequence[str] = ("doc_id", "ids"),
                ids_between: tuple[int, int] | None = None) -> DataFrame:
    """Chosen columns of chosen documents; the range of ids is pushed to row groups and pages."""
    df = spark.read.parquet(path)
    if ids_between is not None:
        df = df.filter(F.col("doc_id").between(*ids_between))
    return df.select(*columns)


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        offsets = np.asarray(ids.offsets)
        raw = memoryview(np.ascontiguousarray(np.asarray(ids.values), dtype="<u4")).cast("B")
        crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("part"), batch.column("place"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())],
            names=["doc_id", "part", "place", "n_tokens", "ids_crc32"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """From the files alone: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``.

    Rows that repeat an id stand where they were written.
    """
    stored = spark.read.parquet(path).select("doc_id", "ids", "part", "place")
    rows = stored.mapInArrow(_digest_batches, "doc_id long, part int, place long, n_tokens long, ids_crc32 long")
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range of ids.
    sizes = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("_size"))
    before = sizes.select("part", F.coalesce(F.sum("_size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    local = rows.withColumn("_local", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return local.join(before, "part").select("doc_id", (F.col("_before") + F.col("_local")).alias("start"), "n_tokens", "ids_crc32")
