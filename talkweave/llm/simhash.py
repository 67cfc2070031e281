"""SimHash near-duplicates by an inverted index over byte positions.

A fingerprint has eight bytes. Two fingerprints that differ in at most four bits differ in at most
four bytes, so they share at least 8 - 4 = 4 positional bytes: the guaranteed minimum of matches. The
index therefore has one list per choice of four positions and their byte values (70 entries for each
distinct fingerprint); whoever meets in a list has reached the minimum, and lists stay short where
single bytes would gather everything. Pairs that meet are verified on all 64 bits.

Copies, and texts that differ but have one fingerprint, collapse before the index. In a list of many
distinct fingerprints a search outward from each unvisited one emits one link per member reached,
not all pairs, so a large cluster costs its size times the few searches it takes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from talkweave.llm.common import arrow_rows, kept, whole_text
from talkweave.operators.similar import connected_components

SHINGLE = 4
MAX_BITS = 4
_STEP = 1 << 16
_SHORT = 24  # longest list that is compared by shifts
_BUCKETS = 8  # that the members of a component are dealt to


def simhash(raw: bytes, shingle: int = SHINGLE, seed: int = 42) -> int:
    """Signed 64-bit fingerprint of a UTF-8 text: a bit is 1 if set in over half the shingles' XXH64.

    A-Z count as a-z; words are runs without ASCII blanks. Fewer words than ``shingle``: one shingle of
    them all; no words: 0.
    """
    words = raw.lower().split()
    n = max(1, len(words) - shingle + 1)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[min(shingle, len(words)) - 1:]
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, n, _STEP):
        found = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[at:min(n, at + _STEP)].tolist(), last[at:at + _STEP].tolist())])
        bits = np.unpackbits(np.frombuffer(found, dtype=np.uint8).reshape(-1, 8), axis=1)
        ones += np.add.reduce(bits, axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = 42) -> DataFrame:
    """``doc_id``, ``digest`` (of the text, to tell rows that repeat an id apart) and ``fp`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [simhash(t, shingle, seed) for t in batch.column("raw").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(fps, pa.int64())], names=["doc_id", "digest", "fp"])

    text = whole_text()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), text.cast("binary").alias("raw"))
    return rows.mapInArrow(run, "doc_id long, digest long, fp long")


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    choices = list(combinations(range(8), 8 - MAX_BITS))
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False)
        octets = fp.view(np.uint8).reshape(-1, 8).astype(np.int64)
        for number, places in enumerate(choices):
            entry = np.full(len(fp), number, dtype=np.int64)
            for p in places:
                entry = (entry << 8) | octets[:, p]
            yield pa.RecordBatch.from_arrays([pa.array(entry), batch.column("fp")], names=["entry", "fp"])


def _short_lists(entry: np.ndarray, fp: np.ndarray, longest: int, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links between rows of equal ``entry`` (sorted), comparing every row with the ones 1, 2, ... after it."""
    found = []
    for shift in range(1, longest):
        same = np.flatnonzero(entry[shift:] == entry[:-shift])
        if not len(same):
            break
        near = same[np.bitwise_count(fp[same] ^ fp[same + shift]) <= max_bits]
        found.append((fp[near], fp[near + shift]))
    return found


def _long_list(fp: np.ndarray, max_bits: int, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Links that span every component of a list: breadth-first, each member reached once."""
    left, right = [], []
    open_, frontier = fp, fp[:0]
    while len(open_):
        if not len(frontier):
            frontier, open_ = open_[:1], open_[1:]
        here, frontier = frontier[:block], frontier[block:]
        near = np.bitwise_count(here[:, None] ^ open_[None, :]) <= max_bits
        hit = near.any(axis=0)
        if hit.any():
            reached = open_[hit]
            left.append(here[near[:, hit].argmax(axis=0)])
            right.append(reached)
            frontier, open_ = np.concatenate((frontier, reached)), open_[~hit]
    return (np.concatenate(left), np.concatenate(right)) if left else (fp[:0], fp[:0])


def _links(max_bits: int):
    def batch_of(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a = np.concatenate([p for p, _ in pairs]).view(np.int64)
        b = np.concatenate([q for _, q in pairs]).view(np.int64)
        both = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["left", "right"])

    def whole(entry: np.ndarray, fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        edges = np.flatnonzero(np.concatenate(([True], entry[1:] != entry[:-1], [True])))
        size = np.diff(edges)
        found = [_long_list(fp[a:a + n], max_bits) for a, n in zip(edges[:-1][size > _SHORT].tolist(), size[size > _SHORT].tolist())]
        several = np.repeat((size > 1) & (size <= _SHORT), size)
        return found + _short_lists(entry[several], fp[several], _SHORT, max_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def done(parts):
            if parts and (found := [p for p in whole(np.concatenate([e for e, _ in parts]), np.concatenate([f for _, f in parts])) if len(p[0])]):
                yield batch_of(found)

        for batch in batches:
            entry, fp = batch.column("entry").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            cut = int(np.searchsorted(entry, entry[-1])) if len(entry) else 0
            if cut or (held and len(entry) and held[-1][0][-1] != entry[0]):
                yield from done([*held, (entry[:cut], fp[:cut])])
                held = []
            held.append((entry[cut:], fp[cut:]))
        yield from done(held)

    return run


def near_components(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Add ``component_id`` (smallest ``doc_id`` reachable over links of at most ``max_bits`` differing bits,
    itself included) to rows with ``doc_id`` and ``fp``. ``fps`` is read several times.

    Null ids have a component too, but never name one unless the whole component has no id.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the index guarantees links of up to 4 bits")
    spark = fps.sparkSession
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("_least"))
    with arrow_rows(spark, 20_000):
        entries = distinct.select("fp").mapInArrow(_index, "entry long, fp long").repartition("entry").sortWithinPartitions("entry", "fp")
        links = kept(entries.mapInArrow(_links(max_bits), "left long, right long").distinct())
    linked = links.select(F.col("left").alias("id")).union(links.select(F.col("right").alias("id"))).distinct()
    labels = connected_components(linked, links)
    # Fingerprints without a link stand for themselves. The others meet their component's least id; a component
    # may hold any share of them, so its row is laid out once for each of several buckets of members.
    members = distinct.join(labels, F.col("fp") == F.col("id")).select("fp", "component", "_least", F.pmod(F.xxhash64("fp"), F.lit(_BUCKETS)).alias("_bucket"))
    least = members.groupBy("component").agg(F.min("_least").alias("_name")).withColumn("_bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_BUCKETS - 1).cast("long"))))
    named = members.join(least, ["component", "_bucket"]).select("fp", "_name", F.lit(True).alias("_linked"))
    # Written, so that rows of one fingerprint meet it in a plain join, whose skewed keys are split at run time.
    by_fp = kept(distinct.join(named, "fp", "left").select("fp", F.when(F.col("_linked"), F.col("_name")).otherwise(F.col("_least")).alias("component_id")))
    return fps.join(by_fp, "fp")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, seed: int = 42) -> DataFrame:
    """``doc_id``, ``digest``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row.

    A null text is empty; texts without words have the fingerprint zero and link like any other. Rows
    that repeat an id are fingerprinted one by one. Other columns are not read. An empty table gives no rows.
    """
    fps = kept(fingerprints(docs, shingle, seed))
    return near_components(fps, max_bits).select(
        "doc_id", "digest", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with the document of the smallest id of each component; columns as they came.

    Of rows that repeat that id the one with the smallest digest stays, and one of equal rows.
    """
    found = near_duplicates(docs, shingle, max_bits)
    # The component's name is the winner's id; components without any id are one group.
    best = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("digest").alias("d"))).alias("w"))
    # The same plain keys for the numbering and the join: texts are shuffled once.
    def keys(i, d) -> list:
        return [i.isNull().alias("_none"), F.coalesce(i, F.lit(0).cast("long")).alias("_id"), d.alias("_digest")]

    winners = best.select(*keys(F.col("w.i"), F.col("w.d")))
    rows = docs.select(F.struct("*").alias("row"), *keys(F.col("doc_id").cast("long"), F.xxhash64(whole_text())))
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_none", "_id", "_digest").orderBy(F.lit(0)))).filter("_n = 1")
    return first.join(winners, ["_none", "_id", "_digest"], "left_semi").select("row.*")
