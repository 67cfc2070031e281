"""Packing documents into sequences of bounded length, in document order, by dynamic programming.

The token stream runs through the documents in ascending id. Cuts may stand at document ends (free),
at sentence ends and, inside long sentences, at every ``GAP`` tokens (each with a truncation penalty).
A window of L tokens costs its padding: none if L is a power of two, else ``seq_len`` - L. For a cut
at position c the best predecessor p minimises f(p) + p over the last ``seq_len`` positions, a sliding
minimum kept in a monotone queue; windows whose length is a power of two are looked up beside it.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from talkweave.llm.common import whole_text
from talkweave.llm.encoding import encoder

GAP = 128
BLOCK_TOKENS = 1 << 18


def best_cuts(positions: list[int], penalties: list[int], seq_len: int) -> list[int]:
    """Indices of the chosen cuts among ``positions`` (ascending, first 0, last the end; steps of at
    most ``seq_len``), minimising padding plus the penalties of the cuts."""
    powers = [1 << k for k in range(seq_len.bit_length()) if 1 << k < seq_len]
    power_full = seq_len & (seq_len - 1) == 0
    cost, back = [0] * len(positions), [0] * len(positions)
    key = [0] * len(positions)  # cost + position
    at = {0: 0}
    queue: deque[int] = deque([0])
    for j in range(1, len(positions)):
        here = positions[j]
        while positions[queue[0]] < here - seq_len:
            queue.popleft()
        i = queue[0]
        best = key[i] + seq_len - here
        if best > 0 or not power_full:
            for p in powers:
                k = at.get(here - p)
                if k is not None and cost[k] < best:
                    best, i = cost[k], k
        cost[j], back[j] = best + penalties[j], i
        mine = key[j] = cost[j] + here
        at[here] = j
        while queue and key[queue[-1]] >= mine:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(positions) - 1
    while j > 0:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


def _candidates(ids: np.ndarray, ends: np.ndarray, flags: np.ndarray, sentence: int, inside: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions of a block and their penalties; ``ends``: positions after each document."""
    penalty = np.full(len(ids) + 1, inside, dtype=np.int64)
    where = np.zeros(len(ids) + 1, dtype=bool)
    after = np.flatnonzero(flags[np.minimum(ids, len(flags) - 1)]) + 1
    where[after], penalty[after] = True, sentence
    where[0] = True
    where[ends], penalty[ends] = True, 0
    soft = np.flatnonzero(where)
    long = np.flatnonzero(np.diff(soft) > GAP)
    for a, b in zip(soft[long].tolist(), soft[long + 1].tolist()):
        where[a + GAP:b:GAP] = True
    positions = np.flatnonzero(where)
    return positions, penalty[positions]


def _pack_batches(path: str, seq_len: int, end_id: int, sentence: int, inside: int):
    names = ["doc_id", "start", "length", "doc_tokens", "part", "sequence", "offset", "padded", "ids"]

    def pack(docs: list[tuple[int, bytes]], part: int, first: int, flags: np.ndarray) -> tuple[pa.RecordBatch, int]:
        raw = b"".join(b for _, b in docs)
        ids = np.frombuffer(raw, dtype="<u4")
        sizes = np.array([len(b) // 4 for _, b in docs], dtype=np.int64)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        positions, penalties = _candidates(ids, ends, flags, sentence, inside)
        chosen = best_cuts(positions.tolist(), penalties.tolist(), seq_len)
        cuts = positions[chosen]
        stops = np.union1d(cuts, ends)
        starts = np.concatenate(([0], stops[:-1]))
        doc = np.searchsorted(ends, starts, side="right")
        sequence = np.searchsorted(cuts, starts, side="right")
        opens = np.concatenate(([0], cuts[:-1]))
        size = cuts - opens
        padded = np.where((size & (size - 1)) == 0, size, seq_len)
        keys = [k for k, _ in docs]
        columns = [pa.array([keys[d] for d in doc.tolist()], pa.int64()), pa.array(starts - begins[doc]), pa.array(stops - starts), pa.array(sizes[doc]),
                   pa.array(np.full(len(doc), part, dtype=np.int64)), pa.array(sequence + first), pa.array(starts - opens[sequence]), pa.array(padded[sequence]),
                   pa.array([raw[4 * a:4 * b] for a, b in zip(starts.tolist(), stops.tolist())], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=names), first + len(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.array([end_id], dtype="<u4").tobytes()
        flags, part, first = enc.ends_sentence(), TaskContext.get().partitionId(), 0
        docs: list[tuple[int, bytes]] = []
        held = 0
        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                docs.append((key, enc.encode(text) + end))
                held += len(docs[-1][1]) // 4
                if held >= BLOCK_TOKENS:
                    out, first = pack(docs, part, first, flags)
                    yield out
                    docs, held = [], 0
        if docs:
            yield pack(docs, part, first, flags)[0]

    return run


def pack_pieces(docs: DataFrame, tokenizer: str, seq_len: int = 1024, end_id: int = 0, sentence_penalty: int = 4,
                inside_penalty: int = 16) -> DataFrame:
    """Pieces of documents with their place in a sequence.

    Returns ``doc_id``, ``start`` (ids of its document before it), ``length``, ``doc_tokens``, ``part`` and
    ``sequence`` (a sequence's number inside its part of the stream), ``offset`` (in the sequence),
    ``padded`` (length the sequence is padded to) and ``ids`` (little-endian unsigned 32-bit).
    Every text is followed by ``end_id``; a null or empty text is that id alone. Rows that repeat a
    ``doc_id`` are documents of their own, null ids come first. Other columns are not read. An empty
    table gives no pieces. Within a part the stream is packed in blocks that end with the first
    document beyond ``BLOCK_TOKENS``.
    """
    if seq_len < GAP:
        raise ValueError(f"seq_len must be {GAP} at least")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(
        _pack_batches(tokenizer, seq_len, end_id, sentence_penalty, inside_penalty),
        "doc_id long, start long, length long, doc_tokens long, part long, sequence long, offset long, padded long, ids binary")


def number_sequences(pieces: DataFrame) -> DataFrame:
    """Replace (``part``, ``sequence``) by ``sequence_id``, consecutive over all parts. ``pieces`` is read twice."""
    sizes = pieces.groupBy("part").agg((F.max("sequence") + 1).alias("_n"))  # one row per part
    before = sizes.select("part", F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return pieces.join(before, "part").withColumn("sequence_id", F.col("_before") + F.col("sequence")).drop("part", "sequence", "_before")
