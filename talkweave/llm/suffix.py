"""Removing every byte of a repeated substring of at least ``length`` bytes, exactly.

Sorting all suffixes at once would need many times the corpus in memory and on disk, so suffixes go
through in blocks of buckets:

1. Of the ``length`` bytes that follow a position, the ``GRAM``-byte string with the smallest hash is its
   anchor. Equal strings have equal anchors at equal offsets, so the suffixes with one anchor are a bucket.
   Consecutive positions with the same anchor are a run and travel as one row (two hashes, no text).
2. A bucket with a single run holds nothing repeated. Runs that are equal as a whole repeat as a whole.
   What is left are buckets with different runs: edges of repeats, edits, ends of documents.
3. For those alone the bytes are fetched, one slice per different run. Buckets are sorted one block at
   a time with difference-cover ranks (``suffixblocks``), and neighbours are compared in full.
   A bucket of more than ``CHUNK`` slices is sorted in chunks; what each chunk found, one row for each
   different string, meets by a hash of the string.
4. Spans meet their document; texts are shuffled twice, suffixes never leave their block.

Equal runs inside a batch are merged before the first shuffle, so copies and periodic texts do not pile up.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from talkweave.llm.common import arrow_rows, kept, whole_text
from talkweave.llm.hashing import byte_codes, mixed, powers
from talkweave.llm.suffixblocks import PERIOD, repeated_suffixes

GRAM = 100  # bytes of an anchor where ``length`` is 200; half the length in general
SEGMENT = 1 << 20
CHUNK = 4096
BLOCK_BYTES = 4 << 20
COVER_ROW, FULL = 1, 2  # flags in the low bits of a packed place


def _sliding_smallest(x: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest value (the last of equals) in every window of ``width``."""
    best, span = np.arange(len(x)), 1
    while span < width:
        step = min(span, width - span)
        a, b = best[:-step], best[step:]
        best = np.where(x[b] <= x[a], b, a)
        span += step
    return best


def runs_of(raw: bytes, length: int) -> tuple[np.ndarray, ...]:
    """Runs of a text: anchor hash, hash of the whole run, first position, anchor offset, positions less one."""
    gram = length // 2
    out = []
    for at in range(0, len(raw) - length + 1, SEGMENT):
        data = np.frombuffer(raw, dtype=np.uint8, count=min(SEGMENT + length - 1, len(raw) - at), offset=at)
        up, down = powers(len(data) + 1)
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(byte_codes()[data] * up[:len(data)], out=total[1:])
        grams = mixed((total[gram:] - total[:-gram]) * down[:len(data) - gram + 1])
        anchor = _sliding_smallest(grams, length - gram + 1)
        first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        more = np.concatenate((first[1:], [len(anchor)])) - 1 - first
        place = anchor[first]
        whole = (total[first + more + length] - total[first]) * down[first]
        shape = ((place - first).astype(np.uint64) << np.uint64(32)) | more.astype(np.uint64)
        out.append((grams[place], mixed(whole + mixed(shape)), first + at, place - first, more))
    if not out:
        return tuple(np.zeros(0, dtype=t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out))


def _pack(first: np.ndarray, offset: np.ndarray, more: np.ndarray, flags: np.ndarray | int) -> np.ndarray:
    return (first.astype(np.int64) << 24) | (offset.astype(np.int64) << 13) | (more.astype(np.int64) << 2) | flags


def _unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 24, (place >> 13) & 2047, (place >> 2) & 2047


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans with overlapping and touching ones of a document joined."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    base = np.cumsum(np.concatenate(([0], doc[1:] != doc[:-1]))) * (int(end.max()) + 2)  # keeps documents apart
    reach = np.maximum.accumulate(end + base)
    new = np.concatenate(([True], (start + base)[1:] > reach[:-1]))
    at = np.flatnonzero(new)
    return doc[at], start[at], np.concatenate((reach[at[1:] - 1], reach[-1:])) - base[at]


def _rows(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(np.ascontiguousarray(c).view(np.int64) if getattr(c, "dtype", None) == np.uint64 else c) for c in columns],
                                      names=names.split())


def _find_runs(length: int):
    def emit(keys: list[int], texts: list[bytes]) -> pa.RecordBatch:
        found = [runs_of(t, length) for t in texts]
        doc = np.repeat(np.array(keys, dtype=np.int64), [len(f[0]) for f in found])
        anchor, whole, first, offset, more = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((whole, anchor))
        new = np.concatenate(([True], (anchor[order][1:] != anchor[order][:-1]) | (whole[order][1:] != whole[order][:-1])))[:len(order)]
        count = np.diff(np.concatenate((np.flatnonzero(new), [len(order)])))
        sole = order[new]  # one row for equal runs of the batch
        again = order[np.repeat(count > 1, count)]
        c_doc, c_start, c_end = _merged(doc[again], first[again], first[again] + more[again] + length)
        place = _pack(first[sole], offset[sole], more[sole], np.where(count > 1, FULL, 0))
        cover = mixed(c_doc.view(np.uint64) + c_start.view(np.uint64))
        return _rows("anchor whole doc place", np.concatenate((anchor[sole], cover)), np.concatenate((whole[sole].view(np.int64), c_end)),
                     np.concatenate((doc[sole], c_doc)), np.concatenate((place, (c_start << 24) | COVER_ROW)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, size = [], [], 0
            for key, raw in zip(batch.column("key").to_pylist(), batch.column("raw").to_pylist()):
                keys.append(key)
                texts.append(raw)
                size += len(raw)
                if size >= 2 * SEGMENT:
                    yield emit(keys, texts)
                    keys, texts, size = [], [], 0
            if keys:
                yield emit(keys, texts)

    return run


def _match_runs(length: int):
    """Repeated runs of rows sorted by anchor and whole run, and one slice per different run of the other anchors.

    Rows pass through: held are the first row of the last run and at most ``CHUNK`` first rows of the last anchor's
    other runs, however many rows an anchor has.
    """
    def edges(anchor: np.ndarray, doc: np.ndarray, place: np.ndarray, number: np.ndarray, large: np.ndarray) -> pa.RecordBatch:
        return _rows("kind anchor doc a b", np.ones(len(anchor), dtype=np.int64), anchor, doc, place, (number // CHUNK << 1) | large.astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, dtype=np.int64)
        last = (none, none, none, none)  # first row of the run that may go on; FULL: its span is known
        waiting = (none, none, none)  # anchor, doc and place of earlier runs of that row's anchor
        sent = 0  # runs of that anchor already passed on
        for batch in itertools.chain(batches, [None]):
            rows = last
            if batch is not None:
                read = [batch.column(c).to_numpy() for c in ("anchor", "whole", "doc", "place")]
                spans = (read[3] & COVER_ROW) == 1
                known = (read[2][spans], read[3][spans] >> 24, read[1][spans])
                rows = tuple(np.concatenate((a, b[~spans])) for a, b in zip(last, read))
            anchor, whole, doc, place = rows
            found = known if batch is not None else (none, none, none)
            if len(anchor):
                new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])))
                run_at, run_of = np.flatnonzero(new), np.cumsum(new) - 1
                weight = np.add.reduceat(1 + (place & FULL) // FULL, run_at)
                repeats = (weight[run_of] > 1) & ((place & FULL) == 0)
                first, _, more = _unpack(place[repeats])
                found = _merged(*(np.concatenate(x) for x in zip(found, (doc[repeats], first, first + more + length))))
                marked = (place[run_at] & ~FULL) | np.where(weight > 1, FULL, 0)
                closed = slice(0, len(run_at) - (batch is not None))
                runs = tuple(np.concatenate((w, c[closed])) for w, c in zip(waiting, (anchor[run_at], doc[run_at], marked)))
                last = tuple(c[-1:] for c in (anchor[run_at], whole[run_at], doc[run_at], marked))
                done = runs[0] != last[0][0] if batch is not None else np.ones(len(runs[0]), dtype=bool)
                n = int(done.sum())  # runs are sorted by anchor: the open anchor's are the last
                ended = tuple(c[:n] for c in runs)
                waiting = tuple(c[n:] for c in runs)
                if n:
                    new_key = np.concatenate(([True], ended[0][1:] != ended[0][:-1]))
                    key, key_at = np.cumsum(new_key) - 1, np.flatnonzero(new_key)
                    before = np.where(key == 0, sent, 0)  # only the first of these anchors can have sent runs
                    total = np.bincount(key)[key] + before
                    edge = total > 1
                    yield edges(*(c[edge] for c in (*ended, np.arange(n) - key_at[key] + before, total > CHUNK)))
                    sent = 0
                if len(waiting[0]) > CHUNK:
                    size = len(waiting[0])
                    yield edges(*waiting, sent + np.arange(size), np.ones(size, dtype=bool))
                    sent, waiting = sent + size, (none, none, none)
            yield _rows("kind anchor doc a b", np.zeros(len(found[0]), dtype=np.int64), np.zeros(len(found[0]), dtype=np.int64), *found)

    return run


def _cut_slices(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors, chunks, docs, places, slices = [], [], [], [], []
            for key, raw, asked in zip(batch.column("key").to_pylist(), batch.column("raw").to_pylist(), batch.column("asked").to_pylist()):
                for q in asked:
                    first, more = q["a"] >> 24, (q["a"] >> 2) & 2047
                    anchors.append(q["anchor"])
                    chunks.append(q["b"])
                    docs.append(key)
                    places.append(q["a"])
                    slices.append(raw[first:first + more + length])
            yield _rows("anchor chunk doc place slice", pa.array(anchors, pa.int64()), pa.array(chunks, pa.int64()), pa.array(docs, pa.int64()), pa.array(places, pa.int64()), pa.array(slices, pa.binary()))

    return run


def _sort_block(rows: list[tuple], length: int) -> pa.RecordBatch:
    """Spans repeated inside a block, and for chunks of a large bucket one row per different string."""
    anchor, chunk, doc, place = (np.array(x, dtype=np.int64) for x in zip(*(r[:4] for r in rows)))
    first, offset, more = _unpack(place)
    pieces, start, at = [], [], 0
    for (*_, piece), o in zip(rows, offset.tolist()):
        pad = (-(at + o)) % PERIOD  # anchors stand at multiples of the period
        pieces += [b"\0" * pad, piece]
        start.append(at + pad)
        at += pad + len(piece)
    text = np.frombuffer(b"".join(pieces) + b"\0" * (2 * PERIOD), dtype=np.uint8)
    start = np.array(start, dtype=np.int64)
    end = start + more + length
    n = more + 1
    slice_of = np.repeat(np.arange(len(rows)), n)
    step = np.arange(int(n.sum())) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
    group = np.cumsum(np.concatenate(([0], (anchor[1:] != anchor[:-1]) | (chunk[1:] != chunk[:-1]))))
    bucket = group[slice_of] * 2048 + (offset[slice_of] - step)
    pos = start[slice_of] + step
    order, opens = repeated_suffixes(text, start, end, bucket, pos, length)
    class_of = np.cumsum(opens) - 1
    size = np.bincount(class_of)
    full = (place & FULL) > 0
    hit = np.zeros(len(order), dtype=bool)
    hit[order] = size[class_of] > 1
    mine = np.flatnonzero(hit & ~full[slice_of])
    s = slice_of[mine]
    found = _merged(doc[s], first[s] + step[mine], first[s] + step[mine] + length)
    strings, s_doc, s_start = [], [], []
    for k in order[opens][((chunk & 1) == 1)[slice_of[order[opens]]]].tolist():  # large buckets: one of each class
        piece = slice_of[k]
        strings.append(xxhash.xxh3_128_digest(text[pos[k]:pos[k] + length].tobytes()))
        known = hit[k] or full[piece]
        s_doc.append(-1 if known else int(doc[piece]))
        s_start.append(-1 if known else int(first[piece] + step[k]))
    k, m = len(found[0]), len(strings)
    return _rows("kind string doc a b", np.repeat([0, 1], [k, m]), pa.array([None] * k + strings, pa.binary()), np.concatenate((found[0], np.array(s_doc, dtype=np.int64))),
                 np.concatenate((found[1], np.array(s_start, dtype=np.int64))), np.concatenate((found[2], np.array(s_start, dtype=np.int64) + length)))


def _sort_blocks(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "chunk", "doc", "place", "slice"))):
                if size >= BLOCK_BYTES and row[:2] != held[-1][:2]:
                    yield _sort_block(held, length)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield _sort_block(held, length)

    return run


def _match_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, single = None, None
    for batch in batches:
        found = []
        for string, doc, a, b, unknown in zip(*(batch.column(c).to_pylist() for c in ("string", "doc", "a", "b", "unknown"))):
            if string != last:
                last, single = string, (doc, a, b) if unknown else None
                seen = 1
            else:
                seen += 1
                if seen == 2 and single is not None:
                    found.append(single)
                if unknown:
                    found.append((doc, a, b))
        columns = [np.array([f[i] for f in found], dtype=np.int64) for i in range(3)]
        yield _rows("doc a b", *columns)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    for batch in batches:
        texts, spans = [], []
        for raw, pairs in zip(batch.column("raw").to_pylist(), batch.column("spans").to_pylist()):
            joined: list[list[int]] = []
            for a, b in sorted((p["a"], p["b"]) for p in pairs or ()):
                if joined and a <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], b)
                else:
                    joined.append([a, b])
            at, left = 0, []
            for a, b in joined:
                left.append(raw[at:a])
                at = b
            left.append(raw[at:])
            texts.append(b"".join(left))
            spans.append([{"start": a, "end": b} for a, b in joined])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(map(len, batch.column("raw").to_pylist()), pa.int64()), pa.array(spans, pa.list_(span)), pa.array(texts, pa.binary()),
             pa.array([hashlib.sha256(t).hexdigest() for t in texts])], names=["doc_id", "n_bytes", "removed", "kept", "kept_sha256"])


def remove_repeated_substrings(docs: DataFrame, length: int = 200) -> DataFrame:
    """Every text (UTF-8) without the bytes covered by a string of ``length`` bytes that also starts elsewhere.

    Returns ``doc_id``, ``n_bytes``, ``removed`` (maximal spans as ``start``, ``end`` in bytes, on the input), ``kept``
    (remaining bytes) and ``kept_sha256``. All copies of a repeated string go, overlapping ones included; strings
    never cross documents. A null text is empty; texts shorter than ``length`` stay whole. Ids may be null or
    repeat: rows are then numbered in a written copy of the table, and equal rows are copies of each other.
    Other columns are not read. An empty table gives no rows.
    """
    if not 2 * PERIOD <= length < 2000:
        raise ValueError("length must be from 64 to 1999")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().cast("binary").alias("raw"))
    doubtful = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null or doc_id < 0")
    if doubtful.isEmpty():
        rows = rows.withColumn("key", F.col("doc_id"))
    else:
        rows = kept(rows.withColumn("key", F.monotonically_increasing_id()))
    texts = rows.select("key", "raw")
    runs = texts.mapInArrow(_find_runs(length), "anchor long, whole long, doc long, place long")
    with arrow_rows(spark, 20_000):
        # Only the first stage reads texts here, and it works in portions of its own.
        matched = kept(runs.repartition("anchor").sortWithinPartitions("anchor", "whole").mapInArrow(
            _match_runs(length), "kind long, anchor long, doc long, a long, b long"))
    asked = matched.filter("kind = 1").groupBy(F.col("doc").alias("key")).agg(F.collect_list(F.struct("anchor", "a", "b")).alias("asked"))  # runs of one document
    slices = texts.join(asked, "key").mapInArrow(_cut_slices(length), "anchor long, chunk long, doc long, place long, slice binary")
    sorted_ = kept(slices.repartition("anchor", "chunk").sortWithinPartitions("anchor", "chunk").mapInArrow(
        _sort_blocks(length), "kind long, string binary, doc long, a long, b long"))
    large = (sorted_.filter("kind = 1").select("string", "doc", "a", "b", (F.col("doc") >= 0).alias("unknown"))
             .repartition("string").sortWithinPartitions("string").mapInArrow(_match_strings, "doc long, a long, b long"))
    spans = matched.filter("kind = 0").select("doc", "a", "b").union(sorted_.filter("kind = 0").select("doc", "a", "b")).union(large)
    by_doc = spans.groupBy(F.col("doc").alias("key")).agg(F.collect_list(F.struct("a", "b")).alias("spans"))  # spans of one document
    return rows.join(by_doc, "key", "left").select("doc_id", "raw", "spans").mapInArrow(
        _apply, "doc_id long, n_bytes long, removed array<struct<start: long, end: long>>, kept binary, kept_sha256 string")
