"""Document fingerprints: bottom-k sketches of word shingle hashes.

A sketch holds the ``SIZE`` smallest distinct 48-bit hashes of a document's shingles, written as 12
hex digits each in ascending order. Sketches of parts merge into that of the whole; two sketches
give resemblance and containment, one the number of distinct shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from talkweave.llm.common import partitions_of, whole_text
from talkweave.llm.hashing import bounds_by_text, word_hashes, mixed

SIZE = 128
SHINGLE = 5
BITS = 48


def _factors(n: int) -> np.ndarray:
    """Odd factors for the places of ``n`` words."""
    return np.array([0x9E3779B97F4A7C15 * (2 * k + 1) & (2**64 - 1) for k in range(n)], dtype=np.uint64)


def sketches(texts: Sequence[str], size: int = SIZE, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Bottom-``size`` hashes of every text. ASCII letters count without case; words are runs of
    non-blanks. A text of fewer words than a shingle is one shingle; one without words has none."""
    if shingle < 1 or size < 1:
        raise ValueError("a shingle has one word at least, and a sketch one hash")
    factors = _factors(shingle)
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    starts, words = word_hashes(raw)
    edges = bounds_by_text(raw, starts)
    n = len(words) - shingle + 1
    joined = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(shingle):
        if n > 0:
            joined += words[k:k + n] * factors[k]
    joined = mixed(joined) >> np.uint64(64 - BITS)
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a >= shingle:
            out.append(np.unique(joined[a:b - shingle + 1])[:size])
        elif b > a:
            out.append(mixed((words[a:b] * factors[:b - a]).sum(keepdims=True) + np.uint64(b - a)) >> np.uint64(64 - BITS))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def to_hex(sketch: np.ndarray) -> str:
    return sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BITS // 8:].tobytes().hex()


def from_hex(text: str) -> np.ndarray:
    step = BITS // 4
    return np.array([int(text[i:i + step], 16) for i in range(0, len(text), step)], dtype=np.uint64)


def merge(sketch: np.ndarray, other: np.ndarray, size: int = SIZE) -> np.ndarray:
    return np.union1d(sketch, other)[:size]


def distinct_shingles(sketch: np.ndarray, size: int = SIZE) -> float:
    """Exact below ``size``; else (size - 1) over the share of the hash range the sketch spans."""
    return float(len(sketch)) if len(sketch) < size else (size - 1) * 2.0**BITS / float(sketch[-1] + np.uint64(1))


def resemblance(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Share of the union's sketch that both have; two empty sketches are alike (1.0)."""
    union = merge(a, b, size)
    if not len(union):
        return 1.0
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.count_nonzero(both <= union[-1])) / len(union)


def containment(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated share of a's shingles that b has; 1.0 for an a without shingles."""
    if not len(a):
        return 1.0
    whole = min(a[-1] if len(a) >= size else 2**BITS, b[-1] if len(b) >= size else 2**BITS)
    mine = a[a <= whole]
    return float(np.isin(mine, b).mean()) if len(mine) else 0.0


def document_sketches(docs: DataFrame, size: int = SIZE, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``n_chars``, ``fingerprint``, ``distinct_shingles`` of every row. A null text is empty;
    rows that repeat an id are sketched one by one; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [s for part in _portions(texts) for s in sketches(part, size, shingle)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(map(to_hex, found), pa.string()),
                 pa.array([distinct_shingles(s, size) for s in found], pa.float64())],
                names=["doc_id", "n_chars", "fingerprint", "distinct_shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_chars long, fingerprint string, distinct_shingles double")


def merge_fingerprints(parts: DataFrame, key: str, size: int = SIZE) -> DataFrame:
    """One fingerprint per ``key`` from those of its parts, whatever their number: hashes are made
    distinct by key, and ranking passes on at most ``size`` of a key from every task. Null is a key like
    any other; a key whose parts have no shingles gets an empty fingerprint."""
    step = BITS // 4
    at = F.sequence(F.lit(0), F.floor(F.length("fingerprint") / step).cast("int") - 1)
    pieces = F.when(F.length("fingerprint") > 0, F.transform(at, lambda i: F.substring(F.col("fingerprint"), i * step + 1, F.lit(step))))
    hashes = parts.select(key, F.explode(pieces).alias("_h")).distinct()
    first = hashes.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("_h"))).filter(F.col("_r") <= size)
    merged = first.groupBy(key).agg(F.concat_ws("", F.sort_array(F.collect_list("_h"))).alias("fingerprint"))
    found = merged.withColumnRenamed(key, "_key")
    return parts.select(key).distinct().join(found, F.col(key).eqNullSafe(F.col("_key")), "left").select(key, F.coalesce("fingerprint", F.lit("")).alias("fingerprint"))


def _portions(texts: list[str], limit: int = 2 << 20) -> Iterator[list[str]]:
    """Consecutive texts of about ``limit`` characters together."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def _next_to(docs: DataFrame, partitions: int) -> DataFrame:
    """Rows dealt by ranges of ``doc_id`` so that partition b also has, as a guest, the first row of the
    range after it (after the last: of the first). Columns ``_key``, ``doc_id``, ``text``, ``_guest``, sorted.

    The driver sees one split value and one first id per partition, never documents.
    """
    low = -(1 << 63)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(low)).alias("_key"), F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    ids = rows.select("_key")
    shares = [k / partitions for k in range(1, partitions)]
    found = ids.agg(F.percentile_approx("_key", F.lit(shares) if shares else F.lit([0.5]), F.lit(20 * partitions)).alias("s")).first()["s"]
    splits = np.array(sorted(set(found or [])), dtype=np.int64)

    @F.pandas_udf("int")
    def bucket(key):
        import pandas as pd

        return pd.Series(np.searchsorted(splits, key.to_numpy(), side="right").astype(np.int32))

    firsts = sorted((r["b"], r["k"]) for r in ids.groupBy(bucket("_key").alias("b")).agg(F.min("_key").alias("k")).collect())
    before = {k: firsts[i - 1][0] for i, (_, k) in enumerate(firsts)}  # i = 0: the last range

    @F.pandas_udf("array<int>")
    def places(key):
        import pandas as pd

        home = np.searchsorted(splits, key.to_numpy(), side="right")
        return pd.Series([[2 * h] if (g := before.get(k)) is None else [2 * h, 2 * g + 1] for h, k in zip(home.tolist(), key.tolist())])

    dealt = rows.withColumn("_place", F.explode(places("_key"))).withColumn("_guest", F.col("_place") % 2 == 1)
    return dealt.repartitionById(len(splits) + 1, F.expr("_place div 2").cast("int")).drop("_place").sortWithinPartitions("_guest", "_key", "text")


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many leading ones of ``following``."""
    k = len(text) // 4
    return text[:len(text) - k] + following[:k]


def neighbour_fingerprints(docs: DataFrame, size: int = SIZE, shingle: int = SHINGLE) -> DataFrame:
    """Fingerprints of every document and of its edited text, in ascending ``doc_id``.

    Returns ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``,
    ``near_next`` and ``distinct_shingles``. The document after the last is the first, so a lone one follows
    itself. Null ids come first, rows that repeat an id follow each other by text. A null text is empty. An
    empty table gives no rows. Other columns are not read. Texts are shuffled once.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "distinct_shingles"]

    def compare(rows: list[tuple[int, str]], last: str) -> pa.RecordBatch:
        texts = [t for _, t in rows]
        after = [*texts[1:], last]
        changed = [edited(t, n) for t, n in zip(texts, after)]
        found = [s for part in _portions([*texts, last]) for s in sketches(part, size, shingle)]
        other = [s for part in _portions(changed) for s in sketches(part, size, shingle)]
        return pa.RecordBatch.from_arrays([
            pa.array([k for k, _ in rows], pa.int64()), pa.array(map(len, texts), pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
            pa.array(map(to_hex, found[:-1]), pa.string()), pa.array(map(to_hex, other), pa.string()),
            pa.array([resemblance(a, b, size) for a, b in zip(found, other)], pa.float64()),
            pa.array([resemblance(a, b, size) for a, b in zip(found, found[1:])], pa.float64()),
            pa.array([distinct_shingles(s, size) for s in found[:-1]], pa.float64())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, str]] = []
        guest = None
        for batch in batches:
            flags = batch.column("_guest").to_pylist()
            for key, text, is_guest in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), flags):
                if not is_guest:
                    held.append((key, text))
                elif guest is None:
                    guest = text
            if len(held) > 1:
                yield compare(held[:-1], held[-1][1])
                held = held[-1:]
        if held:
            yield compare(held, guest)

    schema = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double, distinct_shingles double")
    return _next_to(docs, partitions_of(docs)).select("doc_id", "text", "_guest").mapInArrow(run, schema)
