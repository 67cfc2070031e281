"""Substring deduplication by hashing lines, paragraphs or sentences.

Texts are cut into units that keep their offsets; the normalised unit is hashed, the earliest ranked
occurrence of a hash over all documents stays, all others go. Before the shuffle by hash every task
reduces its rows to the earliest per hash, so a unit that a third of all documents share costs no more
than another. The units that stay then meet their documents by document, never by hash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from talkweave.llm.common import whole_text

#: Where a text may be cut: what stands before the place belongs to the earlier unit.
BREAKS = {"line": re.compile(r"(?<=\n)"), "paragraph": re.compile(r"(?<=\n\n)(?!\n)"), "sentence": re.compile(r"(?<=\n)|(?<=[.!?] )")}


#: Units of more words are cut further where the content says so, so that passages without sentence ends
#: align too: after a blank that follows one of every second letter or digit.
LONGEST = 50
EVERY_SECOND = "acegikmoqsuwyACEGIKMOQSUWY02468"
CONTENT = re.compile(f"(?<=[{EVERY_SECOND}][\\x20\\x09-\\x0D])")


def units_of(text: str, unit: str) -> list[str]:
    out = []
    for u in BREAKS[unit].split(text):
        long = len(u) > 2 * LONGEST and len(u.encode("utf-8", "surrogatepass").split()) > LONGEST
        out += CONTENT.split(u) if long else [u]
    return [u for u in out if u]


def unit_hashes(units: list[str], min_words: int) -> list[bytes]:
    """128-bit hash of each unit without regard to case and blanks.

    A unit of fewer than ``min_words`` words says little by itself: it is hashed with the units before and
    after it, so it counts as repeated where its surroundings are.
    """
    norms = [b" ".join(u.lower().encode("utf-8", "surrogatepass").split()) for u in units]
    out = []
    for i, norm in enumerate(norms):
        if norm.count(b" ") + 1 < min_words or not norm:
            norm = b"\n".join((b"", norms[i - 1] if i else b"", norm, norms[i + 1] if i + 1 < len(norms) else b""))
        out.append(xxhash.xxh3_128_digest(norm))
    return out


def _hash_units(unit: str, min_words: int):
    names = ["hash", "doc_id", "digest", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            earliest: dict[bytes, tuple] = {}
            for doc, digest, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "digest", "text"))):
                for at, h in enumerate(unit_hashes(units_of(text, unit), min_words)):
                    rank = (doc is not None, doc or 0, digest, at, doc)
                    if h not in earliest or rank < earliest[h]:
                        earliest[h] = rank
            ranks = list(earliest.values())
            yield pa.RecordBatch.from_arrays([pa.array(earliest.keys(), pa.binary()), pa.array([r[4] for r in ranks], pa.int64()), pa.array([r[2] for r in ranks], pa.int64()),
                                              pa.array([r[3] for r in ranks], pa.int32())], names=names)

    return run


def _rebuild(unit: str):
    names = ["doc_id", "text", "n_units", "n_removed", "removed_chars", "removed"]
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def one(text: str, stay: list[int] | None):
        units, firsts = units_of(text, unit), set(stay or ())
        left, spans, at, gone = [], [], 0, 0
        for i, u in enumerate(units):
            if i in firsts:
                left.append(u)
            else:
                gone += 1
                if spans and spans[-1][1] == at:
                    spans[-1][1] = at + len(u)
                else:
                    spans.append([at, at + len(u)])
            at += len(u)
        return "".join(left), len(units), gone, sum(b - a for a, b in spans), [{"start": a, "end": b} for a, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(t, s) for t, s in zip(batch.column("text").to_pylist(), batch.column("stay").to_pylist())]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(span)))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=names)

    return run


def remove_repeats(docs: DataFrame, unit: str = "sentence", min_words: int = 5) -> DataFrame:
    """Every text without the units that occur earlier, by (``doc_id``, position), in any document.

    Returns ``doc_id``, ``text`` (what is left), ``n_units``, ``n_removed``, ``removed_chars`` and ``removed``: maximal
    removed spans as (``start``, ``end``) in characters of the original text. ``unit`` is "line", "paragraph" or
    "sentence" (lines cut further after . ! ? and a space); units of more than ``LONGEST`` words are cut again at
    content-defined places, and each piece is a unit. Units count as equal without regard to case and
    ASCII blanks; a unit of fewer than ``min_words`` words is equal to another if the units before and after
    are too (none counts as blank), whatever their length. A null text is empty and has no units.
    Ids that are null rank first. Rows that repeat an id and its text are one document and get the same
    result; with different texts they rank by a hash of the text. Other columns are not read; an empty
    table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).withColumn("digest", F.xxhash64("text"))
    found = rows.mapInArrow(_hash_units(unit, min_words), "hash binary, doc_id long, digest long, at int")
    first = found.groupBy("hash").agg(F.min(F.struct("doc_id", "digest", "at")).alias("w"))
    stays = first.groupBy(F.col("w.doc_id").alias("_i"), F.col("w.digest").alias("_d")).agg(F.collect_list("w.at").alias("stay"))  # positions in one document
    met = rows.join(stays, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("digest") == F.col("_d")), "left").select("doc_id", "text", "stay")
    return met.mapInArrow(_rebuild(unit), "doc_id long, text string, n_units long, n_removed long, removed_chars long, "
                          "removed array<struct<start: long, end: long>>")
