"""Cross-tokenizer alignment by an associative monoid of fragments.

Two tokenizers cut the same bytes (a space, then the text). Where a token of each ends at the same byte, a
group ends. A byte range of a text yields a fragment: an open prefix (tokens up to the first common end,
whose group may have begun further left), closed groups, and an open suffix (tokens after the last common
end). Fragments compose associatively: the left one's suffix and the right one's prefix close one group. So
the ranges of a very long text are tokenized by several tasks and reduced in a tree of bounded fan-in.

A single space between two characters that are no blanks ends a token of both vocabularies, so what stands
between two such spaces (a unit) is aligned once per worker and remembered. A range may begin or end inside
a unit: both neighbours tokenize that unit and each keeps the tokens that end in its own range.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from talkweave.llm.common import arrow_rows, kept, whole_text
from talkweave.llm.encoding import AGREED, _BYTES, _Known, Encoder

SAFE = regex.compile(r"(?<=[\p{L}\p{N}!-~]) (?=[\p{L}\p{N}!-~])")
RANGE_BYTES = 1 << 16
FAN_IN = 16
REMEMBERED = 400_000


class Fragment(NamedTuple):
    """``closed`` is rendered ("a1,a2|b1;a3|b2,b3"), ``links`` holds pair numbers as little-endian 32-bit
    integers. Without a common end (``cut`` false) all tokens are in the prefix."""

    a_pre: tuple[int, ...] = ()
    b_pre: tuple[int, ...] = ()
    cut: bool = False
    closed: bytes = b""
    links: bytes = b""
    a_suf: tuple[int, ...] = ()
    b_suf: tuple[int, ...] = ()
    n_a: int = 0
    n_b: int = 0
    same: bool = True  # both tokenizers give the text's own bytes


@dataclass(frozen=True)
class Vocabularies:
    """Token bytes of both sides, and a number for every pair that can end together.

    The bytes of two tokens that end at one byte are one the suffix of the other, so there are no more pairs
    than bytes in both vocabularies: a bound that does not depend on the corpus.
    """

    a: dict[int, bytes]
    b: dict[int, bytes]
    pairs: np.ndarray  # (a, b) in order of their numbers

    def keys(self) -> np.ndarray:
        """A pair's ids in one number; a pair's own number is its place among them."""
        return self.pairs[:, 0] << 32 | self.pairs[:, 1]


def vocabularies(a_path: str, b_path: str) -> Vocabularies:
    import sentencepiece
    from tokenizers import Tokenizer

    byte_of = {c: b for b, c in _BYTES.items()}
    a = {i: bytes(byte_of[c] for c in s) if all(c in byte_of for c in s) else s.encode() for s, i in Tokenizer.from_file(a_path).get_vocab().items()}
    pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
    b = {}
    for i in range(pieces.get_piece_size()):
        if not (pieces.is_control(i) or pieces.is_unknown(i)):
            piece = pieces.id_to_piece(i)
            b[i] = bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else piece.replace("▁", " ").encode()
    by_a: dict[bytes, list[int]] = {}
    by_b: dict[bytes, list[int]] = {}
    for side, names in ((a, by_a), (b, by_b)):
        for i, raw in side.items():
            names.setdefault(raw, []).append(i)
    found = {(i, j) for i, raw in a.items() for k in range(len(raw)) for j in by_b.get(raw[k:], ())}
    found |= {(i, j) for j, raw in b.items() for k in range(1, len(raw)) for i in by_a.get(raw[k:], ())}
    return Vocabularies(a, b, np.array(sorted(found), dtype=np.int64).reshape(-1, 2))


def render(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> bytes:
    """Groups whose last tokens stand before the places ``ends_a`` and ``ends_b``: "a1,a2|b1;a3|b2,b3"."""
    if not len(ends_a):
        return b""
    group_a = np.repeat(np.arange(len(ends_a)), np.diff(ends_a, prepend=0))
    group_b = np.repeat(np.arange(len(ends_b)), np.diff(ends_b, prepend=0))
    # In a group the tokens of a come first; all tokens of earlier groups stand before them.
    at_a = np.arange(len(group_a)) + np.concatenate(([0], ends_b[:-1]))[group_a]
    at_b = np.arange(len(group_b)) + ends_a[group_b]
    ids, sign = np.empty(len(at_a) + len(at_b), dtype=np.int64), np.full(len(at_a) + len(at_b), ord(","), dtype=np.uint8)
    ids[at_a], ids[at_b] = a[:len(at_a)], b[:len(at_b)]
    sign[at_a[ends_a - 1]], sign[at_b[ends_b - 1]] = ord("|"), ord(";")
    digits, width = _decimals(1 << max(16, int(ids.max()).bit_length()))
    shown = np.empty((len(ids), digits.shape[1] + 1), dtype=np.uint8)
    shown[:, :-1] = digits[ids]
    long = width[ids]
    shown[np.arange(len(ids)), long] = sign
    return shown[np.arange(shown.shape[1]) <= long[:, None]].tobytes()[:-1]


@cache
def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of the numbers below ``n``, left-aligned, and how many there are."""
    text = np.arange(n).astype(f"S{len(str(n - 1))}")
    return text.view(np.uint8).reshape(n, -1), np.char.str_len(text)


class Aligner:
    """Fragments of texts and byte ranges; one per worker and pair of vocabularies."""

    def __init__(self, a_path: str, b_path: str, remembered: int = REMEMBERED) -> None:
        import sentencepiece

        v = self.vocabularies = vocabularies(a_path, b_path)
        self.a, self.b = ([side.get(i, b"") for i in range(max(side) + 1)] for side in (v.a, v.b))
        self.size_a, self.size_b = (np.array(list(map(len, side))) for side in (self.a, self.b))
        self.keys = v.keys()
        self.encoder = Encoder(a_path, units=0)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        # Units are only independent if no token holds a blank after a character.
        self.cuts = self.encoder.by_word and not any(b" " in raw.lstrip(b" ") for raw in self.b)
        self.plain = _Known(self._plain_unit, remembered)
        self.other = _Known(self._unit, remembered // 10)

    def _pieces(self, unit: str) -> bytes:
        return np.array(self.pieces.encode(unit), dtype="<u4").tobytes()

    def _plain_unit(self, unit: str) -> tuple[bytes, bytes]:
        return self.encoder._after_space(unit), self._pieces(unit)

    def _unit(self, unit: str) -> tuple[bytes, bytes]:
        return self.encoder.encode(" " + unit), self._pieces(unit)

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a space and the text by both tokenizers; units are looked up where they were seen before."""
        if not self.cuts:
            parts = [self._unit(text)]
        elif AGREED.fullmatch(text) and not (text[0] == " " or text[-1] == " " or "  " in text or " \n" in text or " \t" in text or " \r" in text):
            parts = list(map(self.plain.__getitem__, text.split(" ")))
        else:
            parts = list(map(self.other.__getitem__, SAFE.split(text)))
        a, b = zip(*parts)
        return tuple(np.frombuffer(b"".join(side), dtype="<u4").astype(np.int64) for side in (a, b))

    def links(self, a: np.ndarray, b: np.ndarray) -> bytes:
        """Numbers of pairs of ids."""
        return np.searchsorted(self.keys, a << 32 | b).astype("<i4").tobytes()

    def fragment(self, text: str, first: int = 0, last: int | None = None) -> Fragment:
        """Of the tokens of a space and ``text`` whose ends lie in ``(first, last]``, counted in bytes."""
        raw = b" " + text.encode()
        a, b = self.tokens(text)
        if b"".join(map(self.a.__getitem__, a.tolist())) != raw or b"".join(map(self.b.__getitem__, b.tolist())) != raw:
            return Fragment(same=False)
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        if first > 0 or last is not None:
            last = len(raw) if last is None else last
            here_a, here_b = (slice(*np.searchsorted(e, [first, last], side="right")) for e in (end_a, end_b))
            a, end_a, b, end_b = a[here_a], end_a[here_a], b[here_b], end_b[here_b]
        at = np.searchsorted(end_b, end_a)
        last_a = np.flatnonzero(np.append(end_b, -1)[at] == end_a)  # where both end
        last_b = at[last_a]
        if not len(last_a):
            return Fragment(tuple(a.tolist()), tuple(b.tolist()), n_a=len(a), n_b=len(b))
        x, y, ends_a, ends_b = last_a[0] + 1, last_b[0] + 1, last_a[1:] + 1, last_b[1:] + 1
        return Fragment(tuple(a[:x].tolist()), tuple(b[:y].tolist()), True, render(a[x:], b[y:], ends_a - x, ends_b - y),
                        self.links(a[last_a[1:]], b[last_b[1:]]), tuple(a[last_a[-1] + 1:].tolist()), tuple(b[last_b[-1] + 1:].tolist()), len(a), len(b))

    def compose(self, left: Fragment, right: Fragment) -> Fragment:
        """Associative; the empty fragment is neutral."""
        n_a, n_b, same = left.n_a + right.n_a, left.n_b + right.n_b, left.same and right.same
        if not left.cut:
            return right._replace(a_pre=left.a_pre + right.a_pre, b_pre=left.b_pre + right.b_pre, n_a=n_a, n_b=n_b, same=same)
        a, b = left.a_suf + right.a_pre, left.b_suf + right.b_pre
        if not right.cut:
            return left._replace(a_suf=a, b_suf=b, n_a=n_a, n_b=n_b, same=same)
        group = f"{','.join(map(str, a))}|{','.join(map(str, b))}".encode()
        link = self.links(np.array(a[-1:]), np.array(b[-1:]))
        return Fragment(left.a_pre, left.b_pre, True, b";".join([g for g in (left.closed, group, right.closed) if g]), left.links + link + right.links,
                        right.a_suf, right.b_suf, n_a, n_b, same)

    def whole(self, fragment: Fragment) -> Fragment:
        """A whole text's fragment with its prefix closed, which is a group of its own; empty if the bytes of
        a side differ from the text's."""
        return self.compose(Fragment(cut=True), fragment) if fragment.same and fragment.cut else Fragment(same=False)


def ranges(text: str, size: int) -> list[tuple[str, int, int]]:
    """(piece, first, last) for ranges of about ``size`` bytes; a piece is whole units without their first space.

    A range edge inside a unit of more than ``size`` bytes moves to that unit's end, so no unit is
    tokenized by more than two tasks.
    """
    raw = b" " + text.encode()
    starts = np.flatnonzero((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)  # of characters
    cuts = np.array([0, *(int(starts[m.start() + 1]) for m in SAFE.finditer(text)), len(raw)])
    edges = np.arange(size, len(raw), size)
    unit = np.searchsorted(cuts, edges, side="right") - 1
    long = cuts[unit + 1] - cuts[unit] > size
    edges = np.unique(np.concatenate(([0], np.where(long, cuts[unit + 1], edges), [len(raw)])))
    out = []
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
        begin = int(cuts[np.searchsorted(cuts, lo, side="right") - 1])
        end = int(cuts[np.searchsorted(cuts, hi)])
        out.append((raw[begin + 1:end].decode(), lo - begin, hi - begin))
    return out


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


_FRAGMENT = ("row long, doc_id long, part long, a_pre array<int>, b_pre array<int>, cut boolean, closed binary, links binary, "
             "a_suf array<int>, b_suf array<int>, n_a long, n_b long, same boolean")
_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, groups binary, links binary, groups_sha256 string"


def _fragment_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * 3 + [pa.list_(pa.int32())] * 2 + [pa.bool_()] + [pa.binary()] * 2 + [pa.list_(pa.int32())] * 2 + [pa.int64()] * 2 + [pa.bool_()]
    names = ["row", "doc_id", "part", *Fragment._fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)


def _aligned_batch(ids: list[int | None], found: list[Fragment], groups: bool) -> pa.RecordBatch:
    n = [len(j.links) // 4 for j in found]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array([j.n_a for j in found], pa.int64()), pa.array([j.n_b for j in found], pa.int64()), pa.array(n, pa.int64()),
         pa.array([j.closed if groups else None for j in found], pa.binary()), pa.array([j.links for j in found], pa.binary()),
         pa.array([sha256(j.closed).hexdigest() if j.closed else "" for j in found], pa.string())],
        names=["doc_id", "n_a", "n_b", "n_groups", "groups", "links", "groups_sha256"])


def _whole_texts(a_path: str, b_path: str, groups: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = aligner(a_path, b_path)
        for batch in batches:
            yield _aligned_batch(batch.column("doc_id").to_pylist(), [of.whole(of.fragment(t)) if t else Fragment() for t in batch.column("text").to_pylist()], groups)

    return run


def _ranges_of(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text"))):
                for part, (piece, first, last) in enumerate(ranges(text, size)):
                    yield pa.RecordBatch.from_pylist([{"row": row, "doc_id": doc_id, "part": part, "piece": piece, "first": first, "last": last}],
                                                     schema=pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int64()), ("piece", pa.string()),
                                                                       ("first", pa.int64()), ("last", pa.int64())]))

    return run


def _range_fragments(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = aligner(a_path, b_path)
        for batch in batches:
            for r in batch.to_pylist():
                yield _fragment_batch([(r["row"], r["doc_id"], r["part"], *of.fragment(r["piece"], r["first"], r["last"]))])

    return run


def _composed(a_path: str, b_path: str):
    def run(table: pa.Table) -> pa.Table:
        of = aligner(a_path, b_path)
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        one = reduce(of.compose, [Fragment(*(tuple(r[f]) if isinstance(r[f], list) else r[f] for f in Fragment._fields)) for r in rows])
        return pa.Table.from_batches([_fragment_batch([(rows[0]["row"], rows[0]["doc_id"], rows[0]["part"] // FAN_IN, *one)])])

    return run


def _finished(a_path: str, b_path: str, groups: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = aligner(a_path, b_path)
        for batch in batches:
            rows = batch.to_pylist()
            if rows:
                yield _aligned_batch([r["doc_id"] for r in rows],
                                     [of.whole(Fragment(*(tuple(r[f]) if isinstance(r[f], list) else r[f] for f in Fragment._fields))) for r in rows], groups)

    return run


def align(docs: DataFrame, a_path: str, b_path: str, range_bytes: int = RANGE_BYTES, groups: bool = True) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``groups`` (rendered;
    null unless asked for), ``links`` (pair numbers, one per group, in order), ``groups_sha256``.

    Rows without tokens (null, empty, or bytes of a side that differ from the text's) have zeros, no
    links and ''. Rows that repeat an id are aligned one by one. Texts of more than ``range_bytes`` are cut
    into ranges, dealt to all tasks and reduced ``FAN_IN`` at a time. Other columns are not read. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    is_long = F.octet_length("text") >= range_bytes
    short = rows.filter(~is_long).mapInArrow(_whole_texts(a_path, b_path, groups), _ALIGNED)
    long = rows.filter(is_long).withColumn("row", F.monotonically_increasing_id())
    with arrow_rows(spark, 8):
        pieces = long.mapInArrow(_ranges_of(range_bytes), "row long, doc_id long, part long, piece string, first long, last long")
        fragments = kept(pieces.repartition("row", "part").mapInArrow(_range_fragments(a_path, b_path), _FRAGMENT))
    most = fragments.agg(F.max("part")).first()[0]
    while most:
        fragments = kept(fragments.groupBy("row", F.floor(F.col("part") / FAN_IN)).applyInArrow(_composed(a_path, b_path), _FRAGMENT))
        most //= FAN_IN
    return short.unionByName(fragments.mapInArrow(_finished(a_path, b_path, groups), _ALIGNED))


def link_counts(aligned: DataFrame, n_pairs: int) -> np.ndarray:
    """How often each pair is linked; tasks add up their rows first, and at most ``n_pairs`` sums come together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_pairs, dtype=np.int64)
        for batch in batches:
            links = np.frombuffer(b"".join(x for x in batch.column("links").to_pylist() if x), dtype="<i4")
            total += np.bincount(links, minlength=n_pairs)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["pair", "n"])

    found = aligned.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(n_pairs, dtype=np.int64)
    counts[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return counts


def best_links(counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Whether a pair's count is the highest of its b id."""
    highest = np.zeros(int(pairs[:, 1].max(initial=0)) + 1, dtype=np.int64)
    np.maximum.at(highest, pairs[:, 1], counts)
    return (counts == highest[pairs[:, 1]]) & (counts > 0)


def with_link_statistics(aligned: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Add ``n_links``, ``n_best`` (links whose pair is its b id's most frequent, ties included) and
    ``count_sum`` (of the pairs' counts over the links). ``aligned`` is read twice."""
    found = vocabularies(a_path, b_path)
    pairs = found.pairs
    counts = link_counts(aligned, len(pairs))
    context = aligned.sparkSession.sparkContext
    shared = context.broadcast((counts, best_links(counts, pairs)))  # at most as many entries as both vocabularies have bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = shared.value
        for batch in batches:
            rows = batch.column("links").to_pylist()
            links = [np.frombuffer(x or b"", dtype="<i4") for x in rows]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept_columns), pa.array([len(x) for x in links], pa.int64()),
                 pa.array([int(best[x].sum()) for x in links], pa.int64()), pa.array([int(counts[x].sum()) for x in links], pa.int64())],
                names=[*kept_columns, "n_links", "n_best", "count_sum"])

    kept_columns = [c for c in aligned.columns]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in aligned.schema.fields)
    return aligned.mapInArrow(run, f"{schema}, n_links long, n_best long, count_sum long")


def pair_counts(spark: SparkSession, aligned: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``a_id``, ``b_id``, ``n`` of every linked pair: a translation table between the vocabularies."""
    pairs = vocabularies(a_path, b_path).pairs
    counts = link_counts(aligned, len(pairs))
    seen = np.flatnonzero(counts)
    return spark.createDataFrame(pa.table({"a_id": pairs[seen, 0], "b_id": pairs[seen, 1], "n": counts[seen]}), "a_id long, b_id long, n long")


def align_corpus(docs: DataFrame, a_path: str, b_path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``align`` and ``with_link_statistics`` in one: the alignment is written once and read again."""
    return with_link_statistics(kept(align(docs, a_path, b_path, range_bytes, groups=False).drop("groups")), a_path, b_path)
