import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from talkweave.llm import suffix, suffixblocks as sb


def brute(texts, length):
    """Removed flags per text."""
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        flags = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                flags[i:i + length] = b"\1" * length
        out.append(bytes(flags))
    return out


def made_texts(seed, n=60, length=64):
    rng = random.Random(seed)
    word = lambda k: bytes(rng.choice(b"abcd ") for _ in range(k))
    passages = [word(rng.randint(length - 5, 3 * length)) for _ in range(6)]
    texts = []
    for _ in range(n):
        t = b"".join(rng.choice([word(rng.randint(0, 90)), rng.choice(passages), rng.choice(passages)[rng.randint(0, 40):]]) for _ in range(rng.randint(0, 6)))
        texts.append(t)
    texts += [b"ab" * 100, b"x" * 63, b"y" * 64, b"z" * 65, b"", texts[3], texts[4] + b"!", passages[0] * 4]
    return texts


def local(texts, length):
    """The stages one after another in this process."""
    batch = lambda cols, names: pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    def ordered(batches, keys):
        t = pa.Table.from_batches(list(batches))
        return t.sort_by([(k, "ascending") for k in keys]).combine_chunks()

    half = len(texts) // 2  # two batches, so that copies also meet across batches
    parts = [batch([list(range(a, b)), texts[a:b]], ["key", "raw"]) for a, b in ((0, half), (half, len(texts)))]
    runs = ordered(suffix._find_runs(length)(iter(parts)), ["anchor", "whole"])
    matched = pa.Table.from_batches(suffix._match_runs(length)(iter(runs.to_batches(max_chunksize=7)))).to_pylist()
    asked = {}
    for r in matched:
        if r["kind"] == 1:
            asked.setdefault(r["doc"], []).append({"anchor": r["anchor"], "a": r["a"], "b": r["b"]})
    wanted = batch([list(asked), [texts[k] for k in asked], list(asked.values())], ["key", "raw", "asked"])
    slices = ordered(suffix._cut_slices(length)(iter([wanted])), ["anchor", "chunk"])
    found = pa.Table.from_batches(suffix._sort_blocks(length)(iter(slices.to_batches(max_chunksize=11)))).to_pylist()
    spans = [(r["doc"], r["a"], r["b"]) for r in [*matched, *found] if r["kind"] == 0]
    strings = sorted([(r["string"], r["doc"], r["a"], r["b"], r["doc"] >= 0) for r in found if r["kind"] == 1])
    if strings:
        got = suffix._match_strings(iter([batch(list(zip(*strings)), ["string", "doc", "a", "b", "unknown"])]))
        spans += [(r["doc"], r["a"], r["b"]) for b in got for r in b.to_pylist()]
    flags = [bytearray(len(t)) for t in texts]
    for doc, a, b in spans:
        flags[doc][a:b] = b"\1" * (b - a)
    return [bytes(f) for f in flags], len(strings)


@pytest.mark.parametrize("seed", range(6))
def test_stages_equal_brute_force(seed):
    texts = made_texts(seed)
    assert local(texts, 64)[0] == brute(texts, 64)


@pytest.mark.parametrize("seed", range(3))
def test_large_buckets_in_chunks(seed, monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK", 2)
    monkeypatch.setattr(suffix, "BLOCK_BYTES", 1)
    texts = made_texts(seed)
    got, strings = local(texts, 64)
    assert got == brute(texts, 64) and strings > 0


def test_segments_of_long_texts(monkeypatch):
    monkeypatch.setattr(suffix, "SEGMENT", 150)
    texts = made_texts(11)
    assert local(texts, 64)[0] == brute(texts, 64)


def test_cover_and_ranks():
    for period in (8, 32, 64, 50):
        cover = sb.difference_cover(period)
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    rng = np.random.default_rng(3)
    text = np.concatenate((rng.integers(97, 99, 700).astype(np.uint8), np.zeros(64, dtype=np.uint8)))
    start, end = np.array([0, 300, 310]), np.array([300, 310, 700])
    ranks = sb.cover_ranks(text, start, end, 400)
    at = np.flatnonzero(ranks)
    stop = end[np.searchsorted(start, at, side="right") - 1]
    strings = [text[a:b].tobytes() for a, b in zip(at, stop)]
    order = {s: k for k, s in enumerate(sorted(set(strings)))}
    assert np.array_equal(np.argsort(np.argsort(np.unique(ranks[at])))[np.searchsorted(np.unique(ranks[at]), ranks[at])], [order[s] for s in strings])


def test_documents(llm_spark, table, odd_rows):
    passage = " ".join(f"passage{i * i}" for i in range(40))
    rows = [*odd_rows, (30, f"{passage} tail", None), (31, f"a head, then {passage}", None), (32, passage[:199], None)]
    got = suffix.remove_repeated_substrings(table(rows)).collect()
    texts = [(t or "").encode() for _, t, _ in rows]
    want = []
    for (i, _, _), t, f in zip(rows, texts, brute(texts, 200)):
        left = bytes(x for x, y in zip(t, f) if not y)
        want.append((i, len(t), sum(f), hashlib.sha256(left).hexdigest()))
    assert sorted([(r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.removed), r.kept_sha256) for r in got], key=str) == sorted(want, key=str)
    distinct = [(i, t, s) for i, t, s in rows if i is not None and (i, t) != (6, rows[6][1])]
    assert suffix.remove_repeated_substrings(table(distinct)).count() == len(distinct)
    assert suffix.remove_repeated_substrings(table([])).count() == 0


@pytest.mark.parametrize("different, copies", [(50_000, 0), (3, 50_000), (1, 50_000), (suffix.CHUNK, 1), (suffix.CHUNK + 1, 0), (1, 0)])
def test_rows_of_a_hot_anchor_pass_through(different, copies):
    """One anchor with many different runs, or with many rows of one run, between two small anchors."""
    length, size = 64, 1000
    runs = [(5, 1), (5, 1), (5, 2)] + [(7, w) for w in range(different) for _ in range(1 + (copies if w == 0 else 0))] + [(9, 1)]
    place = suffix._pack(np.arange(len(runs)) * 100, np.zeros(len(runs), dtype=np.int64), np.zeros(len(runs), dtype=np.int64), 0)
    columns = [np.array([r[0] for r in runs]), np.array([r[1] for r in runs]), np.arange(len(runs)), place]
    read = 0

    def batches():
        nonlocal read
        for i in range(0, len(runs), size):
            read = i + size
            yield pa.RecordBatch.from_arrays([pa.array(c[i:i + size]) for c in columns], names=["anchor", "whole", "doc", "place"])

    rows, given = [], 0
    for out in suffix._match_runs(length)(batches()):
        rows += out.to_pylist()
        given += out.num_rows
        if copies == 0 and read < len(runs):
            assert read - given <= suffix.CHUNK + 2 * size  # what has not been given yet is bounded
    count = Counter(runs)
    assert sorted(r["doc"] for r in rows if r["kind"] == 0) == [i for i, r in enumerate(runs) if count[r] > 1]
    firsts = {r: i for i, r in reversed(list(enumerate(runs)))}
    several = {a for a, _ in runs if len({w for b, w in count if a == b}) > 1} if different < 100 else {5, 7}
    edge = [r for r in rows if r["kind"] == 1]
    assert sorted(r["doc"] for r in edge) == sorted(i for (a, _), i in firsts.items() if a in several)
    assert all(((r["a"] & suffix.FULL) > 0) == (count[runs[r["doc"]]] > 1) for r in edge)
    hot = [r["b"] for r in edge if r["anchor"] == 7]
    assert all(b & 1 == (different > suffix.CHUNK) for b in hot)
    assert not hot or max(Counter(hot).values()) <= suffix.CHUNK
    assert all(r["b"] == 0 for r in edge if r["anchor"] == 5)
