"""Near-duplicates at a resemblance of 0.8 against all pairs."""

import random

import numpy as np
import pytest
from test_queries_and_pipeline import near_groups

import corpus_pipeline
from talkweave.llm import resemblance as rs, simhash as sh


def edited(rng, words, share):
    return [rng.choice("xyzuvw") + str(rng.randrange(10**6)) if rng.random() < share else w for w in words]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    out, shared = [], " ".join(f"licence{i}" for i in range(80))
    for _ in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 400))]
        out.append(" ".join(words))
        out += [" ".join(edited(rng, words, share)) for share in (0.002, 0.01, 0.02, 0.05, 0.2)]
        out.append(shared + " " + " ".join(edited(rng, words[:100], 1.0)))  # a long passage in common is no copy
    base = [f"h{rng.randrange(900)}" for _ in range(300)]
    return out + [" ".join(edited(rng, base, 0.005)) for _ in range(400)]


def test_groups_equal_all_pairs(table, texts):
    got = {r.doc_id: r.component_id for r in rs.near_duplicates(table([(i, t, "a") for i, t in enumerate(texts)])).collect()}
    want, pairs = near_groups(texts)
    assert len(pairs) > 1000
    assert [got[i] for i in range(len(texts))] == want


def test_links_are_right_and_join_every_pair(table, texts):
    sets = rs.shingle_sets(table([(i, t, "a") for i, t in enumerate(texts)]))
    number = {r.row: r.doc_id for r in sets.select("row", "doc_id").collect()}
    got = {tuple(sorted((number[r.left], number[r.right]))) for r in rs.near_links(sets).collect()}
    _, pairs = near_groups(texts)
    assert got <= set(pairs) and len(got) < 8 * len(texts)


def test_odd_rows(table, odd_rows):
    rows = [*odd_rows, (9, "One  TWO three four five six\tseven.", "c"), (10, "alone", "c"), (11, "ALONE", None)]
    got = sorted(((r.doc_id, r.component_id) for r in rs.near_duplicates(table(rows)).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 5), (6, 5), (None, 5), (7, 7), (8, 8), (9, 5), (10, 10), (11, 10)], key=str)
    left = rs.drop_near_copies(table(rows))
    assert sorted(r.doc_id for r in left.collect()) == [1, 4, 5, 7, 8, 10] and left.columns == table(rows).columns
    assert rs.drop_near_copies(table([])).count() == 0
    assert sorted((r.doc_id is None, r.doc_id) for r in rs.drop_near_copies(table([(None, "a b", "a"), (None, "c d", "a"), (None, "a b", "b")])).collect()) == [(True, None)] * 2


def test_signatures_agree_as_often_as_sets_resemble():
    rng = np.random.default_rng(0)
    shares = []
    for _ in range(200):
        a = rng.integers(0, 2**63, 200).astype(np.uint64)
        b = np.concatenate((a[:178], rng.integers(0, 2**63, 22).astype(np.uint64)))
        shares.append(sum(x == y for x, y in zip(rs.signature(np.unique(a)), rs.signature(np.unique(b)))) / 64)
    assert abs(np.mean(shares) - 178 / 222) < 0.02
    assert rs.resemblance(np.unique(a), np.unique(b)) == 178 / 222


def test_long_lists_are_spanned():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, 64, dtype=np.uint8)
    tight = np.repeat(base[None], 300, axis=0)
    tight[np.arange(300), rng.integers(0, 64, 300)] ^= 1
    loose = tight[:40].copy()
    loose[:, :12] ^= 7
    other = rng.integers(0, 256, (50, 64), dtype=np.uint8)
    found = list(rs.list_links(np.arange(390), np.concatenate((tight, loose, other))))
    label = list(range(390))
    for a, b in found:
        label = [label[a] if x == label[b] else x for x in label]
    assert len(set(label[:340])) == 1 and len(set(label[340:])) == 50 and len(found) < 3 * 390


def test_groups_join_over_simhash_links_too(llm_spark):
    rng = random.Random(21)
    words = [f"w{rng.randrange(900)}" for _ in range(60)]
    texts = [" ".join(words)]
    while len(texts) < 2:  # few bits apart, but below the resemblance
        other = list(words)
        for at in rng.sample(range(60), 3):
            other[at] = f"v{rng.randrange(900)}"
        near = " ".join(other)
        bits = (sh.simhash(texts[0].encode()) ^ sh.simhash(near.encode())) & (2**64 - 1)
        if bits.bit_count() <= 4 and rs.resemblance(*(rs.shingle_hashes(t.encode()) for t in (texts[0], near))) < 0.8:
            texts.append(near)
    texts += [" ".join(f"u{rng.randrange(900)}" for _ in range(60)) for _ in range(5)]
    docs = llm_spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(llm_spark, docs, "").collect()) == [0, 2, 3, 4, 5, 6]
    assert rs.drop_near_copies(docs).count() == 7


def drifted():
    """Signatures and sets of a tight group, of its last member that agrees least, and of a row that resembles the last member alone."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 256, 64, dtype=np.uint8)
    signatures = np.repeat(base[None], 42, axis=0)
    signatures[np.arange(40), 20 + np.arange(40)] ^= 1
    signatures[40, 4:7] ^= 3
    signatures[41, 40:57] ^= 7
    common, last = list(range(100)), [*range(90), *range(200, 210)]
    sets = [common] * 40 + [last, [*range(85), *range(200, 215)]]
    return signatures, [np.array(x, dtype=np.uint64) for x in sets]


def test_rows_that_stay_apart_meet_every_partner_of_their_list(llm_spark):
    signatures, sets = drifted()
    alike = {(i, j) for i in range(42) for j in range(i) if rs.resemblance(sets[i], sets[j]) >= 0.8}
    assert (41, 40) in alike and not any((41, j) in alike for j in range(40))
    assert all((signatures[41] == signatures[j]).sum() >= rs.LEAST for j in range(41))
    rows = [(i, s.tobytes(), h.tobytes()) for i, (s, h) in enumerate(zip(signatures, sets))]
    table = llm_spark.createDataFrame(rows, "row long, signature binary, hashes binary")
    got = {(r.right, r.left) for r in rs.near_links(table).collect()}
    assert got <= alike and (41, 40) in got


def test_blocks_join_what_resembles(llm_spark, monkeypatch):
    rng = np.random.default_rng(3)
    sets = [np.zeros(0, dtype=np.uint64)] * 2 + [np.unique(rng.choice(40, size=rng.integers(20, 40), replace=False).astype(np.uint64)) for _ in range(60)]
    rows = [{"row": 9 + i, "component": i if i % 3 else i // 6, "hashes": s.tobytes()} for i, s in enumerate(sets)]
    alike = {(9 + i, 9 + j) for j in range(62) for i in range(j) if rs.resemblance(sets[i], sets[j]) >= 0.8}

    def groups(pairs):
        label = {r["row"]: r["component"] for r in rows}
        for a, b in pairs:
            label = {k: label[a] if v == label[b] else v for k, v in label.items()}
        return {frozenset(k for k in label if label[k] == v) for v in label.values()}

    alone = [p for p in rs.joining_pairs(rows, None, 0.8)]
    across = rs.joining_pairs(rows[:20], rows[20:], 0.8)
    assert groups(p[:2] for p in alone) == groups(alike) != groups([])
    assert groups(p[:2] for p in across) == groups(p for p in alike if (p[0] < 29) != (p[1] < 29))
    assert {p[:2] for p in alone + across} <= alike and all(s == rs.resemblance(sets[a - 9], sets[b - 9]) for a, b, s in alone + across)
    # a neighbourhood of several blocks
    monkeypatch.setattr(rs, "_MEMBERS", 7)
    signatures, sets = drifted()
    table = llm_spark.createDataFrame([(i, s.tobytes(), h.tobytes()) for i, (s, h) in enumerate(zip(signatures, sets))], "row long, signature binary, hashes binary")
    assert (40, 41) in {(r.left, r.right) for r in rs.near_links(table).collect()}


def test_sets_are_taken_by_a_map_of_rows(llm_spark):
    rows = [0, 1, 7, 8, 9, 32767, 32768, 32769, 40000, 2**33, 2**33 + 5, 3 * 2**33 + 65536]
    table = llm_spark.createDataFrame([(i, str(i).encode()) for i in rows], "row long, hashes binary")
    for wanted in (rows[::2], rows[1::2], rows[:1], []):
        got = rs._sets_of(table, llm_spark.createDataFrame([(i,) for i in wanted * 2], "row long")).collect()
        assert sorted((r.row, bytes(r.hashes)) for r in got) == [(i, str(i).encode()) for i in wanted]
