import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkweave.llm import fingerprints as fp, mixing
from talkweave.llm.hashing import word_hashes


def shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_sketches_estimate_the_sets():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(5000)]
    a = [rng.choice(words) for _ in range(4000)]
    b = a[:2500] + [rng.choice(words) for _ in range(1500)]
    x, y = fp.sketches([" ".join(a), " ".join(b)])
    one, two = shingles(" ".join(a)), shingles(" ".join(b))
    assert abs(fp.resemblance(x, y) - len(one & two) / len(one | two)) < 0.15
    assert abs(fp.containment(x, y) - len(one & two) / len(one)) < 0.15
    assert abs(fp.distinct_shingles(x) - len(one)) < 0.3 * len(one)
    assert np.array_equal(fp.from_hex(fp.to_hex(x)), x)


def test_small_texts_are_exact():
    s = fp.sketches(["", "a b", "A  B", "a b c d e f", "b c d e f g"])
    assert len(s[0]) == 0 and np.array_equal(s[1], s[2]) and len(s[3]) == 2
    assert fp.resemblance(s[3], s[4]) == 1 / 3 and fp.resemblance(s[0], s[0]) == 1.0 and fp.resemblance(s[0], s[1]) == 0.0


def test_segments_do_not_change_hashes():
    text = ("x" * 700 + " " + "yz " * 500) * 1200  # more than one segment
    starts, hashes = word_hashes([text.encode()])
    assert len(starts) == len(text.split()) and len(set(hashes.tolist())) == 2


def test_neighbours(table, odd_rows, llm_spark):
    rows = sorted(((i, t or "") for i, t, _ in odd_rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = fp.neighbour_fingerprints(table(odd_rows)).collect()
    want = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        changed = fp.edited(t, after)
        a, b, c = fp.sketches([t, changed, after])
        want.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), fp.to_hex(a), fp.to_hex(b), fp.resemblance(a, b), fp.resemblance(a, c)))
    assert sorted([tuple(r)[:7] for r in got], key=str) == sorted(want, key=str)
    assert fp.neighbour_fingerprints(table([])).count() == 0
    alone = fp.neighbour_fingerprints(table([(5, "a b c d", None)])).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


def test_parts_merge(table):
    text = " ".join(f"w{i * i % 1009}" for i in range(3000))
    words = text.split()
    pieces = [(k, " ".join(words[a:a + 604]), None) for k, a in enumerate(range(0, 3000, 600))]  # parts overlap by four words
    parts = fp.document_sketches(table([*pieces, (9, "", None)])).withColumn("whole", F.when(F.col("doc_id") == 9, "empty").otherwise("text"))
    merged = {r.whole: r.fingerprint for r in fp.merge_fingerprints(parts, "whole").collect()}
    assert merged == {"text": fp.to_hex(fp.sketches([text])[0]), "empty": ""}


def test_mix_meets_targets(table):
    rng = random.Random(4)
    rows = [(i, " ".join("w" * 1 for _ in range(rng.choice([0, 1, 5, 40, 900]))), rng.choice(["a", "b", "b", "b", "c", None, "empty"])) for i in range(400)]
    rows = [(i, "" if s == "empty" else t, s) for i, t, s in rows] + [(500, None, "b"), (None, "x y", "a"), (7, "again and again", "b")]
    got = mixing.mix(table(rows), mixing.cyclic_weights([3, 1, 2])).collect()
    assert len(got) == len(rows)
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    order = sorted([s for s in size if s is not None]) + [None]
    weight = {s: [3, 1, 2][k % 3] for k, s in enumerate(order)}
    free, target, rest = set(order), {}, 1.5 * sum(size.values())
    while True:  # clamp and reshare, step by step
        level = rest / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level > 2 * size[s]}
        for s in over:
            target[s] = 2 * size[s]
            rest -= target[s]
        free -= over
        if not over:
            break
    target |= {s: weight[s] * level for s in free}
    taken = Counter()
    for r in got:
        assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == size[r.source] and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(taken[s] == int(target[s] + 1e-9) for s in order)
    again = mixing.mix(table(rows), mixing.cyclic_weights([3, 1, 2])).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_documents_are_repeated_as_planned(table, odd_rows):
    docs = table(odd_rows)
    out = mixing.mixed_documents(docs, mixing.cyclic_weights([3, 1, 2]))
    assert out.columns == docs.columns
    rows = out.collect()
    plan = Counter()
    for r in mixing.mix(docs, mixing.cyclic_weights([3, 1, 2])).collect():
        plan[r.doc_id] += r.taken
    words = Counter()
    for r in rows:
        words[r.doc_id] += len((r.text or "").split())
        assert r.text is None or any(t is not None and t.startswith(r.text) for i, t, _ in odd_rows if i == r.doc_id)
    assert {k: v for k, v in words.items() if v} == {k: v for k, v in plan.items() if v}
    assert mixing.mixed_documents(table([]), mixing.cyclic_weights([1])).count() == 0


def test_null_is_a_key_of_merged_fingerprints(llm_spark):
    parts = llm_spark.createDataFrame([(None, "00000000000a"), (None, "000000000001"), ("k", "000000000002"), ("e", "")], "key string, fingerprint string")
    got = {r.key: r.fingerprint for r in fp.merge_fingerprints(parts, "key").collect()}
    assert got == {None: "00000000000100000000000a", "k": "000000000002", "e": ""}


def test_shingles_of_any_length():
    words = [f"w{i}" for i in range(60)]
    assert len(fp.sketches([" ".join(words)], shingle=40)[0]) == 21
    with pytest.raises(ValueError):
        fp.sketches(["a"], shingle=0)


def test_an_id_in_two_sources_keeps_its_shares_apart(table):
    rows = [(i, " ".join(f"{s}{i}w{k}" for k in range(3 + 7 * i)), s) for i in range(10) for s in ("a", "b")] + [(3, "same text here", "b")] * 3 + [(None, "no id at all", "a")] * 2 + [(50, "", "a")]
    docs = table(rows)
    plan = {r.source: r.target for r in mixing.mix(docs, mixing.cyclic_weights([3, 1])).collect()}
    out = mixing.mixed_documents(docs, mixing.cyclic_weights([3, 1])).collect()
    words = Counter()
    for r in out:
        words[r.source] += len(r.text.split())
    assert all(abs(words[s] - target) <= 1 for s, target in plan.items())
    texts = {(i, s, t) for i, t, s in rows}
    assert all(any(i == r.doc_id and s == r.source and t.startswith(r.text) for i, s, t in texts) for r in out)
    assert sum(r.doc_id == 50 for r in out) == 1
