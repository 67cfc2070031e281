import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from talkweave.llm import simhash as sh


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, bits=4):
    """Label per row: smallest index reachable."""
    label = list(range(len(fps)))

    def root(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    values = np.array(fps, dtype=np.uint64)
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i] ^ values[i + 1:]) <= bits).tolist():
            a, b = root(i), root(i + 1 + j)
            label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


def test_fingerprint_is_the_definition():
    for text in ("", " \n", "one", "a b c", "A b C d", "x y z w v u t Größe ÄÖ\x0bq", "rep rep rep rep rep rep", " ".join(f"w{i % 37}" for i in range(400))):
        assert sh.simhash(text.encode()) & (2**64 - 1) == plain(text)


def test_components_equal_brute_force(llm_spark):
    rng = random.Random(8)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(260):  # chains and balls of neighbours
        x = rng.choice(fps)
        for _ in range(rng.choice([0, 1, 2, 4, 5, 6])):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    centre = rng.getrandbits(64)
    fps += [centre ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)]  # a list longer than _SHORT
    rows = [(i, f - 2**64 if f >= 2**63 else f) for i, f in enumerate(fps)]
    df = llm_spark.createDataFrame(rows, "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in sh.near_components(df).collect()}
    assert [got[i] for i in range(len(fps))] == components(fps)


def test_index_entries_guarantee_a_meeting():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 50, dtype=np.int64)
    b = a.copy()
    for i in range(50):
        for bit in rng.choice(63, 4, replace=False):
            b[i] ^= np.int64(1) << np.int64(bit)
    batch = lambda x: pa.RecordBatch.from_arrays([pa.array(x)], names=["fp"])
    entries = lambda x: [e.column("entry").to_numpy() for e in sh._index(iter([batch(x)]))]
    assert (np.stack(entries(a)) == np.stack(entries(b))).any(axis=0).all()


def test_documents(table, odd_rows):
    rows = [*odd_rows, (20, "ONE two three four five six seven.", "a"), (21, "\n", None)]
    got = sh.near_duplicates(table(rows)).collect()
    fps = {(r.doc_id, r.fingerprint) for r in got}
    assert fps == {(i, format(plain(t or ""), "016x")) for i, t, _ in rows}
    by = {}
    for r in got:
        by.setdefault(r.fingerprint, set()).add(r.component_id)
    assert by[format(0, "016x")] == {1} and by[format(plain("one two three four five six seven."), "016x")] == {5}
    left = sh.drop_near_copies(table(rows))
    assert left.columns == table(rows).columns and sorted(r.doc_id for r in left.collect()) == [1, 4, 5, 7, 8]
    assert sh.near_duplicates(table([])).count() == 0 and sh.drop_near_copies(table([])).count() == 0
