"""Hard negatives against a search through all pairs."""

import math

import numpy as np
import pytest

from talkweave.llm import hardnegatives
from talkweave.llm.hardnegatives import mine

SCHEMA = "vec_id long, embedding array<float>, label int, score string, window string, low string, row string, block string"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, every=100, k=5, m=10):
    """Every anchor against every row, in Python integers."""
    part = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        part.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    key = lambda s: (-s[0], s[1] is None, s[1] or 0, s[2])
    for a, (i, label, v) in enumerate(part):
        if i is None or i % every:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), j, b, other) for b, (j, other, w) in enumerate(part) if b != a]
        for p, pid, _, _ in sorted((s for s in scored if s[3] == label), key=key)[:k]:
            inside = sorted((s for s in scored if s[3] != label and 30 * p <= 100 * s[0] <= 90 * p), key=key)[:m]
            out += [(i, pid, n + 1, j, p, s) for n, (s, j, _, _) in enumerate(inside)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def found(llm_spark):
    def run(rows, **options):
        df = llm_spark.createDataFrame([(i, v, label, *["x"] * 5) for i, v, label in rows], SCHEMA)
        return sorted(map(tuple, mine(df, **options).select(COLUMNS).collect()), key=str)

    return run


def vectors(seed, n, size=20, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(10, size))
    labels = rng.integers(0, 10, n)
    x = spread * rng.normal(size=(n, size)) + centres[labels]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, x[i].astype(np.float32).tolist(), int(labels[i])) for i in range(n)]


@pytest.mark.parametrize("spread", [0.2, 1.0])
def test_equals_all_pairs(found, spread):
    rows = vectors(3, 900, spread=spread)
    assert found(rows, row_block=128, anchor_block=4) == brute(rows)


def test_many_copies_of_one_vector(found):
    rows = [(i, [0.5, 0.5, 0.25, 0.0] if i % 3 else [0.25, 0.25, 0.125, 0.125], i % 10) for i in range(600)]
    assert found(rows, row_block=64) == brute(rows)


def test_odd_rows(found):
    nan, inf = float("nan"), float("inf")
    rows = [(100, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (200, [0.0, 0.0], 2), (300, [-1.0, -1.0], 1), (None, [1.0, 0.5], 1), (None, [0.6, 0.1], 2), (1, None, 1), (2, [1.0, 0.0], None),
            (3, [1.0, nan], 1), (4, [inf, 1.0], 2), (5, [None, 1.0], 2), (6, [0.5, 0.5], 2), (7, [0.5, 0.5], 9), (8, [0.7, 0.1], 1), (9, [0.4, 0.9], 3), (10, [0.4], 3), (11, [], 4),
            (400, [], 4), (12, [0.4, 0.0], 3), (12, [0.4, 0.0], 3), (500, [0.001, -0.001], 3), (-100, [0.9, 0.0], 2)]
    got, want = found(rows), brute(rows)
    assert got == want and len(want) > 5
    assert found([]) == [] and found([(1, [1.0], 1)]) == [] and found([(100, [1.0], 1)]) == []


def test_join_prunes_without_loss():
    rng = np.random.default_rng(5)
    order = np.arange(24)

    def block(n):
        v = rng.integers(-300, 300, (n, 24)).astype("<i4")
        row = {"a_n": n, "a_size": 24, "a_vectors": v.tobytes(), "a_nulls": np.zeros(n, dtype=bool).tobytes()} | {f"a_{c}": np.arange(n, dtype="<i8").tobytes() for c in ("ids", "rows", "labels")}
        return hardnegatives.Block.read(row, "a", order), v.astype(np.int64)

    (a, x), (r, y) = block(15), block(200)
    scores = x @ y.T
    low, high = np.quantile(scores, 0.8, axis=1), np.quantile(scores, 0.95, axis=1)
    i, j, s = hardnegatives.threshold_join(a, r, low, high, np.ones(scores.shape, dtype=bool))
    want = np.argwhere((scores >= low[:, None]) & (scores <= high[:, None]))
    assert sorted(zip(i.tolist(), j.tolist())) == sorted(map(tuple, want.tolist())) and (s == scores[i, j]).all()


def test_registered_query_equals_sql(llm_spark):
    import duckdb

    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet')")
    got = sorted(map(tuple, entry.queries()["op13_hard_negatives"](llm_spark, folder).select(COLUMNS).collect()))
    assert got == sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({entry.oracle_sql()['op13_hard_negatives']})").fetchall()) and got
    rows = [(r.vec_id, r.embedding, r.label) for r in llm_spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert sorted(got, key=str) == brute(rows)
