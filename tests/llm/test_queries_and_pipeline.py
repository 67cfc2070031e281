"""Registered queries against SQL on the smallest tables, and the pipeline stage by stage against plain Python."""

import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from talkweave.llm import toxicity
from talkweave.llm.common import kept

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")


def test_each_operator_has_one_query():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "source_mix", "packing"]


@pytest.mark.parametrize("name", ["op1_line_dedup", "op7_source_mix", "op10_content_sort"])
def test_query_equals_sql(llm_spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{FOLDER}/documents.parquet')")
    df = entry.queries()[name](llm_spark, FOLDER)
    rel = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(cols)
    assert sorted(tuple(map(str, r)) for r in df.select(*cols).collect()) == sorted(tuple(map(str, r)) for r in rel.fetchall())


def test_suffix_query_equals_brute_force(llm_spark):
    docs = [(r.doc_id, r.text.encode()) for r in llm_spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    seen = Counter(t[i:i + 200] for _, t in docs for i in range(len(t) - 199))
    want = {}
    for i, t in docs:
        flags = bytearray(len(t) + 1)
        for k in range(len(t) - 199):
            if seen[t[k:k + 200]] > 1:
                flags[k:k + 200] = b"\1" * 200
        want[i] = (len(t), sum(flags), sum(1 for k, f in enumerate(flags) if f and (k == 0 or not flags[k - 1])))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in entry.queries()["op8_suffix_blocks"](llm_spark, FOLDER).collect()}
    assert got == want and sum(n for _, n, _ in want.values()) > 0


@pytest.fixture(scope="module")
def stages(llm_spark):
    docs = llm_spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        docs = kept(f(llm_spark, docs, FOLDER))
        out.append(docs)
    return out


def test_only_documents_above_the_threshold_go(llm_spark, stages):
    labels = llm_spark.read.parquet(f"{FOLDER}/labels.parquet")
    scores = {r.doc_id: r.score for r in toxicity.score_documents(stages[0], labels).collect()}
    assert {r.doc_id for r in stages[1].collect()} == {i for i, s in scores.items() if s < 0.5}
    assert stages[1].columns == stages[0].columns


def test_exact_stage(stages):
    best = {}
    for r in stages[1].collect():
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(best.values()) and stages[2].columns == stages[0].columns


def word_shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).translate({ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ")
    words = [w for w in words if w]
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_groups(texts):
    """Component of each text over all pairs of resemblance 0.8 or more, and the number of these pairs."""
    sets = [word_shingles(t) for t in texts]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    label, pairs = list(range(len(texts))), []
    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in holders[x] if j > i)  # every pair that shares a shingle, none left out
        pairs += [(i, j) for j, n in shared.items() if n >= 0.8 * (len(s) + len(sets[j]) - n)]
    empty = [i for i, s in enumerate(sets) if not s]
    pairs += [(empty[0], j) for j in empty[1:]]

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in pairs:
        a, b = sorted((root(i), root(j)))
        label[b] = a
    return [root(i) for i in range(len(texts))], pairs


def test_near_stage(stages):
    rows = sorted((r.doc_id, r.text) for r in stages[2].collect())
    label, pairs = near_groups([t for _, t in rows])
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted({rows[k][0] for k in label}) and stages[3].columns == stages[0].columns
    assert pairs


def test_mix_stage(stages):
    before, after = stages[3].collect(), stages[4].collect()
    size, weight = Counter(), {}
    for r in before:
        size[r.source] += len(r.text.split())
    for k, s in enumerate(sorted(size)):
        weight[s] = [3, 1, 2][k % 3]
    level_low, level_high = 0.0, 1e9
    for _ in range(200):  # the level at which capped shares use up 150 %
        level = (level_low + level_high) / 2
        if sum(min(2 * size[s], weight[s] * level) for s in size) < 1.5 * sum(size.values()):
            level_low = level
        else:
            level_high = level
    taken = Counter()
    for r in after:
        taken[r.source] += len(r.text.split())
    assert all(abs(taken[s] - min(2 * size[s], weight[s] * level)) <= 1.001 for s in size) and stages[4].columns == stages[0].columns
    texts = {r.doc_id: r.text for r in before}
    assert all(texts[r.doc_id].startswith(r.text) for r in after) and max(Counter(r.doc_id for r in after).values()) <= 2


def test_packing_stage(stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    want, got = Counter(), Counter()
    by_doc = defaultdict(dict)
    for r in stages[4].collect():
        ids = np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 0], dtype="<u4")
        want[r.doc_id, len(ids)] += len(ids)
        by_doc[r.doc_id, len(ids)] = ids
    for r in stages[5].collect():
        got[r.doc_id, r.doc_tokens] += r.length
        assert zlib.crc32(by_doc[r.doc_id, r.doc_tokens][r.start:r.start + r.length].tobytes()) == r.ids_crc32 and r.offset + r.length <= 1024
    assert got == want


def test_run_gives_the_last_stage(llm_spark, stages):
    got = entry.queries()["pipeline"](llm_spark, FOLDER)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages[5].collect()))
