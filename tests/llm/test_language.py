"""Language identification: the filter against plain sets, the model against held-out languages."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from talkweave.llm import language
from talkweave.llm.language import LanguageFilter, build_filter, fit, gram_hashes, identify, predict, shares


def grams(text):
    """N-grams of a text by plain loops."""
    out = []
    points = [" "]
    for c in text.lower():
        if c.isalpha():
            points.append(c)
        elif points[-1] != " ":
            points.append(" ")
    if points[-1] != " ":
        points.append(" ")
    for n in language.SIZES:
        for i in range(len(points) - n + 1):
            g = points[i:i + n]
            if all(c != " " for c in g[1:-1]) and any(c != " " for c in g):
                out.append("".join(g))
    return Counter(out)


@pytest.mark.parametrize("text", ["The cat.", "", "  ", "a", "1 2 3", "Größe  NAÏVE\n漢字 x", "İstanbul ﬁ", "a--b c", "x" * 50])
@pytest.mark.parametrize("piece", [3, 1 << 20])
def test_grams_equal_plain_loops(monkeypatch, text, piece):
    monkeypatch.setattr(language, "PIECE", piece)
    found = Counter(np.concatenate([np.zeros(0, dtype=np.uint64), *gram_hashes(text)]).tolist())
    assert sorted(found.values()) == sorted(grams(text).values())


def test_filter_returns_all_languages_of_a_gram():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**63, 6000)
    names = [f"l{i:03}" for i in range(130)]  # more than two words of bits
    rows = [(int(g), int(i)) for g in values[:3000] for i in rng.integers(0, 130, 4)]
    model = build_filter(names, np.ones(130) / 130, rows)
    held = defaultdict(set)
    for g, i in rows:
        held[g].add(i)
    masks = model.masks(values.view(np.uint64))
    assert masks.shape == (6000, 3)
    strays = 0
    for g, mask in zip(values.tolist(), masks.tolist()):
        found = {i for i in range(130) if mask[i // 64] >> i % 64 & 1}
        assert held[g] <= found
        strays += len(found - held[g])
    # False positives come as often as the share of set bits says.
    expected = sum(model.chance) * 6000
    assert abs(strays - expected) < 0.25 * expected + 30


def test_shares_are_corrected_for_chance():
    model = LanguageFilter(("a", "b"), np.full((1024, 1), 1, dtype=np.uint64), np.array([0.0, 0.2]), np.array([0.5, 0.5]))
    assert shares(model, "word")[1].tolist() == [1.0, 0.0]


def test_learned_grams_equal_plain_counts(llm_spark, table):
    texts = {"en": ["the cat and the dog", "the end"], "fr": ["le chat et le chien", "la fin the"]}
    rows = [(i, t, "a") for i, t in enumerate(t for ts in texts.values() for t in ts)]
    docs = llm_spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate((t, lang) for lang, ts in texts.items() for t in ts)], "doc_id long, text string, lang string")
    assert len(rows) == 4
    model = fit(docs, min_share=0.02, rival_share=0.5)
    count = {lang: sum((grams(t) for t in ts), Counter()) for lang, ts in texts.items()}
    total = {lang: Counter() for lang in count}
    for lang, c in count.items():
        for g, n in c.items():
            total[lang][len(g)] += n
    share = {g: {lang: c[g] / total[lang][len(g)] for lang, c in count.items()} for g in set().union(*count.values())}
    for g, by in share.items():
        # A gram alone: its hash is the one that a text of these characters gives for its size.
        want = {lang for lang, s in by.items() if s >= 0.02 and s >= 0.5 * max(x for x in by.values() if x >= 0.02)} if max(by.values()) >= 0.02 else set()
        parts = list(gram_hashes(g.strip()))
        sizes = [s for s in language.SIZES if len(f" {g.strip()} ") >= s]
        hashes = dict(zip(sizes, parts)).get(len(g))
        if hashes is None or not len(hashes):
            continue
        place = [x for x in grams_in_order(g.strip(), len(g))].index(g)
        mask = int(model.masks(hashes[place:place + 1])[0, 0])
        found = {lang for i, lang in enumerate(model.languages) if mask >> i & 1}
        assert want <= found


def grams_in_order(text, n):
    points = f" {text} "
    return [points[i:i + n] for i in range(len(points) - n + 1) if " " not in points[i + 1:i + n - 1] and points[i:i + n].strip()]


def test_odd_rows(table, odd_rows):
    docs = table(odd_rows)
    got = identify(docs).collect()
    assert len(got) == len(odd_rows) and {r.lang_pred for r in got} == {"und"} and all(r.score == 0 for r in got)  # no language to learn
    from pyspark.sql import functions as F

    assert zlib.crc32(b"4") % 4 != 2
    taught = docs.withColumn("lang", F.when(F.col("doc_id").isNull(), "xx").when(F.col("doc_id") == 4, "yy"))
    by = {(r.doc_id, r.lang_pred) for r in identify(taught).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "yy"), (5, "xx"), (6, "xx"), (None, "xx")} <= by
    assert identify(table([])).count() == 0


def test_labels_of_held_out_rows_are_not_read(llm_spark):
    docs = llm_spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    from pyspark.sql import functions as F

    swapped = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    first, second = ({r.doc_id: (r.held_out, r.lang_pred, r.score) for r in identify(d).collect()} for d in (docs, swapped))
    assert first == second


def test_query_is_right_on_held_out_rows(llm_spark):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in llm_spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    rows = entry.queries()["op12_language_id"](llm_spark, folder).collect()
    assert len(rows) == len(lang)
    out = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    wrong = [r for r in out if r.lang_pred != lang[r.doc_id]]
    assert len(out) > 200 and len(wrong) <= 0.02 * len(out), wrong[:5]


def test_predict_breaks_ties_by_the_prior():
    model = build_filter(["a", "b"], np.array([0.2, 0.8]), [])
    assert predict(model, "word") == ("b", 0.8) and predict(model, "12") == ("und", 0.0) and predict(model, None) == ("und", 0.0)
