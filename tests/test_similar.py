"""Similarity joins against brute force, components, and merges."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from talkweave.functions import pandas_udfs
from talkweave.functions.pandas_udfs import bounded_ratio
from talkweave.operators import docs as dc
from talkweave.operators import faq as fq
from talkweave.operators import retrieval as rt
from talkweave.operators import similar as sm
from talkweave.operators import substring
from talkweave.operators.substring import contains_join, keyword_hits
from talkweave.plans import QUERIES

FAQ = ("ord bigint, question string, answer string, category_id string, variants array<string>, steps array<string>, links array<string>, "
       "tags array<string>, related_wikilinks array<string>, source_count bigint, file_name string")


def entry(i, q, cat="c", answer=None, **k):
    return (i, q, answer or f"answer {i} " + "x" * i, cat, k.get("variants", []), k.get("steps", []), k.get("links", []), k.get("tags", []), [], k.get("n", 1), k.get("name", ""))


def words(rng, n, alphabet):
    return "".join(rng.choice(alphabet) for _ in range(n))


@pytest.mark.parametrize("threshold", [0.68, 0.82, 0.95])
@pytest.mark.parametrize("alphabet", ["abcdefgh", "高斯软件安装作业提交队列资源登录失败"])
def test_ratio_pairs_match_brute_force(spark, threshold, alphabet):
    rng = random.Random(hash(alphabet) % 97 + int(threshold * 100))
    texts = {words(rng, rng.randint(2, 24), alphabet) for _ in range(60)}
    for t in list(texts)[:40]:  # near copies
        i = rng.randrange(len(t))
        texts.add(t[:i] + rng.choice(alphabet) + t[i + rng.randint(0, 1):])
    rows = [(i, t, "ab"[i % 2]) for i, t in enumerate(sorted(texts))]
    df = spark.createDataFrame(rows, "ord bigint, norm string, g string")
    want = {(i, j) for i, a, _ in rows for j, b, _ in rows if i < j and SequenceMatcher(None, a, b).ratio() >= threshold}
    assert {(r.left, r.right) for r in sm.ratio_pairs(df, threshold).collect()} == want
    group = {r[0]: r[2] for r in rows}
    assert {(r.left, r.right) for r in sm.ratio_pairs(df, threshold, "g").collect()} == {p for p in want if group[p[0]] == group[p[1]]}


def test_block_bounds_leave_out_no_pair():
    rng = random.Random(12)
    texts = [words(rng, rng.choice([1, 5, 63, 64, 65, 128, 200, 256, 300]), "abcdé高" if i % 2 else "abcdefghijk") for i in range(60)]
    texts += [t[:k] + "z" + t[k + 1:] for t in texts for k in (len(t) // 2,)] + [""]
    for threshold in (0.5, 0.68, 0.82):
        found = set(zip(*(p.tolist() for p in pandas_udfs.block_pairs(texts, None, threshold))))
        ratio = {(i, j): SequenceMatcher(None, a, b).ratio() for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j}
        assert {p for p, r in ratio.items() if r >= threshold} <= found and len(found) < len(ratio)
        bounded = {(i, j) for i, j in ratio if max(len(texts[i]), len(texts[j])) <= 256 and bounded_ratio(texts[i], texts[j], threshold) == 0.0 < ratio[i, j]}
        assert not bounded & found  # the subsequence bound is the one of a single pair
        across = set(zip(*(p.tolist() for p in pandas_udfs.block_pairs(texts[:50], texts[50:], threshold))))
        assert across == {(i, j - 50) for i, j in found if i < 50 <= j}


def test_blocks_meet_whole(spark, monkeypatch):
    monkeypatch.setattr(sm, "BLOCK", 7)
    rng = random.Random(13)
    rows = [(i, words(rng, rng.randint(2, 14), "abcd"), rng.choice(["a", "b", None]), rng.random() < 0.5, rng.random() < 0.5) for i in range(80)] + [(None, "abc", "a", True, True)]
    df = spark.createDataFrame(rows, "ord bigint, norm string, g string, asks boolean, answers boolean")
    some = {i: (t, g, x, y) for i, t, g, x, y in rows if i is not None}
    ratio = lambda i, j: SequenceMatcher(None, some[i][0], some[j][0]).ratio()
    got = {(r.left, r.right): r.score for r in sm.ratio_pairs(df, 0.7, "g").collect()}
    assert got == {(i, j): ratio(i, j) for i in some for j in some if i < j and some[i][1] == some[j][1] is not None and ratio(i, j) >= 0.7}
    got = {(r.left, r.right): r.score for r in sm.ratio_pairs(df, 0.7, both_ways=True).collect()}
    assert got == {(i, j): ratio(i, j) for i in some for j in some if i != j and some[i][2] and some[j][3] and ratio(i, j) >= 0.7}


def test_contains_join_matches_brute_force(spark):
    rng = random.Random(5)
    needles = {words(rng, rng.randint(1, 7), "abc高") for _ in range(40)}
    texts = [words(rng, rng.randint(0, 40), "abc高") for _ in range(40)]
    n = spark.createDataFrame([(x, x) for x in needles], "needle_id string, needle string")
    t = spark.createDataFrame(list(enumerate(texts)), "text_id int, text string")
    want = {(x, i) for x in needles for i, y in enumerate(texts) if x in y}
    assert {tuple(r) for r in contains_join(n, t).collect()} == want
    pages = t.select(F.col("text_id").alias("page_id"), F.substring("text", 1, 5).alias("title"), "text")
    words_df = n.select(F.col("needle").alias("keyword"))
    hits = {tuple(r) for r in keyword_hits(pages, words_df).collect()}
    assert hits == {(i, x, x in y[:5], x in y) for x in needles for i, y in enumerate(texts) if x in y}


@pytest.mark.parametrize("n, shortest, most", [(3, 1, 2), (3, 3, 4), (8, 8, 32)])
def test_contains_join_weighs_a_few_grams_of_long_needles(spark, monkeypatch, n, shortest, most):
    monkeypatch.setattr(substring, "GRAMS", most)
    rng = random.Random(6)
    texts = [words(rng, rng.randint(0, 90), "ab高\U0001f600") for _ in range(40)] + [None]
    needles = [t[i:i + rng.randint(1, 70)] for t in texts if t for i in (0, len(t) // 3)] + [words(rng, rng.randint(1, 12), "ab高") for _ in range(30)] + ["", None]
    # ids repeat: each needle of an id is searched for
    rows = [(k % 50, x) for k, x in enumerate(needles)] + [(None, "ab")]
    got = contains_join(spark.createDataFrame(rows, "needle_id int, needle string"), spark.createDataFrame(list(enumerate(texts)), "text_id int, text string"), n, True, shortest)
    want = sorted((k, i) for k, x in set(rows) if k is not None and x and len(x) >= shortest for i, y in enumerate(texts) if y and x in y and len(x) < len(y))
    assert sorted(map(tuple, got.collect())) == want and want


def test_questions_are_normalised_and_pairs_searched_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        read.add(1)
        return x

    seen = seen.asNondeterministic()
    rows = [entry(i, f"question {i % 7} on {i}") for i in range(20)]
    faqs = spark.createDataFrame(rows, FAQ)
    asked = sm.distinct_questions(faqs.withColumn("question", seen("question")))
    assert asked.count() == asked.filter("ord >= 0").count() == 20 and read.value == 20
    read.value = 0
    pairs = spark.createDataFrame([(i, i + 7) for i in range(13)], "left bigint, right bigint").withColumn("right", seen(F.col("right").cast("string")).cast("bigint"))
    merged = {r.component: r.source_count for r in sm.cluster_faqs(faqs, pairs).collect()}
    assert merged == {i: 3 if i < 6 else 2 for i in range(7)} and read.value == 13


def test_keyword_scores_over_blocks_and_repeated_pages(spark, monkeypatch):
    monkeypatch.setattr(substring, "QUESTIONS", 2)
    rng = random.Random(9)
    pages = [(i, words(rng, 3, "abc高"), words(rng, 30, "abc高")) for i in range(30)] + [(40, None, "ab"), (41, "ab", None), (42, None, None)]
    asked = [(q, sorted({words(rng, rng.randint(1, 4), "abc高") for _ in range(6)})) for q in range(7)] + [(7, [])]
    want = {}
    for q, ks in asked:
        for i, title, text in pages:
            t, x, e = (sum(map(f, ks)) for f in (lambda k: k in (title or ""), lambda k: k in (text or ""), lambda k: k in (title or "") or k in (text or "")))
            if e:
                want[q, i] = (t, x, e)
    schema = "page bigint, title string, text string"
    questions = spark.createDataFrame(asked, "question bigint, keywords array<string>")
    found = substring.keyword_scores(spark.createDataFrame([*pages, (None, "a", "b")], schema), questions).collect()
    assert {(r.question, r.page): (r.title_score, r.content_score, r.score) for r in found} == want and len(found) == len(want)
    # a hit counts once for every row of its page that has the keyword
    twice = substring.keyword_scores(spark.createDataFrame([*pages, pages[0]], schema), questions).filter("page = 0").collect()
    assert {(r.question, 0): (r.title_score, r.content_score, r.score) for r in twice} == {k: tuple(4 * x for x in v) for k, v in want.items() if k[1] == 0}


def test_first_pages_of_settled_hits(spark):
    rng = random.Random(3)
    score = {(s, r): rng.randint(1, 9) / 10 for s in range(40) for r in "xy"}
    rows = [(q, s, ["faq", "concept", "category"][s % 3], v, r) for q in range(3) for (s, r), v in score.items() if rng.random() < 0.8 for _ in range(rng.randint(1, 2))]
    hits = spark.createDataFrame(rows, "question_id int, stem int, hit_type string, score double, route string")
    plain, settled = (sorted(map(tuple, rt.bucket_hits(hits, settled=s).drop("route").collect())) for s in (False, True))
    assert plain == settled and plain
    plan = rt.bucket_hits(hits, settled=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("SortAggregate") < plan.rindex("WindowGroupLimit")  # rows are cut before they are merged


def test_similar_questions_and_clusters(spark):
    rows = [
        entry(1, "如何安装高斯软件", "a"), entry(2, "如何安装高斯软件呢？", "b"),  # containment, across categories
        entry(3, "作业提交以后一直排队怎么办", "a"), entry(4, "作业提交之后一直排队怎么处理", "a"),  # similar, same category
        entry(5, "作业提交之后总在排队怎么处理呢", "a"),  # chain to 3 through 4
        entry(6, "作业提交以后一直排队怎么办啊呀", "c"), entry(7, "余额不足", "a"), entry(8, "如何 安装高斯软件？", "c"),
    ]
    faqs = spark.createDataFrame(rows, FAQ)
    pairs = sm.similar_question_pairs(faqs)
    norm = {r[0]: "".join(ch for ch in r[1] if ch not in "？ ") for r in rows}
    cat = {r[0]: r[3] for r in rows}
    want = set()
    for i in norm:
        for j in norm:
            if i < j:
                a, b = norm[i], norm[j]
                score = 0.85 if a in b or b in a else SequenceMatcher(None, a, b).ratio()
                if score >= (0.68 if cat[i] == cat[j] else 0.82):
                    want.add((i, j))
    # copies are linked through their first entry only, so compare what is connected
    got = {tuple(sorted((r.left, r.right))) for r in pairs.collect()}

    def components(edges):
        label = {i: i for i in norm}
        for _ in norm:
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
        return label

    assert components(got) == components(want)
    comp = {r.id: r.component for r in sm.connected_components(faqs.select(F.col("ord").alias("id")), pairs).collect()}
    assert comp == components(want)
    merged = {r.component: r for r in sm.cluster_faqs(faqs, pairs).collect()}
    assert merged[1].source_count == 3 and merged[1].question == "如何 安装高斯软件？"
    assert merged[1].variants == ["如何安装高斯软件", "如何安装高斯软件呢？"]


def test_components_of_chains_and_hubs(spark):
    n = 60
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1000 + i) for i in range(1, 50)]
    v = spark.createDataFrame([(i,) for i in list(range(n)) + list(range(1000, 1051))], "id bigint")
    got = {r.id: r.component for r in sm.connected_components(v, spark.createDataFrame(edges, "left bigint, right bigint")).collect()}
    assert {got[i] for i in range(n)} == {0} and {got[1000 + i] for i in range(50)} == {1000} and got[1050] == 1050


def test_merge_group(spark):
    rows = [entry(1, "q1", answer="short", variants=["v1", "v2"], steps=["s1"], n=2, tags=["t"]),
            entry(2, "q2", answer="the longest answer", variants=["v2", "v3"], steps=["s2", "s1"], name="问答-x"),
            entry(3, "q1", answer="mid answer", links=["l1"])]
    got = fq.merge_faq_groups(spark.createDataFrame(rows, FAQ).withColumn("g", F.lit(1)), "g").collect()[0]
    assert (got.question, got.answer, got.source_count, got.file_name) == ("q2", "the longest answer", 4, "问答-x")
    assert got.variants == ["q1", "v1", "v2", "v3"] and got.steps == ["s1", "s2"] and got.links == ["l1"] and got.tags == ["t"]


def test_upsert(spark):
    old = spark.createDataFrame([entry(1, "如何安装高斯软件"), entry(2, "账户余额怎么查询"), entry(3, "登录失败怎么处理")], FAQ)
    new = spark.createDataFrame([entry(11, "如何安装高斯软件啊"), entry(12, "账户余额如何查询呢"), entry(13, "发票在哪里开具"), entry(14, "登录失败怎么处理？")], FAQ)
    got = {r.ord: r.match for r in sm.upsert_matches(old, new).collect()}
    assert got == {11: 1, 12: 2 if bounded_ratio("账户余额怎么查询", "账户余额如何查询呢", 0.68) else None, 13: None, 14: 3}
    once = sm.upsert_faqs(old, new)
    assert once.count() == 4 and once.agg(F.sum("source_count")).collect()[0][0] == 7


def test_near_duplicate_links(spark):
    edges = spark.createDataFrame([("p", "问答-如何在集群上安装高斯软件并提交作业A"), ("p", "问答-如何在集群上安装高斯软件并提交作业B"), ("p", "问答-其他"),
                                   ("r", "问答-如何在集群上安装高斯软件并提交作业A")], "src string, dst string")
    got = [(r.src, r.left[-1], r.right[-1]) for r in sm.near_duplicate_links(edges, 0.9).collect()]
    assert got == [("p", "A", "B")]


@pytest.mark.parametrize("threshold", [0.9, 0.95])
def test_texts_of_few_syllables_have_few_candidates(spark, threshold):
    rng = random.Random(14)
    syllables = ["th", "ea", "on", "ti", "er", "in", "the", "and", "ou", "é高"]
    texts = {"".join(rng.choice(syllables) for _ in range(rng.choice([1, 2, 5, 20, 25, 50]))) for _ in range(300)}
    for t in list(texts)[:60]:  # near copies, changed at both ends as well
        for i in {0, rng.randrange(len(t)), len(t) - 1}:
            texts.add(t[:i] + rng.choice(["", "x", "th"]) + t[i + rng.randint(0, 2):])
    rows = [(i, t) for i, t in enumerate(sorted(texts - {""}))]
    df = spark.createDataFrame(rows, "ord bigint, norm string")
    want = {(i, j) for i, a in rows for j, b in rows if i < j and SequenceMatcher(None, a, b).ratio() >= threshold}
    assert {(r.left, r.right) for r in sm.ratio_pairs(df, threshold).collect()} == want
    sized = df.selectExpr("ord", "norm", "length(norm) AS n", "0L AS _group", "ord AS _row")
    assert len(want) <= sm._candidates(sized, threshold).count() < len(rows) ** 2 // 20  # a tenth of all pairs


def test_near_duplicate_links_of_one_key(spark):
    edges = spark.createDataFrame([(s, d) for s in ("p", None) for d in ("Ab cdefghijklmnopqrstuvw", "ab cdefghijklmnopqrstuvw", "abcdefghijklmnopqrstuvx", "-")], "src string, dst string")
    got = sorted((r.src, r.left, r.right) for r in sm.near_duplicate_links(edges).collect())
    assert got == [("p", "Ab cdefghijklmnopqrstuvw", "abcdefghijklmnopqrstuvx"), ("p", "ab cdefghijklmnopqrstuvw", "abcdefghijklmnopqrstuvx")]


def test_keyword_scores_deal_pages_evenly_and_stop_at_first_places(spark, monkeypatch):
    monkeypatch.setattr(substring, "_FIRST", 4)
    pages = [(i, "an", "an ananas and " * 20 + ("zebra" if i % 7 == 0 else "")) for i in range(400)] + [(3, "", None), (3, "zebra", "zebra")]
    lists = {1: ["an", "zebra"], 2: ["and", "none"], 3: ["zebra"]}
    searched = substring._Searched(list(lists.values()))
    hits = lambda k, x: k in (x or "")
    want = {}
    for q, ks in lists.items():
        for i in range(400):
            rows = [(t, x) for j, t, x in pages if j == i]
            sums = [sum(sum(of(k, t, x) for t, x in rows) * max(1, sum(hits(k, t) or hits(k, x) for t, x in rows)) for k in ks)
                    for of in (lambda k, t, x: hits(k, t), lambda k, t, x: hits(k, x), lambda k, t, x: hits(k, t) or hits(k, x))]
            if sums[2]:
                want[q, i] = tuple(map(float, sums))
    place, hit, *sums = searched.scores([[(t, x) for j, t, x in pages if j == i] for i in range(400)])
    assert {(list(lists)[q], int(p)): x for q, p, *x in zip(hit, place, *sums)} == {k: list(v) for k, v in want.items()}
    assert {k for k, _ in searched.often} == {"an", "and"} and searched.n_words == 2
    scored = substring.keyword_scores(spark.createDataFrame(pages, "page bigint, title string, text string"),
                                      spark.createDataFrame(list(lists.items()), "question bigint, keywords array<string>"))
    got = scored.withColumn("task", F.spark_partition_id()).collect()
    assert {(r.question, r.page): (r.title_score, r.content_score, r.score) for r in got} == want
    assert len({r.task for r in got}) == 16  # every part has a task of its own


def test_unique_names(spark):
    df = spark.createDataFrame([(i, b, s) for i, (b, s) in enumerate([("n", "x"), ("n", "y"), ("n", "y"), ("m", "z"), ("n", "y"), ("r", "q")])], "i bigint, b string, s string")
    reserved = spark.createDataFrame([("r",)], "name string")
    got = [r.file_name for r in dc.unique_names(df, F.col("b"), F.col("s"), "i", reserved=reserved).orderBy("i").collect()]
    assert len(set(got)) == 6 and got[0] == "n" and got[3] == "m"
    assert got[2] == got[1] + "2" and got[4] == got[1] + "3" and got[5].startswith("r-")


@pytest.fixture(scope="module")
def short_questions(spark, tmp_path_factory):
    """A folder with documents whose questions are partly shorter than eight characters, and (ord, question, category) of each."""
    rng = random.Random(15)
    asked = [words(rng, rng.randint(1, 9), "abc高é") for _ in range(40)] + [words(rng, rng.randint(30, 40), "abcdefghijk") for _ in range(30)]
    asked += [t[:5] + "z" + t[6:] for t in asked[-10:]] + [asked[0], asked[1].upper(), "x", "y z", "\U0001f600a", "?!"]
    rows = [(i, f"{q}\nanswer {i}", ["en", "fr"][i % 2], f"s{i % 3}") for i, q in enumerate(asked)]
    folder = str(tmp_path_factory.mktemp("short"))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    return folder, [(i, q.replace(" ", "").replace("?!", "").lower(), ["en", "fr"][i % 2]) for i, q in enumerate(asked)]


def similar_edges(asked):
    first, placed, out = {}, {}, {}
    for i, q, c in asked:
        if q:
            first.setdefault(q, i)
            placed.setdefault(q, set()).add(c)
            if first[q] != i:
                out[first[q], i] = 0.85
    for a, i in first.items():
        for b, j in first.items():
            if i < j:
                score = 0.85 if a in b or b in a else SequenceMatcher(None, a, b).ratio()
                if score >= (0.68 if placed[a] & placed[b] else 0.82):
                    out[i, j] = score
    return out


def test_similar_pairs_take_questions_of_every_length(spark, short_questions):
    folder, asked = short_questions
    got = QUERIES["mrg6b_similar_question_pairs"](spark, folder).collect()
    want = similar_edges(asked)
    assert {(r.left, r.right): r.score for r in got} == want and len(got) == len(want)
    norm = {i: q for i, q, _ in asked}
    assert any(min(len(norm[i]), len(norm[j])) < 8 and norm[i] != norm[j] for i, j in want)


def test_clusters_join_over_questions_of_every_length(spark, short_questions):
    folder, asked = short_questions
    label = {i: i for i, _, _ in asked}
    for _ in asked:
        for a, b in similar_edges(asked):
            label[a] = label[b] = min(label[a], label[b])
    got = QUERIES["mrg7b_cluster_similar_faqs"](spark, folder).collect()
    sizes = {c: list(label.values()).count(c) for c in label.values()}
    assert {r.component: r.source_count for r in got} == sizes and len(got) == len(sizes)


def test_blocks_meet_without_copies_on_disk(spark):
    rows = [(g, n, b, [f"{g}{b}"]) for g, n in (("a", 5), ("b", 2)) for b in range(n)]
    blocks = spark.createDataFrame(rows, "_g string, _blocks bigint, _b bigint, x array<string>").repartition(3).localCheckpoint()
    met = sm.meetings(blocks, ["_g"])
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan and "Join" not in plan
    got = sorted(tuple(sorted(x[0] for x in (r.left, r.right or r.left))) for r in met.collect())
    assert got == sorted((f"{g}{i}", f"{g}{j}") for g, n in (("a", 5), ("b", 2)) for i in range(n) for j in range(i, n))
