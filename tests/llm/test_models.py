import itertools
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

TABLES = "/root/testdata/sf0.001"
from talkweave.llm import deobfuscation, ordinal, toxicity
from talkweave.llm.deobfuscation import SYMBOLS, Decoder, trigram_costs, trigram_counts

CORPUS = ("the idiot said that the clown was stupid and worthless, a pathetic loser; the moron threw trash at the scum. it is a disgusting thing "
          "to say of the other one and then not to be sorry for it at all. ") * 20


def test_trigram_counts_by_hand():
    counts = trigram_counts(b"Ab a").reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    assert counts[0, 0, 1] == 2 and counts[0, 1, 2] == 1 and counts[1, 2, 0] == 1 and counts[0, 1, 0] == 1 and counts.sum() == 5
    costs = trigram_costs(counts.ravel())
    assert np.allclose(np.exp(-costs).sum(axis=2), 1.0)


@pytest.mark.parametrize("disguised,word", [("1d10t", "idiot"), ("m0r0n", "moron"), ("i d i o t", "idiot"), ("s.c.u.m", "scum"), ("stuuupid", "stupid"), ("tr@$h", "trash"), ("cl0wn", "clown"),
                                            ("l-o-s-e-r", "loser"), ("d1sgu5t1ng", "disgusting"), ("wwoorrtthhlleess", "worthles")])
def test_disguises_are_decoded(disguised, word):
    assert Decoder(trigram_costs(trigram_counts(CORPUS.encode()))).restore(disguised)[0].startswith(word)


def test_viterbi_is_the_cheapest_path():
    decoder = Decoder(trigram_costs(trigram_counts(CORPUS.encode())))

    def cost(options):
        total, one, two = 0.0, 0, 0
        for text, extra in options:
            total += extra
            for x in text:
                s = 0 if x == " " else ord(x) - 96
                if s or two:
                    total += decoder.costs[one if two else 0][two][s]
                one, two = two, s
        return total + (decoder.costs[one][two][0] if two else 0.0)

    import itertools

    for signs in ("1d!0t", "5.c-u", "aa1b", "t0*3"):
        runs = [(k, len(list(g))) for k, g in itertools.groupby(signs)]
        paths = list(itertools.product(*[decoder._choices(s, n) for s, n in runs]))
        best = min(paths, key=cost)
        assert decoder.restore(signs) == "".join(t for t, _ in best).split()


def test_plain_tokens_stay():
    decoder = Decoder(trigram_costs(trigram_counts(CORPUS.encode())))
    assert decoder.words_of_token("idiot,") == ("idiot",) and decoder.words_of_token("thing***") == ("thing",) and decoder.words_of_token("größe.") == ("größe",)
    assert list(decoder.spaced_words("a b")) == []


@pytest.mark.parametrize("token,word", [("“1d10t”", "idiot"), ("1d10t…", "idiot"), ("1d10t—he", "idiot"), ("he—1d10t", "idiot"), ("m0r0n’s", "moron"), ("stu" + "u" * 70 + "pid", "stupid"),
                                        ("¡cl0wn!", "clown"), ("the," * 30 + "1d10t", "idiot")])
def test_typographic_marks_and_length_hide_no_word(token, word):
    assert word in Decoder(trigram_costs(trigram_counts(CORPUS.encode()))).words_of_token(token)


def test_tokens_with_other_letters_are_decoded_in_linear_time():
    decoder = Decoder(trigram_costs(trigram_counts((CORPUS + "le crétin était là. " * 20).encode())))
    assert "crétin" in decoder.words_of_token("cr€-crét1n") and decoder.words_of_token("l’ami") == ("l", "ami")
    assert decoder.words_of_token("=" * 200_000 + "—thing") == ("thing",) and len("".join(decoder.restore("12" * 20_000))) == 40_000


@pytest.mark.parametrize("text,word", [("wwoorrtthhlleess", "worthles"), ("ccllownn", "clown"), ("the wwoorrtthhlleess one", "worthles")])
def test_doubled_letters_pass_the_gate(text, word):
    decoder = Decoder(trigram_costs(trigram_counts(CORPUS.encode())))
    assert any(w.startswith(word) for t in text.split() for w in decoder.words_of_token(t)) and decoder.words_of_token("sorry")[0] == "sorry"


@pytest.mark.parametrize("text,word", [("s c u m", "scum"), ("the n o t he", "not"), ("i   d   i   o   t", "idiot"), ("m, 0, r, 0, n", "moron"), ("s\nc\nu\nm", "scum"), ("s — c … u _ m", "scum")])
def test_letters_apart_by_anything(text, word):
    assert word in list(Decoder(trigram_costs(trigram_counts(CORPUS.encode()))).spaced_words(text))


def test_scores_see_pieces_doubled_letters_and_letters_apart(llm_spark):
    df = labelled(llm_spark)
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    texts = ["the st up id said", "the sttuuppiidd said", "the s, t, u, p, 1, d said", "the i\nd\ni\no\nt said", "the id   iot said", "the person said", "fist up idle"]
    rows = llm_spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    score = {r.doc_id: r.s for r in rows.select("doc_id", toxicity.score(model, F.col("text")).alias("s")).collect()}
    assert [score[i] > 0.5 for i in range(7)] == [True] * 5 + [False] * 2
    got = toxicity.score_documents(df.select("doc_id", "text").union(rows.selectExpr("doc_id + 1000", "text")), df.select("doc_id", "toxic"))
    assert [r.predicted for r in got.filter("doc_id >= 1000").orderBy("doc_id").collect()] == [1] * 5 + [0] * 2


def test_scores_see_words_next_to_typographic_marks(llm_spark):
    df = labelled(llm_spark)
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    rows = llm_spark.createDataFrame([(0, "the “1d10t” said"), (1, "the 1d10t— said"), (2, "the person said")], "doc_id long, text string")
    score = {r.doc_id: r.s for r in rows.select("doc_id", toxicity.score(model, F.col("text")).alias("s")).collect()}
    assert score[0] > 0.5 and score[1] > 0.5 and score[2] < 0.5


def labelled(spark, n=400):
    words = ["idiot", "clown", "stupid", "1d10t", "s t u p i d", "cl0wn"]
    rows = [(i, CORPUS[i % 50:60 + i % 60].split(";")[0].replace("idiot", "person").replace("clown", "man").replace("stupid", "tall") + (f" {words[i % 6]} he" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_held_out_accuracy_on_disguised_words(llm_spark):
    df = labelled(llm_spark)
    got = {r.doc_id: r for r in toxicity.score_documents(df.select("doc_id", "text"), df.select("doc_id", "toxic")).collect()}
    right = [got[r.doc_id].predicted == r.toxic for r in df.collect() if got[r.doc_id].held_out]
    assert len(right) > 50 and np.mean(right) > 0.9
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items())


def test_odd_rows_have_scores_and_no_labels_work(llm_spark, table, odd_rows):
    none = llm_spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score_documents(table(odd_rows), none).collect()
    assert len(got) == len(odd_rows) and {r.score for r in got} == {0.5}
    labels = llm_spark.createDataFrame([(1, None), (2, 1), (2, 0), (4, 0), (None, 1), (99, 1)], "doc_id long, toxic int")
    got = toxicity.score_documents(table(odd_rows), labels).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got) and not any(r.held_out for r in got if r.doc_id is None)
    assert toxicity.score_documents(table([]), labels).count() == 0
    left = toxicity.drop_toxic(table(odd_rows), labels)
    assert left.columns == table(odd_rows).columns


def test_ordinal_recovers_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=3000)
    grade = np.digitize(2 * x + rng.logistic(size=3000), [-1.0, 0.5, 2.0])
    model = ordinal.fit_arrays(np.arange(3000), np.zeros(3000, dtype=np.int64), x, grade, 4, steps=400, penalty=0.0)
    assert np.all(np.diff(model.thresholds) > 0) and np.allclose(model.thresholds, [-1.0, 0.5, 2.0], atol=0.25) and abs(model.weights[0] - 2) < 0.25


def test_ordinal_gradient_is_right():
    rng = np.random.default_rng(1)
    row, bucket, value = np.repeat(np.arange(40), 3), rng.integers(0, 6, 120), rng.normal(size=120)
    grade = rng.integers(0, 3, 40)

    def loss(m):
        s = np.bincount(row, weights=m.weights[bucket] * value, minlength=40)
        cuts = np.concatenate(([-np.inf], m.thresholds, [np.inf]))
        return -np.mean(np.log(ordinal._sigmoid(cuts[grade + 1] - s) - ordinal._sigmoid(cuts[grade] - s)))

    fits = [loss(ordinal.fit_arrays(row, bucket, value, grade, 3, steps=n, penalty=0.0)) for n in (1, 50, 400)]
    assert fits[0] > fits[1] >= fits[2] - 1e-6


def test_scores_equal_features():
    rng = np.random.default_rng(2)
    weights = rng.normal(size=ordinal.BUCKETS)
    scorer = ordinal._Scorer(weights)
    for text in ("", " ", "One two, two THREE!! 4%%% | x", "ä ö Ü ß ss"):
        want = sum(weights[b] * v for b, v in ordinal.features(text).items())
        assert abs(scorer.score(text) - want) < 1e-9 and abs(scorer.score(text) - want) < 1e-9


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="tables not present")
def test_held_out_quality(llm_spark):
    docs, labels = (llm_spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    ratings = labels.select("doc_id", F.col("quality").alias("grade"))
    got = {r.doc_id: r for r in ordinal.grade_documents(docs, ratings, 2).collect()}
    right = [(r.grade == 1) == got[r.doc_id].selected for r in ratings.collect() if got[r.doc_id].held_out]
    assert np.mean(right) > 0.9
    assert all(abs(r.expected_grade - sum(r.tails)) < 1e-9 for r in got.values())


def test_ordinal_odd_rows(llm_spark, table, odd_rows):
    none = llm_spark.createDataFrame([], "doc_id long, grade int")
    got = ordinal.grade_documents(table(odd_rows), none, 3).collect()
    assert len(got) == len(odd_rows) and all(abs(r.expected_grade - 1.0) < 1e-9 for r in got)
    some = llm_spark.createDataFrame([(4, 2), (4, 0), (5, None), (None, 1), (8, 1)], "doc_id long, grade int")
    got = ordinal.grade_documents(table(odd_rows), some, 3).collect()
    assert len(got) == len(odd_rows) and all(list(r.tails) == sorted(r.tails, reverse=True) for r in got)
    assert ordinal.grade_documents(table([]), some, 3).count() == 0


def test_every_telling_word_has_a_weight(llm_spark):
    """400 telling words, more than any round cap, and copies of one toxic text, whose other words tell nothing."""
    letters = "bcdfghklmnprstvwz"
    words = ["".join(x) for x in itertools.islice(itertools.product(letters, "aiou", letters, "aeo", "x"), 0, 4000, 10)][:400]
    toxic = [(i, " ".join(words[i:] + words[:i])) for i in range(30)]
    clean = [(100 + i, f"quiet morning walk number {i} along the river") for i in range(60)]
    copies = [(1000 + i, words[0] + " zebrafish umbrella") for i in range(40)]
    docs = llm_spark.createDataFrame(toxic + clean + copies, "doc_id long, text string")
    labels = llm_spark.createDataFrame([(i, int(i < 100 or i >= 1000)) for i, _ in toxic + clean + copies], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    weights = dict(zip(model.features, model.weights))
    assert all(weights[w] > 0 for w in words)
    assert "zebrafish" not in weights and "umbrella" not in weights


def test_sparse_weights_equal_dense_newton():
    rng = np.random.default_rng(3)
    x = (rng.random((80, 12)) < 0.3).astype(float)
    y = (rng.random(80) < 1 / (1 + np.exp(-(x[:, 0] * 3 - x[:, 1] * 2 - 0.2)))).astype(float)
    found = [np.flatnonzero(r).tolist() for r in x]
    got = toxicity._weights(found, y, 12, 0.0, 1.0)
    full = np.hstack([x, np.ones((80, 1))])
    ridge = np.array([1.0] * 12 + [1e-6])
    beta = np.zeros(13)
    for _ in range(50):
        p = 1 / (1 + np.exp(-full @ beta))
        beta += np.linalg.solve((full * (p * (1 - p))[:, None]).T @ full + np.diag(ridge), full.T @ (y - p) - ridge * beta)
    assert np.allclose(got, beta, atol=1e-5)


def test_pieces_are_found_in_one_pass():
    pieces = deobfuscation.Pieces(["stupid", "idiot", "id"])
    assert list(pieces.found("you st up id man, i di ot", set())) == ["idiot", "stupid"]
    assert list(pieces.found("you st up id man", {"stupid"})) == []
    assert list(pieces.found("best upidity", set())) == [] and list(deobfuscation.Pieces([]).found("any", set())) == []


def test_texts_without_a_telling_word_are_ranked(llm_spark):
    """A word that 6 of 40 toxic and 1 of 60 clean texts have is not telling among some hundred features, but it has a weight."""
    plain = " ".join(f"{a}{b}{c}{b}r" for a in "bdfgk" for b in "aeiou" for c in "lmnp")
    rows = [(i, f"{plain} {'idiot' if i < 30 else ''} {'zorblat' if i < 6 or i == 99 else ''} u{i}x", int(i < 40)) for i in range(100)]
    df = llm_spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert "zorblat" in model.features and "zorblat" not in model.telling and "idiot" in model.telling
    asked = llm_spark.createDataFrame([(0, "quiet zorblat morning"), (1, "quiet morning")], "doc_id long, text string")
    score = {r.doc_id: r.s for r in asked.select("doc_id", toxicity.score(model, F.col("text")).alias("s")).collect()}
    assert score[1] < score[0]


def test_words_that_cannot_be_wanted_are_not_restored():
    from talkweave.llm import deobfuscation, toxicity

    text = "the good idiot was really a fool and stupid people called hello to the book keeper " * 20
    costs = deobfuscation.trigram_costs(deobfuscation.trigram_counts(text.encode()))
    odd = "the iddiot waas a foool stuppid, helllo! h3llo boook$ reallly (good) kkeeper sstupid aäßéé ééa coolness"
    every = toxicity._Reader(costs).features(odd)
    for wanted in ({"idiot"}, {"^foo", "hello"}, {"^stup", "^ree", "book"}, every, {"none"}):
        reader = toxicity._Reader(costs, frozenset(wanted))
        assert reader.features(odd) == every & wanted
    calls = []
    reader = toxicity._Reader(costs, frozenset({"idiot", "^stup"}))
    restore = reader.decoder.restore
    reader.decoder.restore = lambda x: calls.append(x) or restore(x)
    reader.features(odd)
    assert sorted(calls) == ["(good)", "boook$", "h3llo", "iddiot", "sstupid", "stuppid"]
    assert len(reader.decoder.runs) <= deobfuscation._RUNS
