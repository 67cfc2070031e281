"""Names stay unique when a counter spells another row's name; ratios of upserts have a direction; containment meets thresholds."""

import hashlib

from pyspark.sql import functions as F

from talkweave.operators import docs as dc, similar as sm


def test_names_never_collide(spark):
    digits = hashlib.md5(b"x").hexdigest()[:6]
    rows = [(1, "n", "x"), (2, "n", "x"), (3, "n", "x"), (4, f"n-{digits}2", "y"), (5, "n", "x"), (6, "", "x"), (7, "kept", "z"), (8, f"n-{digits}", "q")]
    df = spark.createDataFrame(rows, "ord bigint, base string, seed string")
    reserved = spark.createDataFrame([("kept",), (f"kept-{hashlib.md5(b'z').hexdigest()[:6]}",), (f"n-{digits}3",)], "name string")
    got = {r.ord: r.file_name for r in dc.unique_names(df, F.col("base"), F.col("seed"), "ord", reserved=reserved).collect()}
    assert len(set(got.values())) == len(rows) and not set(got.values()) & {"kept", f"n-{digits}3"}
    assert got[1] == "n" and got[4] == f"n-{digits}2" and got[8] == f"n-{digits}" and got[6] == "未命名"


def faq(spark, *rows):
    return spark.createDataFrame([(o, q, c) for o, q, c in rows], "ord bigint, question string, category_id string")


def test_containment_meets_the_thresholds(spark):
    faqs = faq(spark, (1, "install the software", "a"), (2, "install the software on the new machine please", "b"), (3, "how to install the software", "a"))
    pairs = lambda t: {(r.left, r.right): r.score for r in sm.similar_question_pairs(faqs, t).collect()}
    low = pairs(0.68)
    assert low[1, 2] == 0.85 and low[1, 3] == 0.85
    assert (1, 2) not in pairs(0.8) and pairs(0.8)[1, 3] == 0.85  # other categories need 0.92
    assert not {(1, 2), (1, 3)} & set(pairs(0.86))


def test_ratio_is_new_against_existing(spark):
    items = spark.createDataFrame([(1, "tide"), (2, "diet")], "ord bigint, norm string")
    got = {(r.left, r.right): r.score for r in sm.ratio_pairs(items, 0.2, both_ways=True).collect()}
    assert got == {(1, 2): 0.25, (2, 1): 0.5}
