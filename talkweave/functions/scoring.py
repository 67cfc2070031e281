"""Keyword extraction and scoring expressions for retrieval."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from talkweave import rules
from talkweave.functions.text import CJK, let, strip


def extract_keywords(c: Column, stop_words: list[str] | None = None, limit: int = 40) -> Column:
    """CJK runs with their 2-4 grams, then Latin tokens; lower case, first sight kept."""
    stop = rules.STOP_WORDS if stop_words is None else stop_words
    runs = F.regexp_extract_all(strip(c), F.lit(f"[{CJK}]{{2,}}"), F.lit(0))

    def grams(run: Column, n: int) -> Column:
        spots = F.sequence(F.lit(1), F.length(run) - (n - 1))
        pieces = F.transform(spots, lambda i: run.substr(i, F.lit(n)))
        return F.when((F.length(run) >= max(n, 3)), pieces).otherwise(F.array().cast("array<string>"))

    cjk = F.flatten(F.transform(runs, lambda r: F.concat(F.array(r), grams(r, 2), grams(r, 3), grams(r, 4))))
    latin = F.regexp_extract_all(strip(c), F.lit("[A-Za-z][A-Za-z0-9_.-]+"), F.lit(0))
    tokens = F.transform(F.concat(cjk, latin), lambda t: F.lower(strip(t)))
    kept = F.filter(tokens, lambda t: (F.length(t) >= 2) & ~t.isin(stop))
    return F.slice(F.array_distinct(kept), 1, limit)


def keyword_score(keywords: Column, *texts: Column) -> Column:
    """How many keywords occur in the lower-cased, blank-joined texts."""
    blob = F.lower(F.concat_ws(" ", *texts))
    return let(blob, lambda b: F.size(F.filter(keywords, lambda k: (k != "") & F.contains(b, k)))).cast("double")


def title_matches_question(title: Column, question: Column) -> Column:
    """CJK titles by any bigram with a CJK character, Latin titles by any word over two letters."""
    both = F.struct(F.lower(title).alias("t"), F.lower(question).alias("q"))
    return let(both, lambda x: _title_matches(x["t"], x["q"]))


def _title_matches(title: Column, question: Column) -> Column:
    t, q = title, question
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: t.substr(i, F.lit(2)))
    by_pair = F.exists(pairs, lambda p: (F.length(p) == 2) & p.rlike(f"[{CJK}]") & F.contains(q, p))
    by_word = F.exists(F.split(t, "\\s+"), lambda w: (F.length(w) > 2) & F.contains(q, w))
    return F.when(title.rlike(f"[{CJK}]"), by_pair).otherwise(by_word)


def from_map(values: dict[str, float], key: Column) -> Column:
    result = F.lit(0.0)
    for name, value in values.items():
        result = F.when(key == name, F.lit(value)).otherwise(result)
    return result


def hit_confidence(n_keywords: Column, title_score: Column, content_score: Column, route: Column,
                   hit_type: Column, boost: Column | float = 0.0) -> Column:
    boost = boost if isinstance(boost, Column) else F.lit(float(boost))
    base = (title_score * 2.5 + content_score) / (n_keywords * 3.5)
    total = base + from_map(rules.ROUTE_BONUS, route) + from_map(rules.TYPE_BONUS, hit_type) + boost
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))
    return F.when(F.coalesce(n_keywords, F.lit(0)) == 0, F.lit(0.0)).otherwise(clamped)
