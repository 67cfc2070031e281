"""Matching texts against rule dictionaries.

A dictionary is a short ordered list, so it becomes one projection with a test per
pattern; no join and no shuffle is needed, whatever the number of texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from talkweave import rules
from talkweave.functions import text as tx


def hits_per_rule(c: Column, patterns: list[str]) -> Column:
    """Number of patterns found in the lower-cased text."""
    low = F.lower(c)
    total = F.lit(0)
    for p in patterns:
        total = total + F.when(low.rlike(tx.any_of([p])), 1).otherwise(0)
    return total


def rule_counts(c: Column, dictionary: list[tuple[str, list[str]]]) -> Column:
    """Array of (ord, rule_id, n) in dictionary order."""
    return F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(rid).alias("rule_id"), hits_per_rule(c, patterns).alias("n"))
        for i, (rid, patterns) in enumerate(dictionary)
    ])


def matched_rules(c: Column, dictionary: list[tuple[str, list[str]]]) -> Column:
    """Rules with at least one hit, in dictionary order."""
    return F.filter(rule_counts(c, dictionary), lambda r: r["n"] > 0)


def rule_ids(c: Column, dictionary: list[tuple[str, list[str]]], cap: int | None = None) -> Column:
    ids = F.transform(matched_rules(c, dictionary), lambda r: r["rule_id"])
    return F.slice(ids, 1, cap) if cap else ids


def best_category(c: Column, dictionary: list[tuple[str, list[str]]], default: str = "general") -> Column:
    """Rule with most hits; ties go to the earlier rule; no hit gives the default."""
    found = matched_rules(c, dictionary)
    ranked = F.array_max(F.transform(found, lambda r: F.struct(r["n"], -r["ord"], r["rule_id"])))
    return F.coalesce(ranked["rule_id"], F.lit(default))


def category_rules(categories=None) -> list[tuple[str, list[str]]]:
    return [(cid, patterns) for cid, _, patterns in (categories or rules.CATEGORIES) if patterns]


def concept_rules(concepts=None) -> list[tuple[str, list[str]]]:
    return [(cid, patterns) for cid, _, _, patterns in (concepts or rules.CONCEPTS)]


def match_rules(df: DataFrame, c: Column, dictionary: list[tuple[str, list[str]]]) -> DataFrame:
    """One row per text and matching rule."""
    hit = F.explode(matched_rules(c, dictionary)).alias("_h")
    return df.select("*", hit).select("*", F.col("_h.ord").alias("rule_ord"), F.col("_h.rule_id").alias("rule_id"),
                                      F.col("_h.n").alias("n_hits")).drop("_h")


def keyword_ids(c: Column, dictionary: list[tuple[str, list[str]]], cap: int | None = None) -> Column:
    """Like :func:`rule_ids` for plain keywords (substring test instead of a pattern)."""
    low = F.lower(c)
    flags = []
    for rid, words in dictionary:
        test = F.lit(False)
        for w in words:
            test = test | F.contains(low, F.lit(w))
        flags.append(F.when(test, F.lit(rid)))
    ids = F.array_compact(F.array(*flags))
    return F.slice(ids, 1, cap) if cap else ids
