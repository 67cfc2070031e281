"""Substring joins: which needles occur in which texts.

A needle can only occur where all of its character grams occur, so candidates come
from an equality join on one gram of each needle (the rarest of several) and are then verified.
Keywords of questions are many and short, and most pages have hundreds of them: there
pages pass one automaton of the keywords of a bounded block of questions.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

GRAMS = 32  # of a needle, evenly spaced, of which the rarest finds candidates
QUESTIONS = 4096  # in one automaton
_NUMBER = itemgetter(1)  # of a keyword that was found
_FIRST = 64  # texts that tell which keywords are frequent
_FLUSH = 1 << 17  # scores at once
_TEXT = 1 << 22  # characters of pages at once


def _grams(texts: DataFrame, sizes: range) -> DataFrame:
    """Hashes (text_id, gram) of the distinct grams of these lengths; a text has none that are longer than itself."""
    found = F.flatten(F.array(*[F.regexp_extract_all(F.col("text"), F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1)) for k in sizes]))
    return texts.select("text_id", F.explode(F.array_distinct(F.transform(found, lambda g: F.xxhash64(g)))).alias("gram"))


def contains_join(needles: DataFrame, texts: DataFrame, n: int = 4, proper: bool = False,
                  shortest: int = 1) -> DataFrame:
    """Pairs (needle_id, text_id) where the needle occurs in the text.

    ``needles``: needle_id, needle; ``texts``: text_id, text. ``proper`` leaves out
    needles as long as the text. Needles shorter than ``n`` are matched whole;
    ``shortest`` is the length of the shortest needle, if known.
    """
    needles = needles.filter(F.length("needle") >= max(shortest, 1)).withColumn("_needle", F.xxhash64("needle"))
    last = F.greatest(F.length("needle") - n, F.lit(0))
    places = F.sequence(F.lit(0), last, F.greatest(F.ceil(last / (GRAMS - 1)).cast("int"), F.lit(1)))
    own = needles.filter(F.length("needle") >= n).select("needle_id", "_needle", F.explode(F.transform(places, lambda p: F.xxhash64(F.col("needle").substr(p + 1, F.lit(n))))).alias("gram"))
    frequency = _grams(texts, range(n, n + 1)).groupBy("gram").agg(F.count(F.lit(1)).alias("_df"))
    # a needle with a gram that no text has drops out here
    rarest = own.join(frequency, "gram", "left").groupBy("needle_id", "_needle").agg(
        F.min(F.struct(F.coalesce("_df", F.lit(0)).alias("df"), F.col("gram").alias("gram"))).alias("_r")).filter("_r.df > 0")
    long_keys = rarest.select("needle_id", "_needle", F.col("_r.gram").alias("gram"))
    short_keys = needles.filter(F.length("needle") < n).select("needle_id", "_needle", F.xxhash64("needle").alias("gram"))
    candidates = _grams(texts, range(min(max(shortest, 1), n), n + 1)).join(long_keys.unionByName(short_keys), "gram").drop("gram")
    checked = candidates.join(needles, ["needle_id", "_needle"]).join(texts, "text_id").filter(F.contains("text", F.col("needle")))
    if proper:
        checked = checked.filter(F.length("needle") < F.length("text"))
    return checked.select("needle_id", "text_id")


class _Searched:
    """The keywords of a block of questions as one automaton.

    A keyword that the first titles and texts have four times or more on average leaves it: looking for it alone ends at its first
    place, while the automaton stops at all of them.
    """

    def __init__(self, lists: list[list[str]]) -> None:
        asking: dict[str, list[int]] = {}
        for i, keywords in enumerate(lists):
            for k in keywords:
                if k:
                    asking.setdefault(k, []).append(i)
        self.n_questions = len(lists)
        self.sizes = np.array([len(x) for x in asking.values()], dtype=np.int64)  # questions that ask for a keyword
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.asked = np.array([i for x in asking.values() for i in x], dtype=np.int64)
        self.keywords = list(asking)
        self.counts = np.zeros(len(asking), dtype=np.int64)  # places in the first texts
        self.n_first = 0
        self._sort(np.zeros(len(asking), dtype=bool))

    def _sort(self, often: np.ndarray) -> None:
        self.often = [(k, n) for n, k in enumerate(self.keywords) if often[n]]
        self.words = ahocorasick.Automaton()
        for number, k in enumerate(self.keywords):
            if not often[number]:
                self.words.add_word(k, number)
        self.words.make_automaton()
        self.n_words = len(self.words)

    def _found(self, text: str | None) -> set[int]:
        """Numbers of the keywords in a text."""
        if not text:
            return set()
        numbers = map(_NUMBER, self.words.iter(text)) if self.n_words else ()
        if self.n_first >= _FIRST:
            out = set(numbers)
            out.update([n for k, n in self.often if k in text])
            return out
        places = list(numbers)
        np.add.at(self.counts, places, 1)
        self.n_first += 1
        if self.n_first == _FIRST:
            self._sort(self.counts >= 4 * _FIRST)
        return set(places)

    def scores(self, pages: list[list[tuple[str | None, str | None]]]) -> tuple[np.ndarray, ...]:
        """Pages (by place) and questions with a keyword in them, and their hits in titles, in texts and in either.

        A page is one row (title, text); where its id repeats, a hit counts once for every row that has the keyword.
        """
        found: tuple[list, ...] = ([], [], [])  # in titles, in texts, in titles only
        for rows in pages:
            seen = [(self._found(title), self._found(text)) for title, text in rows]
            if len(seen) == 1:
                titles, texts = seen[0]
                numbers = (titles, texts, titles - texts)
            else:
                copies = Counter(n for titles, texts in seen for n in titles | texts)
                numbers = tuple([n for row in seen for n in of(row) for _ in range(copies[n])]
                                for of in (lambda r: r[0], lambda r: r[1], lambda r: r[0] - r[1]))
            for of, x in zip(found, numbers):
                of.append(x)
        in_title, in_text, more = (self._asked(x) for x in found)
        either = in_text + more
        hit = np.flatnonzero(either)
        return hit // max(self.n_questions, 1), hit % max(self.n_questions, 1), in_title[hit], in_text[hit], either[hit]

    def _asked(self, found: list) -> np.ndarray:
        """How often each question asks for the keywords found in each page, page after page."""
        numbers = np.fromiter(chain.from_iterable(found), dtype=np.int64)
        page = np.repeat(np.arange(len(found)), [len(x) for x in found])
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[numbers] - (ends - sizes), sizes)
        return np.bincount(np.repeat(page * self.n_questions, sizes) + self.asked[place], minlength=len(found) * self.n_questions)


def _scored(names: list[str]):
    """Scores of sorted rows: in each part its questions come first, then pages, equal ids side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, asked, lists, searched = None, [], [], None
        page, ids, pages = None, [], []
        types: list[pa.DataType] = []

        def given() -> Iterator[pa.RecordBatch]:
            if pages:
                place, hit, *sums = searched.scores(pages)
                if len(hit):
                    columns = [pa.array(asked, types[0]).take(pa.array(hit)), pa.array(ids, types[1]).take(pa.array(place))]
                    yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x.astype(np.float64)) for x in sums)], names=names)
                ids.clear()
                pages.clear()

        held = 0  # pages at once: so many that their scores and their texts stay bounded
        for batch in batches:
            types = [batch.schema.field("question").type, batch.schema.field("page").type]
            for p, is_page, question, keywords, i, title, text in zip(*(batch.column(c).to_pylist() for c in ("part", "is_page", "question", "keywords", "page", "title", "text"))):
                again = bool(pages) and p == part and i == page
                if pages and not again and (p != part or (len(pages) + 1) * len(asked) > _FLUSH or held > _TEXT):
                    yield from given()
                    held = 0
                if p != part:
                    part, asked, lists, searched = p, [], [], None
                if not is_page:
                    asked.append(question)
                    lists.append(keywords)
                elif asked:
                    if searched is None:
                        searched = _Searched(lists)
                    if not again:
                        page = i
                        ids.append(i)
                        pages.append([])
                    pages[-1].append((title, text))
                    held += len(title or "") + len(text or "")
        yield from given()

    return run


def keyword_scores(pages: DataFrame, questions: DataFrame) -> DataFrame:
    """Rows (question, page, title_score, content_score, score): how many keywords a page has, for pairs with any.

    ``pages``: page, title, text (lower case); ``questions``: question, keywords (array). Pages are dealt evenly to all tasks
    by their id, once for each block of ``QUESTIONS`` questions, and stream past the block's automaton; what a task holds is
    one block and a few pages. Pages without an id are left out.
    """
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = questions.select("question", "keywords").filter(F.size("keywords") > 0)
    blocks = 1 + asked.count() // QUESTIONS
    parts = 4 * tasks  # a block's pages, a task each
    first = F.pmod(F.xxhash64("question"), F.lit(blocks)) * parts
    block_rows = asked.select(F.explode(F.sequence(first, first + parts - 1)).alias("part"), F.lit(False).alias("is_page"), "question", "keywords")
    own = F.pmod(F.xxhash64("page"), F.lit(parts))
    page_rows = pages.filter(F.col("page").isNotNull()).select(
        F.explode(F.sequence(own, own + parts * (blocks - 1), F.lit(parts).cast("long"))).alias("part"), F.lit(True).alias("is_page"), "page", "title", "text")
    rows = page_rows.unionByName(block_rows, allowMissingColumns=True).select("part", "is_page", "question", "keywords", "page", "title", "text")
    # hashes of a few part numbers would leave some tasks empty and give others several parts
    dealt = rows.repartitionById(parts, (F.col("part") % parts).cast("int")).sortWithinPartitions("part", "is_page", "page")
    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for df, c in ((questions, "question"), (pages, "page"))]
    scores = ["title_score", "content_score", "score"]
    return dealt.mapInArrow(_scored(["question", "page", *scores]), ", ".join([*kinds, *(f"{c} double" for c in scores)]))


def keyword_hits(pages: DataFrame, keywords: DataFrame) -> DataFrame:
    """Rows (page_id, keyword, in_title, in_text) for every keyword found in a page.

    ``pages``: page_id, title, text (lower case), one row per page; ``keywords``: keyword.
    """
    asked = keywords.select(F.col("keyword").alias("question"), F.array("keyword").alias("keywords")).filter(F.length("keyword") > 0).distinct()
    found = keyword_scores(pages.select(F.col("page_id").alias("page"), "title", "text"), asked)
    return found.select(F.col("page").alias("page_id"), F.col("question").alias("keyword"),
                        (F.col("title_score") > 0).alias("in_title"), (F.col("content_score") > 0).alias("in_text"))
