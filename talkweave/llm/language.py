"""Language of texts by bit-sliced Bloom filters over character n-grams.

One filter holds all languages: a slot is a mask with a bit per language. An n-gram is put in by setting
its languages' bits in the slots that its hashes name; the bitwise and of these slots gives back
every language that contains it at once (and, now and then, one that does not). A text's score for a
language is its share of n-grams with that bit: a count per bit of the masks, less the hits that the
language's share of set bits lets expect by chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SIZES = (2, 3, 4)  # characters of an n-gram; a blank stands for whatever is between words
HASHES = 3
SLOTS_PER_GRAM = 8
MIN_SHARE = 1e-5  # of a language's n-grams of one size
RIVAL_SHARE = 0.05  # of the n-gram's share in the language where it is most frequent
PIECE = 1 << 20  # characters looked at in one go
_HELD = 2_000_000  # n-grams a task counts before it passes them on
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTER[0]


def _mixed(h: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread over the whole word."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(text: str) -> Iterator[np.ndarray]:
    """Hashes of all n-grams of ``text``: for every piece one array per size of ``SIZES``.

    Letters count in lower case; every run of other characters is one blank, also at both ends. N-grams
    that are blank in their middle or hold no letter are not counted.
    """
    low = f" {text} ".lower()
    keep = max(SIZES) - 1
    rest = np.zeros(0, dtype=np.uint64)
    for at in range(0, len(low), PIECE):
        points = np.frombuffer(low[at:at + PIECE].encode("utf-32-le", "surrogatepass"), dtype="<u4")
        points = np.where(_letters()[points], points, 0).astype(np.uint64)
        # The end of the last piece goes before this one, so that no n-gram is cut.
        seen, points = len(rest), np.concatenate((rest, points))
        single = np.concatenate(([True], (points[1:] != 0) | (points[:-1] != 0))) if len(points) else np.zeros(0, dtype=bool)
        seen = int(single[:seen].sum())
        points = points[single]
        blank = points == 0
        for n in SIZES:
            # Those that begin early enough to have been complete in the piece before are left out.
            first, last = max(0, seen - n + 1), len(points) - n + 1
            if last <= first:
                yield np.zeros(0, dtype=np.uint64)
                continue
            h = np.zeros(last - first, dtype=np.uint64)
            for k in range(n):
                h *= np.uint64(0x9E3779B97F4A7C15)
                h += points[first + k:last + k]
            if n == 2:
                out = blank[first:last] & blank[first + 1:last + 1]
            else:
                out = blank[first + 1:last + 1].copy()
                for k in range(2, n - 1):
                    out |= blank[first + k:last + k]
            yield _mixed(h[~out] + np.uint64(n))
        rest = points[max(0, len(points) - keep):]


@dataclass(frozen=True)
class LanguageFilter:
    languages: tuple[str, ...]
    slots: np.ndarray  # (slots, words) of masks: one word of the least width that does, or several of 64 bits
    chance: np.ndarray  # per language: share of absent n-grams that are found
    prior: np.ndarray  # per language: share of the learned documents

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """(n-grams, words): the languages that contain each."""
        out = np.take(self.slots, _slot(grams, 0, len(self.slots)), axis=0)
        for k in range(1, HASHES):
            out &= np.take(self.slots, _slot(grams, k, len(self.slots)), axis=0)
        return out


def _slot(grams: np.ndarray, k: int, slots: int) -> np.ndarray:
    return ((grams >> np.uint64(20 * k)) & np.uint64(slots - 1)).view(np.int64) if k * 20 + slots.bit_length() <= 64 else (
        (_mixed(grams + np.uint64(k)) & np.uint64(slots - 1)).view(np.int64))


def held_out(doc_id: Column, folds: int = 4, remainder: int = 2) -> Column:
    """Rows not learned from, by the checksum of the id as text; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == remainder, F.lit(False))


def gram_counts(docs: DataFrame, languages: list[str]) -> DataFrame:
    """``size``, ``language`` (its place in ``languages``), ``gram`` and how often it occurs in ``docs``.

    Tasks count first and pass on one row per n-gram and language, at most ``_HELD`` at a time.
    """
    place = {name: i for i, name in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        n_held = 0

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            grams, inverse = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            return grams, np.bincount(inverse, weights=np.concatenate([n for _, n in parts]), minlength=len(grams)).astype(np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            for (size, language), parts in held.items():
                grams, n = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), size, dtype=np.int32)), pa.array(np.full(len(grams), language, dtype=np.int32)),
                                                  pa.array(grams.view(np.int64)), pa.array(n)], names=["size", "language", "gram", "n"])

        for batch in batches:
            found: dict[tuple[int, int], list[np.ndarray]] = {}
            for name, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                for i, grams in enumerate(gram_hashes(text)):
                    found.setdefault((SIZES[i % len(SIZES)], place[name]), []).append(grams)
            for key, grams in found.items():
                values, n = np.unique(np.concatenate(grams), return_counts=True)
                held.setdefault(key, []).append((values, n))
                n_held += len(values)
            if n_held > _HELD:
                held = {key: [merged(parts)] for key, parts in held.items()}
                n_held = sum(len(p[0][0]) for p in held.values())
                if n_held > _HELD // 2:
                    yield from flush()
                    held, n_held = {}, 0
        yield from flush()

    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    counted = rows.mapInArrow(run, "size int, language int, gram long, n long")
    return counted.groupBy("size", "language", "gram").agg(F.sum("n").alias("n"))


def build_filter(languages: list[str], prior: np.ndarray, rows: list[tuple[int, int]]) -> LanguageFilter:
    """Filter from (n-gram, place of a language) rows."""
    words = max(1, -(-len(languages) // 64))
    width = next((w for w in (8, 16, 32) if len(languages) <= w), 64)
    grams = np.array([g for g, _ in rows], dtype=np.int64).view(np.uint64)
    of = np.array([i for _, i in rows], dtype=np.int64)
    n = len(np.unique(grams))
    slots = 1 << max(10, int(np.ceil(np.log2(max(1, n * SLOTS_PER_GRAM)))))
    masks = np.zeros((slots, words), dtype=np.uint64)
    for k in range(HASHES):
        np.bitwise_or.at(masks, (_slot(grams, k, slots), of // 64), np.uint64(1) << (of % 64).astype(np.uint64))
    fill = np.array([((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
    return LanguageFilter(tuple(languages), masks.astype(f"u{width // 8}"), fill**HASHES, prior)


def fit(docs: DataFrame, min_share: float = MIN_SHARE, rival_share: float = RIVAL_SHARE) -> LanguageFilter:
    """Filter from ``text`` and ``lang`` of all rows of ``docs`` where both are not null.

    A language contains an n-gram if that makes up at least ``min_share`` of its n-grams of that size
    and ``rival_share`` of the greatest share it has in any language: strays from mixed texts stay out. So
    there are at most 1 / ``min_share`` n-grams per size and language, whatever the number of documents.
    """
    learned = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = sorted((r["lang"], r["n"]) for r in learned.groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect())
    languages = [name for name, _ in sizes]
    prior = np.array([n for _, n in sizes], dtype=np.float64)
    prior /= max(1.0, prior.sum())
    if not languages:
        return build_filter([], prior, [])
    counts = gram_counts(learned, languages)
    totals = counts.groupBy("size", "language").agg(F.sum("n").alias("_total"))
    # Totals are one row per size and language; the shares of one n-gram meet where it was counted.
    shares = counts.join(totals, ["size", "language"]).withColumn("_share", F.col("n") / F.col("_total")).filter(F.col("_share") >= min_share)
    best = shares.groupBy("size", "gram").agg(F.max("_share").alias("_best"), F.collect_list(F.struct("language", "_share")).alias("_all"))
    rows = best.select("gram", F.explode(F.filter("_all", lambda s: s["_share"] >= F.col("_best") * rival_share)).alias("s")).select("gram", "s.language").toArrow()
    return build_filter(languages, prior, list(zip(rows.column("gram").to_pylist(), rows.column("language").to_pylist())))


def shares(model: LanguageFilter, text: str) -> tuple[int, np.ndarray]:
    """Number of n-grams, and per language the share it contains, corrected for chance."""
    hits, n = np.zeros(len(model.languages)), 0
    for grams in gram_hashes(text):
        n += len(grams)
        masks = model.masks(grams)
        for word in range(masks.shape[1]):
            column = np.ascontiguousarray(masks[:, word])
            for i in range(64 * word, min(len(hits), 64 * word + 64)):
                hits[i] += np.count_nonzero(column & column.dtype.type(1 << i % 64))
    if not n:
        return 0, hits
    return n, np.clip((hits / n - model.chance) / np.maximum(1e-9, 1 - model.chance), 0.0, 1.0)


def predict(model: LanguageFilter, text: str | None) -> tuple[str, float]:
    """(language, score): the score is the best share over the sum of the two best, 0 for ``und``."""
    if not text or not model.languages or not any(c.isalpha() for c in text):
        return "und", 0.0
    n, found = shares(model, text)
    if not n or not found.any():
        best = int(np.argmax(model.prior))
        return model.languages[best], float(model.prior[best])
    # Equal shares go to the more frequent language, then to the first.
    order = sorted(range(len(found)), key=lambda i: (-found[i], -model.prior[i], i))
    second = found[order[1]] if len(order) > 1 else 0.0
    return model.languages[order[0]], float(found[order[0]] / (found[order[0]] + second))


def detect(model: LanguageFilter, text: Column) -> Column:
    """Struct of ``language`` and ``score`` of a text."""

    @F.pandas_udf("language string, score double")
    def language(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([predict(model, t) for t in texts], columns=["language", "score"])

    return language(text)


def identify(docs: DataFrame, folds: int = 4, remainder: int = 2) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` of every row of ``docs`` (``doc_id``, ``text``, ``lang``).

    Learned from the rows that are not held out. A null text, or one without a letter, is ``und``, and so is
    every text if there is nothing to learn from; a text without a known n-gram gets the most frequent
    language and its share as the score. Rows that repeat an id are judged one by one; other columns
    are not read. An empty table gives no rows.
    """
    out = held_out(F.col("doc_id"), folds, remainder)
    model = fit(docs.filter(~out))
    found = docs.select("doc_id", out.alias("held_out"), detect(model, F.col("text").cast("string")).alias("_found"))
    return found.select("doc_id", "held_out", F.col("_found.language").alias("lang_pred"), F.col("_found.score").alias("score"))
