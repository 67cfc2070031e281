"""Toxicity by a noisy channel: disguised words are decoded first, then the restored text is scored.

1. A character language model is counted over the whole corpus (at most 28**3 counts come together).
2. Tokens that look disguised (signs for letters, letters apart, a letter twice or more in a row) are decoded by
   Viterbi over a lattice of what each sign may stand for, weighed by that model. Telling words are also
   found in pieces ("st up id"), as far as their letters are plain.
3. A logistic model on the presence of restored words and word beginnings gives the score. It is fitted on at most
   ``max_train`` labelled documents, chosen by a hash of their id; equal texts among them count once. Every feature
   carries a weight whose chi-square one in twenty features reaches by chance, so that texts without any telling word are
   ranked too; telling are those no more than one of all would reach so. Neither number has a cap.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from talkweave.llm.common import kept, whole_text
from talkweave.llm.deobfuscation import SYMBOLS, Decoder, Pieces, single, trigram_costs, trigram_counts

REMEMBERED = 400_000  # tokens a worker remembers


@dataclass(frozen=True)
class ToxicityModel:
    costs: np.ndarray  # of the language model
    features: tuple[str, ...]
    weights: np.ndarray
    bias: float
    telling: frozenset[str] = frozenset()  # features that are no chance finds; looked for in pieces too


def language_model(docs: DataFrame) -> np.ndarray:
    """Trigram costs from all texts of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, dtype=np.int64)
        for batch in batches:
            for raw in batch.column("raw").to_pylist():
                total += 0 if not raw else trigram_counts(raw)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["code", "n"])

    # Texts of a batch are joined first: one count array per batch instead of one per text.
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for raw in batch.column("raw").to_pylist():
                held.append(raw)
                size += len(raw)
                if size >= 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array([b" ".join(held)], pa.binary())], names=["raw"])
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([b" ".join(held)], pa.binary())], names=["raw"])

    rows = docs.select(whole_text().cast("binary").alias("raw"))
    counted = rows.mapInArrow(lambda batches: run(joined(batches)), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(SYMBOLS**3, dtype=np.int64)
    for r in counted:  # at most 28**3 rows
        counts[r["code"]] = r["n"]
    return trigram_costs(counts)


def _features(words: Iterable[str]) -> Iterator[str]:
    """Words and their beginnings of 3 to 7 letters (^), which also tell inflected forms."""
    for w in words:
        yield w
        for k in range(3, min(len(w), 8)):
            yield "^" + w[:k]


class _Reader:
    """Distinct features of restored texts, with a bounded memory of tokens."""

    def __init__(self, costs: np.ndarray, wanted: frozenset[str] | None = None, telling: frozenset[str] = frozenset()) -> None:
        self.decoder, self.wanted = Decoder(costs, None if wanted is None else self._worth), wanted
        self.single = frozenset() if wanted is None else frozenset(map(single, wanted))
        self.pieces = Pieces(w for w in telling if w.isalpha())
        self.heads = None if wanted is None else {f[1:4] for f in wanted if f.startswith("^")}  # with which a wanted beginning begins
        self.known: dict[str, tuple[str, ...]] = {}

    def _of(self, words: Iterable[str]) -> tuple[str, ...]:
        if self.wanted is None:
            return tuple(_features(words))
        out = []
        for w in words:
            if w[:3] in self.heads:
                out += [f for f in _features((w,)) if f in self.wanted]
            elif w in self.wanted:
                out.append(w)
        return tuple(out)

    def _worth(self, word: str) -> bool:
        return word in self.single or any("^" + word[:k] in self.single for k in range(1, min(len(word), 7) + 1))

    def _token(self, token: str) -> tuple[str, ...]:
        found = self.known.get(token)
        if found is None:
            found = self._of(self.decoder.words_of_token(token))
            if len(self.known) < REMEMBERED:
                self.known[token] = found
        return found

    def features(self, text: str) -> set[str]:
        low = text.lower()
        out: set[str] = set()
        for found in map(self._token, set(low.split())):
            if found:
                out.update(found)
        out.update(self._of(self.decoder.spaced_words(low)))
        out.update(self._of(list(self.pieces.found(low, out))))
        return out


def _sample(docs: DataFrame, labels: DataFrame, max_train: int) -> DataFrame:
    """(row, label, text) of at most ``max_train`` documents with a label, those of the smallest id hash; a text comes once, with its highest label."""
    marked = (labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("_label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train).select(F.col("doc_id").alias("_id"), "_label"))
    rows = docs.select(F.col("doc_id").alias("_id"), whole_text().alias("text"))
    chosen = kept(rows.join(F.broadcast(marked), "_id").select("_label", "text"))
    texts = chosen.groupBy(F.sha2("text", 256).alias("_same")).agg(F.max("_label").alias("_label"), F.first("text").alias("text"))
    return kept(texts.select(F.monotonically_increasing_id().alias("row"), "_label", "text"))


def _critical(n_features: int) -> float:
    """Chi-square (one degree of freedom) that chance exceeds for one of ``n_features``."""
    return NormalDist().inv_cdf(1 - 0.5 / max(n_features, 2)) ** 2


WEIGHED = _critical(20)


def _solve(product: Callable[[np.ndarray], np.ndarray], target: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
    """Conjugate gradients for a positive definite system given by its product and diagonal."""
    x, rest = np.zeros_like(target), target.copy()
    scaled = rest / diagonal
    way, size, goal = scaled, rest @ scaled, 1e-16 * (target @ (target / diagonal))
    for _ in range(200):
        if size <= goal:
            break
        moved = product(way)
        length = size / (way @ moved)
        x, rest = x + length * way, rest - length * moved
        scaled = rest / diagonal
        size, before = rest @ scaled, size
        way = scaled + (size / before) * way
    return x


def _weights(found: list[list[int]], y: np.ndarray, n_features: int, bias: float, penalty: float) -> np.ndarray:
    """Weights of a logistic model on sparse 0/1 features, the bias last: Newton steps on the penalised likelihood."""
    doc = np.repeat(np.arange(len(found)), [len(f) for f in found])
    feature = np.array([i for f in found for i in f], dtype=np.int64)

    def sums(v: np.ndarray) -> np.ndarray:
        return np.bincount(doc, v[feature], len(found)) + v[-1]

    def back(u: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(feature, u[doc], n_features), u.sum())

    beta = np.zeros(n_features + 1)
    beta[-1] = bias
    ridge = np.full(n_features + 1, penalty)
    ridge[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(sums(beta), -30, 30)))
        w = p * (1 - p) + 1e-6
        step = _solve(lambda v: back(w * sums(v)) + ridge * v, back(y - p) - ridge * beta, back(w) + ridge)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 10_000, min_docs: int = 3, penalty: float = 1.0) -> ToxicityModel:
    """Model from ``docs`` (``doc_id``, ``text``) and ``labels`` (``doc_id``, ``toxic``: 0 or 1).

    The language model counts every document; ``max_train`` bounds the labelled documents used for the
    weights, and through them the features, which the driver holds. Labels that are null or without a document are
    skipped, of several labels for an id the highest counts. Without labels every score is 0.5; with one
    class only, or no telling feature, it is the smoothed share of toxic texts.
    """
    costs = language_model(docs)
    sample = _sample(docs, labels, max_train)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(costs)
        for batch in batches:
            both = Counter(), Counter()
            for label, text in zip(batch.column("_label").to_pylist(), batch.column("text").to_pylist()):
                both[label == 1].update(reader.features(text))
            found = list(both[0].keys() | both[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), *(pa.array([c[f] for f in found], pa.int64()) for c in both)], names=["feature", "b", "a"])

    def list_found(place: dict[str, int], telling: frozenset[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader = _Reader(costs, frozenset(place), telling)
            for batch in batches:
                found = [sorted(place[f] for f in reader.features(t)) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("_label"), pa.array(found, pa.list_(pa.int32()))], names=["row", "label", "features"])

        return run

    sizes = {int(r["_label"]): r["n"] for r in sample.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    positive, negative = sizes.get(1, 0), sum(n for k, n in sizes.items() if k != 1)
    bias = float(np.log((positive + 1) / (negative + 1)))
    none = ToxicityModel(costs, (), np.zeros(0), bias)
    if not positive or not negative:
        return none
    total = positive + negative
    counts = kept(sample.select("_label", "text").mapInArrow(count, "feature string, b long, a long")
                  .groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).filter(F.col("a") + F.col("b") >= min_docs))
    chi = (F.col("a") * negative - F.col("b") * positive) ** 2 * (total / (positive * negative)) / ((F.col("a") + F.col("b")) * (total - F.col("a") - F.col("b")) + 1)
    least = _critical(counts.count())
    top = counts.filter(chi > min(WEIGHED, least)).select("feature", (chi > least).alias("telling")).orderBy("feature").collect()
    if not top:
        return none
    place, telling = {r["feature"]: i for i, r in enumerate(top)}, frozenset(r["feature"] for r in top if r["telling"])
    rows = sample.mapInArrow(list_found(place, telling), "row long, label int, features array<int>").orderBy("row").collect()  # at most max_train rows
    beta = _weights([r["features"] for r in rows], np.array([float(r["label"] == 1) for r in rows]), len(top), bias, penalty)
    return ToxicityModel(costs, tuple(place), beta[:-1], float(beta[-1]), telling)


def score(model: ToxicityModel, text: Column) -> Column:
    """Score of a text between 0 and 1, higher for toxic; null counts as empty, which gets the bias alone."""
    weights = dict(zip(model.features, model.weights.tolist()))
    wanted, telling, costs, bias = frozenset(weights), model.telling, model.costs, model.bias

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = _Reader(costs, wanted, telling)
        for texts in batches:
            sums = np.array([bias + sum(weights[w] for w in sorted(reader.features(t))) for t in texts], dtype=np.float64)
            yield pd.Series(1 / (1 + np.exp(-np.clip(sums, -30, 30))))

    return toxicity(F.coalesce(text, F.lit("")))


def restored_words(model: ToxicityModel, text: Column) -> Column:
    """The telling words and beginnings found in a text, disguised or not, as an array."""
    wanted, costs = model.telling, model.costs

    @F.pandas_udf("array<string>")
    def restored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = _Reader(costs, wanted, wanted)
        for texts in batches:
            yield pd.Series([sorted(reader.features(t)) for t in texts])

    return restored(F.coalesce(text, F.lit("")))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows that labels are not learned from: crc32 of the id as text leaves no remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_train: int = 10_000) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` (1 if ``score`` reaches ``threshold``) of every row.

    Only labels of rows that are not held out are learned from. Rows that repeat an id are scored one
    by one; other columns are not read. An empty table gives no rows.
    """
    model = fit(docs, labels.filter(~held_out(F.col("doc_id"))), max_train)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(model, F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_train: int = 10_000) -> DataFrame:
    """``docs`` without the rows whose score reaches ``threshold``; columns as they came."""
    model = fit(docs, labels.filter(~held_out(F.col("doc_id"))), max_train)
    return docs.select(F.struct("*").alias("row"), score(model, F.col("text")).alias("_score")).filter(F.col("_score") < threshold).select("row.*")
