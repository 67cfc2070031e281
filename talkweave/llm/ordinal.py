"""Quality as an ordinal grade: a cumulative-link model on hashed text.

P(grade <= k) = sigmoid(threshold_k - s(text)) with ordered thresholds and one score s for all grades. s is
linear in hashed features: the distinct tokens of a text (word and beginning, over the root of their
number), the shapes of its tokens (as shares), and how often tokens repeat. The weights are fitted on at
most ``max_train`` graded documents; everything else runs in tasks.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from talkweave.llm.common import kept, whole_text
from talkweave.llm.toxicity import held_out

BUCKETS = 1 << 18
REMEMBERED = 300_000  # tokens a worker remembers


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending; one fewer than grades


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % BUCKETS


def _token_buckets(token: str) -> tuple[int, ...]:
    word = re.sub(r"[\W\d_]+", "", token).lower()
    return (_bucket("w" + word), _bucket("^" + word[:4])) if word else (_bucket("s" + token),)


def _shape_bucket(token: str) -> int:
    shape = re.sub(r"[^\W\d_a-zà-öø-ÿ]", "A", re.sub(r"\d", "0", token))
    shape = re.sub(r"[^\W\d_A]", "a", shape)
    return _bucket("#" + re.sub(r"(.)\1+", r"\1", shape)[:16])


def _bins(tokens: list[str], distinct: int) -> tuple[int, int]:
    """Buckets for the share of tokens that are repeats and for the order of size."""
    repeats = 0 if not tokens else int(10 * (1 - distinct / len(tokens)))
    return _bucket(f"repeats {repeats}"), _bucket(f"size {len(tokens).bit_length()}")


def features(text: str) -> dict[int, float]:
    """Hashed features of a text; the empty text has its bins alone."""
    tokens = text.split()
    distinct = set(tokens)
    found: Counter[int] = Counter()
    for t in distinct:
        for b in _token_buckets(t):
            found[b] += 1 / len(distinct) ** 0.5
    for t in tokens:
        found[_shape_bucket(t)] += 1 / len(tokens)
    for b in _bins(tokens, len(distinct)):
        found[b] += 1.0
    return dict(found)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_arrays(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int, steps: int = 200,
               rate: float = 0.1, penalty: float = 1e-4) -> OrdinalModel:
    """Full-batch Adam on the penalised likelihood; thresholds are a first one and positive gaps."""
    used, column = np.unique(bucket, return_inverse=True)
    share = np.array([(np.sum(grade <= k) + 0.5) / (len(grade) + 1) for k in range(grades - 1)])
    start = np.log(share / (1 - share))
    state = np.concatenate((np.zeros(len(used)), start[:1], np.log(np.maximum(np.diff(start), 1e-2))))
    n, m, v = len(used), np.zeros(len(state)), np.zeros(len(state))
    for t in range(1, steps + 1):
        gaps = np.exp(state[n + 1:])
        cuts = np.concatenate(([-np.inf], state[n] + np.concatenate(([0.0], np.cumsum(gaps))), [np.inf]))
        s = np.bincount(row, weights=state[:n][column] * value, minlength=len(grade))
        upper, lower = _sigmoid(cuts[grade + 1] - s), _sigmoid(cuts[grade] - s)
        mass = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / mass, lower * (1 - lower) / mass
        slope = np.zeros(len(state))
        slope[:n] = np.bincount(column, weights=value * (du - dl)[row], minlength=n) / len(grade) + penalty * state[:n]
        by_cut = np.array([(-du[grade == k].sum() + dl[grade == k + 1].sum()) / len(grade) for k in range(grades - 1)])
        slope[n] = by_cut.sum()
        slope[n + 1:] = np.cumsum(by_cut[::-1])[::-1][1:] * gaps
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        state -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(BUCKETS)
    weights[used] = state[:n]
    return OrdinalModel(weights, state[n] + np.concatenate(([0.0], np.cumsum(np.exp(state[n + 1:])))))


def fit(docs: DataFrame, ratings: DataFrame, grades: int, max_train: int = 5000) -> OrdinalModel:
    """Model from ``docs`` (``doc_id``, ``text``) and ``ratings`` (``doc_id``, ``grade``: 0 to ``grades`` - 1).

    Ratings that are null or without a document are skipped; of several for an id the lowest counts. At
    most ``max_train`` ratings are used, those of the smallest id hash. Without ratings all grades are
    equally likely for every text.
    """
    chosen = (ratings.filter(F.col("grade").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("grade").alias("_grade"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train).select(F.col("doc_id").alias("_id"), "_grade"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_grade"), pa.array([list(f) for f in found], pa.list_(pa.int32())), pa.array([list(f.values()) for f in found], pa.list_(pa.float32()))],
                names=["doc_id", "grade", "buckets", "counts"])

    rows = docs.select(F.col("doc_id").alias("_id"), whole_text().alias("text")).join(F.broadcast(chosen), "_id")
    sample = kept(rows.select(F.col("_id").cast("long"), F.col("_grade").cast("int"), "text").mapInArrow(
        run, "doc_id long, grade int, buckets array<int>, counts array<float>"))
    got = sample.orderBy("doc_id").toArrow()  # at most max_train documents
    if got.num_rows == 0:
        return OrdinalModel(np.zeros(BUCKETS), np.log(np.arange(1, grades) / np.arange(grades - 1, 0, -1)))
    lists = got.column("buckets").combine_chunks()
    row = np.repeat(np.arange(got.num_rows), np.diff(np.asarray(lists.offsets)))
    value = np.asarray(got.column("counts").combine_chunks().flatten(), dtype=np.float64)
    return fit_arrays(row, np.asarray(lists.flatten()), value, got.column("grade").to_numpy().astype(np.int64), grades)


class _Scorer:
    """Score of texts, with a bounded memory of what tokens and shapes weigh."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights = weights
        self.token: dict[str, float] = {}
        self.shape: dict[str, float] = {}

    def _weight(self, memory: dict[str, float], token: str, work) -> float:
        found = memory.get(token)
        if found is None:
            found = work(token)
            if len(memory) < REMEMBERED:
                memory[token] = found
        return found

    def score(self, text: str) -> float:
        tokens = text.split()
        counts = Counter(tokens)
        total = float(sum(self.weights[b] for b in _bins(tokens, len(counts))))
        if not tokens:
            return total
        words = sum(self._weight(self.token, t, lambda t: float(sum(self.weights[b] for b in _token_buckets(t)))) for t in counts)
        shapes = sum(n * self._weight(self.shape, t, lambda t: float(self.weights[_shape_bucket(t)])) for t, n in counts.items())
        return total + words / len(counts) ** 0.5 + shapes / len(tokens)


def tail_probabilities(model: OrdinalModel, text: Column) -> Column:
    """P(grade >= k) for k = 1, 2, ... as an array of a text; null counts as empty."""
    weights, thresholds = model.weights, model.thresholds

    @F.pandas_udf("array<double>")
    def tails(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = _Scorer(weights)
        for texts in batches:
            s = np.array([scorer.score(t) for t in texts], dtype=np.float64)
            yield pd.Series(list(_sigmoid(s[:, None] - thresholds[None, :])))

    return tails(F.coalesce(text, F.lit("")))


def grade_documents(docs: DataFrame, ratings: DataFrame, grades: int, least: int = 1, threshold: float = 0.5, max_train: int = 5000) -> DataFrame:
    """Grades of every row: ``doc_id``, ``held_out``, ``expected_grade``, ``tails`` (P(grade >= k), k from 1), ``selected``
    (P(grade >= ``least``) reaches ``threshold``).

    Ratings of held-out rows are not learned from. A null text is empty and graded by its bins. Rows that
    repeat an id are graded one by one; other columns are not read. An empty table gives no rows.
    """
    model = fit(docs, ratings.filter(~held_out(F.col("doc_id"))), grades, max_train)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), tail_probabilities(model, F.col("text")).alias("tails"))
    return rows.select("doc_id", "held_out", F.aggregate("tails", F.lit(0.0), lambda a, p: a + p).alias("expected_grade"), "tails",
                       (F.element_at("tails", least) >= threshold).alias("selected"))
