"""Hard negatives by a threshold join over an inverted index of vectors (after L2AP).

Vectors become integers; a score is an inner product. Rows are packed into blocks, and every block keeps an
inverted index: dimensions in order of their energy over the whole table, and in each dimension's list only
the rows whose remaining norm could still reach the threshold; what the suffix norm rules out is not
indexed. A block of anchors meets a block of rows in one task: partial scores are added up one group of
dimensions at a time, and a pair is dropped as soon as its score and the norms that remain on both sides
cannot reach the threshold (or cannot come down to the window's upper end). Only survivors are completed.

Thresholds begin high and are lowered for the anchors whose windows are not full, until all are full or
nothing is left below. Each block passes on at most as many rows as a window holds, so a window's
rows are exact whatever the number of copies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from talkweave.llm.common import arrow_rows, kept

ROW_BLOCK = 8192
ANCHOR_BLOCK = 1024
DIMENSIONS = 8  # added at once
LIMIT = 1 << 26  # of a component: sums stay in 64 bits
_BLOCK = "block long, n int, ids binary, nulls binary, rows binary, labels binary, size int, vectors binary"
#: Shares of the largest score an anchor can have at which the search for positives begins and goes on.
POSITIVE_LEVELS = (0.5, 0.3, 0.15, 0.0)
#: Shares of a positive's score at which the search for its negatives begins and goes on, above the lower end.
NEGATIVE_LEVELS = (0.8, 0.65, 0.45)


def quantised(embeddings: DataFrame, scale: int = 256, shift_every: int = 7, labels: int = 10) -> DataFrame:
    """``row``, ``vec_id``, ``label``, ``vector`` (integers: the floor of ``scale`` times the component).

    Rows with a null label, a null vector or a component that is null or not finite are left out. Where
    ``vec_id`` is divisible by ``shift_every`` the label is the next one of ``labels``. Components stay
    within 2^26. ``row`` tells rows that repeat an id apart.
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    shifted = F.when(F.col("vec_id") % shift_every == 0, F.pmod(F.col("label") + 1, F.lit(labels))).otherwise(F.col("label"))
    whole = F.transform(x, lambda v: F.greatest(F.least(F.floor(v.cast("double") * scale), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int"))
    rows = embeddings.filter(F.col("label").isNotNull() & x.isNotNull()).filter(finite)
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"),
                       shifted.cast("long").alias("label"), whole.alias("vector"))


def _pack(size: int, rows_per_block: int):
    """Rows of a task as blocks of matrices; shorter vectors are filled with zeros."""

    def block(number: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        matrix = np.zeros((table.num_rows, size), dtype="<i4")
        for i, v in enumerate(table.column("vector").to_pylist()):
            matrix[i, :len(v)] = v
        ids = table.column("vec_id")
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([table.num_rows], pa.int32()), pa.array([ids.fill_null(0).to_numpy().astype("<i8").tobytes()]),
             pa.array([ids.is_null().to_numpy().tobytes()]), pa.array([table.column("row").to_numpy().astype("<i8").tobytes()]),
             pa.array([table.column("label").to_numpy().astype("<i8").tobytes()]), pa.array([size], pa.int32()), pa.array([matrix.tobytes()])],
            names=["block", "n", "ids", "nulls", "rows", "labels", "size", "vectors"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, number = [], 0, 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, rows_per_block - n)
                held.append(part)
                n += part.num_rows
                batch = batch.slice(part.num_rows)
                if n == rows_per_block:
                    yield block(number, held)
                    held, n, number = [], 0, number + 1
        if n:
            yield block(number, held)

    return run


def packed(rows: DataFrame, size: int, rows_per_block: int, n_rows: int) -> DataFrame:
    """Blocks of at most ``rows_per_block`` rows, dealt by a hash of the row, numbered from 0."""
    tasks = max(1, -(-n_rows // rows_per_block))
    with arrow_rows(rows.sparkSession, 2048):
        blocks = kept(rows.repartition(tasks, "row").mapInArrow(_pack(size, rows_per_block), _BLOCK).withColumn("block", F.monotonically_increasing_id()))
    # There are few blocks, so that numbering them in one task costs nothing.
    order = blocks.select("block").withColumn("number", (F.row_number().over(Window.orderBy("block")) - 1).cast("long"))
    return blocks.join(order, "block").drop("block").withColumnRenamed("number", "block")


@dataclass
class Block:
    ids: np.ndarray
    nulls: np.ndarray
    rows: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray  # int64, dimensions in order of energy
    rest: np.ndarray  # rest[k]: norm of the dimensions from k * DIMENSIONS on

    @classmethod
    def read(cls, row: dict, side: str, order: np.ndarray) -> Block:
        n, size = row[f"{side}_n"], row[f"{side}_size"]
        vectors = np.frombuffer(row[f"{side}_vectors"], dtype="<i4").reshape(n, size).astype(np.int64)[:, order]
        squares = np.add.accumulate((vectors.astype(np.float64) ** 2)[:, ::-1], axis=1)[:, ::-1]
        starts = list(range(0, size, DIMENSIONS))
        rest = np.zeros((len(starts) + 1, n))
        for k, at in enumerate(starts):
            rest[k] = np.sqrt(squares[:, at])
        return cls(*(np.frombuffer(row[f"{side}_{c}"], dtype=t) for c, t in (("ids", "<i8"), ("nulls", "?"), ("rows", "<i8"), ("labels", "<i8"))), vectors, rest)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of rows; in floating point where no sum can pass 2^53."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def threshold_join(anchors: Block, rows: Block, low: np.ndarray, high: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the ``allowed`` pairs with ``low`` <= score <= ``high`` of the anchor.

    ``slack`` makes up for the rounding of norms: a pair is only dropped if it is out of reach for sure.
    """
    slack = 1.0
    groups = len(anchors.rest) - 1
    none = np.zeros(0, dtype=np.int64)
    if not groups or not len(anchors.ids) or not len(rows.ids):
        a, r = np.nonzero(allowed & (low[:, None] <= 0) & (high[:, None] >= 0)) if not groups else (none, none)
        return a, r, np.zeros(len(a), dtype=np.int64)
    least, longest = float(low.min()), float(anchors.rest[0].max(initial=0.0))
    # A row stays in the lists of a group as long as what is left of it could reach the lowest threshold alone.
    indexed = rows.rest[:groups] * longest + slack >= least
    listed = np.flatnonzero(indexed[0])
    score = _product(anchors.vectors[:, :DIMENSIONS], rows.vectors[listed, :DIMENSIONS])
    reach = np.multiply.outer(anchors.rest[1], rows.rest[1, listed]) + slack
    a, r = np.nonzero(allowed[:, listed] & (score + reach >= low[:, None]) & (score - reach <= high[:, None]))
    score, r = score[a, r], listed[r]
    for k in range(1, groups):
        if not len(a):
            break
        here = slice(k * DIMENSIONS, (k + 1) * DIMENSIONS)
        score = score + np.einsum("ij,ij->i", anchors.vectors[a, here], rows.vectors[r, here])
        reach = anchors.rest[k + 1, a] * rows.rest[k + 1, r] + slack
        live = (score + reach >= low[a]) & (score - reach <= high[a])
        a, r, score = a[live], r[live], score[live]
    inside = (score >= low[a]) & (score <= high[a])
    return a[inside], r[inside], score[inside]


def _first(group: np.ndarray, score: np.ndarray, null: np.ndarray, vec_id: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` rows of each group: high scores first, then small ids (null last), then rows."""
    order = np.lexsort((row, vec_id, null, -score, group))
    sorted_group = group[order]
    starts = np.flatnonzero(np.concatenate(([True], sorted_group[1:] != sorted_group[:-1]))) if len(order) else np.zeros(0, dtype=int)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < k]


def _joined(order: np.ndarray, names: Sequence[str], work: Callable[[Block, Block, dict], list[np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pair = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                found = work(Block.read(pair, "a", order), Block.read(pair, "r", order), pair)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=list(names))

    return run


def _pairs_of_blocks(anchors: DataFrame, rows: DataFrame, n_blocks: int, extra: Sequence[str] = ()) -> DataFrame:
    """Each block of anchors beside each block of rows: the smaller side goes to where the rows are."""
    left = anchors.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("_to"),
                          *(F.col(c).alias(f"a_{c}") for c in ("n", "ids", "nulls", "rows", "labels", "size", "vectors", *extra)))
    right = rows.select(F.col("block").alias("_to"), *(F.col(c).alias(f"r_{c}") for c in ("n", "ids", "nulls", "rows", "labels", "size", "vectors")))
    return left.hint("shuffle_hash").join(right, "_to").drop("_to")


def _top_positives(order: np.ndarray, k: int, level: float, longest: float):
    """Rows of the anchor's label that score at least ``level`` of the most an anchor can score."""

    def work(a: Block, r: Block, _: dict) -> list[np.ndarray]:
        top = a.rest[0] * longest
        low = np.ceil(level * top) if level > -1 else -top - 2
        allowed = (a.labels[:, None] == r.labels[None, :]) & (a.rows[:, None] != r.rows[None, :])
        i, j, score = threshold_join(a, r, low, top + 2, allowed)
        best = _first(i, score, r.nulls[j], r.ids[j], r.rows[j], k)
        i, j, score = i[best], j[best], score[best]
        return [a.rows[i], a.ids[i], r.rows[j], np.where(r.nulls[j], 0, r.ids[j]), r.nulls[j], score]

    return _joined(order, _FOUND, work)


_FOUND = ("anchor", "anchor_id", "row", "vec_id", "vec_null", "score")


def _top_negatives(order: np.ndarray, k: int):
    """Rows of other labels inside each open window; windows come as (place of the anchor, positive, low, high)."""

    def work(a: Block, r: Block, pair: dict) -> list[np.ndarray]:
        windows = np.frombuffer(pair["a_windows"], dtype="<i8").reshape(-1, 4)
        at, positive, low, high = windows.T
        least, most = np.full(len(a.ids), np.iinfo(np.int64).max), np.full(len(a.ids), np.iinfo(np.int64).min)
        np.minimum.at(least, at, low)
        np.maximum.at(most, at, high)
        i, j, score = threshold_join(a, r, least.astype(np.float64), most.astype(np.float64), a.labels[:, None] != r.labels[None, :])
        out = []
        by_anchor = np.argsort(i, kind="stable")
        i, j, score = i[by_anchor], j[by_anchor], score[by_anchor]
        begin, end = np.searchsorted(i, at), np.searchsorted(i, at, side="right")
        for w in range(len(at)):
            s = slice(begin[w], end[w])
            inside = np.flatnonzero((score[s] >= low[w]) & (score[s] <= high[w])) + begin[w]
            best = inside[_first(np.zeros(len(inside), dtype=np.int64), score[inside], r.nulls[j[inside]], r.ids[j[inside]], r.rows[j[inside]], k)]
            out.append(np.stack([np.full(len(best), positive[w]), r.rows[j[best]], np.where(r.nulls[j[best]], 0, r.ids[j[best]]), r.nulls[j[best]], score[best]], axis=1))
        found = np.concatenate(out) if out else np.zeros((0, 5), dtype=np.int64)
        return [found[:, 0], found[:, 1], found[:, 2], found[:, 3].astype(bool), found[:, 4]]

    return _joined(order, ("window", "row", "vec_id", "vec_null", "score"), work)


def _best(df: DataFrame, key: str, k: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.col("score").desc(), "vec_null", "vec_id", "row")
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _energy_order(rows: DataFrame, size: int) -> np.ndarray:
    """Dimensions by the sum of their squares over all rows, largest first."""
    sums = rows.select(F.posexplode("vector").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("double") ** 2).alias("s")).collect()  # one row a dimension
    energy = np.zeros(size)
    for r in sums:
        energy[r["at"]] = r["s"]
    return np.argsort(-energy, kind="stable")


def mine(embeddings: DataFrame, anchor_every: int = 100, positives: int = 5, negatives: int = 10, low_share: int = 30, high_share: int = 90,
         row_block: int = ROW_BLOCK, anchor_block: int = ANCHOR_BLOCK) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``embeddings`` has ``vec_id``, ``embedding``, ``label``; which rows take part is said at ``quantised``.
    Anchors are rows whose id is divisible by ``anchor_every``; rows that repeat an id are anchors one by
    one. Positives are the first ``positives`` other rows of the anchor's label, negatives the first
    ``negatives`` of other labels with ``low_share`` % <= score <= ``high_share`` % of the positive's
    score (none for a negative score). Null ids come last among ties and are never anchors. Vectors
    of unequal length count as filled with zeros. Other columns are not read. An empty table gives no rows.
    """
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark = embeddings.sparkSession
    rows = kept(quantised(embeddings))
    size, n_rows, longest = rows.agg(F.max(F.size("vector")), F.count(F.lit(1)), F.max(F.aggregate(
        "vector", F.lit(0.0), lambda s, v: s + v.cast("double") * v))).first()
    is_anchor = F.coalesce(F.col("vec_id") % anchor_every == 0, F.lit(False))
    n_anchors = rows.filter(is_anchor).count()
    if not n_anchors:
        return spark.createDataFrame([], schema)
    order, longest = _energy_order(rows, size), float(np.sqrt(longest or 0.0))
    blocks = kept(packed(rows, size, row_block, n_rows))
    n_blocks = blocks.count()
    anchors = rows.filter(is_anchor)

    found, open_, n_open = None, anchors, n_anchors
    for level in (*POSITIVE_LEVELS, -2.0):
        with arrow_rows(spark, 2):
            met = _pairs_of_blocks(packed(open_, size, anchor_block, n_open), blocks, n_blocks).mapInArrow(
                _top_positives(order, positives, level, longest), "anchor long, anchor_id long, row long, vec_id long, vec_null boolean, score long")
            here = kept(_best(met, "anchor", positives))
        full = here.groupBy("anchor").count().filter(F.col("count") >= positives).select("anchor") if level > -1 else here.select("anchor").distinct()
        done = here.join(full, "anchor", "left_semi")
        found = done if found is None else found.unionByName(done)
        if level <= -1:
            break
        open_ = kept(open_.join(full, F.col("row") == F.col("anchor"), "left_anti"))
        n_open = open_.count()
        if not n_open:
            break
    # Numbered windows (anchor, positive), with the whole numbers nearest inside their bounds.
    windows = kept(found.withColumnRenamed("row", "positive").select(
        F.monotonically_increasing_id().alias("window"), "anchor", "anchor_id", F.when(~F.col("vec_null"), F.col("vec_id")).alias("positive_id"),
        F.col("score").alias("positive_score"), F.ceil(F.expr("score * %d / 100.0D" % low_share)).alias("low"), F.floor(F.expr("score * %d / 100.0D" % high_share)).alias("high"))
        .withColumn("low", _exact_bound("low", low_share, up=True)).withColumn("high", _exact_bound("high", high_share, up=False)))

    chosen, left = None, windows.filter("low <= high")
    for level in (*NEGATIVE_LEVELS, None):
        low = F.col("low") if level is None else F.greatest(F.col("low"), F.floor(F.col("positive_score") * level).cast("long"))
        aimed = left.select("window", "anchor", low.alias("low"), "high")
        per_anchor = aimed.groupBy("anchor").agg(F.collect_list(F.struct("window", "low", "high")).alias("w"))  # at most ``positives``
        aims = anchors.join(per_anchor, F.col("row") == F.col("anchor")).drop("anchor")
        n_aims = aims.count()
        if not n_aims:
            break
        with arrow_rows(spark, 2):
            met = _pairs_of_blocks(_packed_aims(aims, size, anchor_block, n_aims), blocks, n_blocks, ("windows",)).mapInArrow(
                _top_negatives(order, negatives), "window long, row long, vec_id long, vec_null boolean, score long")
            here = kept(_best(met, "window", negatives))
        full = here.groupBy("window").count().filter(F.col("count") >= negatives).select("window") if level is not None else here.select("window").distinct()
        done = here.join(full, "window", "left_semi")
        chosen = done if chosen is None else chosen.unionByName(done)
        if level is None:
            break
        left = kept(left.join(full, "window", "left_anti"))
    if chosen is None:
        return spark.createDataFrame([], schema)
    return chosen.join(windows, "window").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.when(~F.col("vec_null"), F.col("vec_id")).alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))


def _exact_bound(name: str, share: int, up: bool):
    """The bound in whole numbers: the division above may be off by one for large scores."""
    s, n = F.col("positive_score") * share, F.col(name)
    if up:
        return F.when(n * 100 < s, n + 1).when((n - 1) * 100 >= s, n - 1).otherwise(n)
    return F.when(n * 100 > s, n - 1).when((n + 1) * 100 <= s, n + 1).otherwise(n)


def _packed_aims(aims: DataFrame, size: int, rows_per_block: int, n: int) -> DataFrame:
    """Blocks of anchors with their open windows."""
    pack = _pack(size, rows_per_block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held.append(batch)
                yield batch

        at = 0
        for block in pack(both(batches)):
            n = block.column("n")[0].as_py()
            table = pa.Table.from_batches(held)
            windows = [(i, w["window"], w["low"], w["high"]) for i, ws in enumerate(table.column("w").slice(at, n).to_pylist()) for w in ws]
            at += n
            yield block.append_column("windows", pa.array([np.array(windows, dtype="<i8").tobytes()], pa.binary()))

    tasks = max(1, -(-n // rows_per_block))
    with arrow_rows(aims.sparkSession, 2048):
        return kept(aims.repartition(tasks, "row").mapInArrow(run, _BLOCK + ", windows binary"))
