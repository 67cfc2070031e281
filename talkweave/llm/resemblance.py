"""Near-duplicates at a resemblance of 0.8 by the byte-position index and count filter of ``simhash``.

Texts whose five-word shingles resemble each other by 0.8 differ in about ten of a SimHash's 64 bits, spread over
all eight bytes, so no positional byte is sure to agree. The fingerprint here has 64 positional bytes that
agree with the probability of the resemblance itself: byte i is taken from the shingle that is least under
the i-th hash order. The index has one list per group of four neighbouring bytes (16 entries a document; a pair
at 0.8 misses all of them once in 5000 times). Whoever meets in a list is held against the count filter: at
least 41 of 64 bytes must agree (a pair at 0.8 falls below once in a thousand times). What passes is verified
on the whole shingle sets, so a link is always right: first pairs that span each list, then every pair of rows that
those connect and that still lie apart, so links are missed as seldom as said. Groups may join over
the links of ``simhash`` as well, whose operator finds all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from talkweave.llm import simhash
from talkweave.llm.common import arrow_rows, kept, partitions_of, whole_text
from talkweave.operators.similar import connected_components, meetings

SHINGLE = 5
RESEMBLANCE = 0.8
POSITIONS = 64
GROUP = 4
LEAST = 41  # agreeing bytes that a pair at 0.8 reaches but for one in a thousand
STRONG = 58
LEVELS = (STRONG, 52, 47, LEAST)
TRIES = 4  # first candidates for one join below the strong level; those who stay apart meet all
_STEP = 1 << 14
_BLOCK = 64
_MEMBERS = 128  # rows of a neighbourhood that meet as many at once
_MASK = (1 << 64) - 1


def _orders() -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets of the hash orders, from a fixed rule."""
    words = np.frombuffer(b"".join(xxhash.xxh64_digest(b"order", i) for i in range(2 * POSITIONS)), dtype=">u8").astype(np.uint64)
    return words[:POSITIONS] | np.uint64(1), words[POSITIONS:]


_FACTORS, _OFFSETS = _orders()


def shingle_hashes(raw: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted different hashes of a text's shingles; A-Z count as a-z, words are runs without ASCII blanks.

    Fewer words than ``shingle``: one shingle of them all; no words: none.
    """
    words = raw.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[min(shingle, len(words)) - 1:]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in zip(starts.tolist(), last.tolist())), dtype=np.uint64, count=len(last)))


def signature(hashes: np.ndarray) -> bytes:
    """Positional bytes of a set of hashes; zeros for an empty one."""
    if not len(hashes):
        return bytes(POSITIONS)
    least = np.full(POSITIONS, np.uint64(_MASK))
    for at in range(0, len(hashes), _STEP):
        least = np.minimum(least, (hashes[at:at + _STEP, None] * _FACTORS + _OFFSETS).min(axis=0))
    return ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8).tobytes()


def resemblance(a: np.ndarray, b: np.ndarray) -> float:
    """Shared share of two sorted sets; 1 for two empty ones."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _sets(shingle: int, with_fp: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("raw").to_pylist()
            sets = [shingle_hashes(t, shingle) for t in texts]
            fps = [simhash.simhash(t) if with_fp else None for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array([signature(s) for s in sets], pa.binary()),
                                              pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(fps, pa.int64())], names=["doc_id", "digest", "signature", "hashes", "fp"])

    return run


def shingle_sets(docs: DataFrame, shingle: int = SHINGLE, with_fp: bool = False) -> DataFrame:
    """``row`` (a number of its own), ``doc_id``, ``digest`` (of the text), ``signature``, ``hashes`` and, if asked for, ``fp`` (its SimHash) of every row, written once."""
    text = whole_text()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), text.cast("binary").alias("raw"))
    return kept(rows.mapInArrow(_sets(shingle, with_fp), "doc_id long, digest long, signature binary, hashes binary, fp long").withColumn("row", F.monotonically_increasing_id()))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        groups = np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype=">u4").reshape(batch.num_rows, -1)
        for g in range(groups.shape[1]):
            yield pa.RecordBatch.from_arrays([pa.array(groups[:, g].astype(np.int64) | g << 32), batch.column("row"), batch.column("signature")], names=["entry", "row", "signature"])


def _agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal bytes of each signature of ``a`` and each of ``b``."""
    return np.add.reduce(a[:, None, :] == b[None, :, :], axis=2, dtype=np.int16)


def _central_first(signatures: np.ndarray, seed: int) -> np.ndarray:
    """Members by their agreement with the most frequent byte of each position; ties in an order of the list's own."""
    common = np.array([np.bincount(column).argmax() for column in signatures.T], dtype=np.uint8)
    agreement = (signatures == common).sum(axis=1)
    return np.lexsort((np.random.default_rng(seed).random(len(signatures)), -agreement))


def list_links(rows: np.ndarray, signatures: np.ndarray, group: int = 0, seed: int = 0) -> Iterator[tuple[int, int]]:
    """First candidate pairs of one list that join all its members that could be linked, at most ``TRIES`` for each member; ``_apart`` has the others.

    Members are joined at falling levels of agreement, the count filter's being the last, so that of the ways
    to join two clusters those that agree most are taken, and those in the middle of the list's largest
    group, from which a search begins. A strong pair that agrees in an
    earlier group of bytes is left out, since that group's list joins the two already.
    """
    order = _central_first(signatures, seed)
    rows, signatures = rows[order], signatures[order]
    cluster = np.arange(len(rows))
    for level in LEVELS:
        unseen = np.ones(len(rows), dtype=bool)
        for start in range(len(rows)):
            if not unseen[start]:
                continue
            name = cluster[start]
            frontier = np.flatnonzero(cluster == name)
            unseen[frontier] = False
            while len(frontier) and unseen.any():
                here, frontier = frontier[:_BLOCK], frontier[_BLOCK:]
                left = np.flatnonzero(unseen)
                same = np.concatenate([_agreeing(signatures[here], signatures[left[at:at + 4096]]) for at in range(0, len(left), 4096)], axis=1)
                top = same.max(axis=0)
                hit = np.flatnonzero(top >= level)
                if not len(hit):
                    continue
                # Of each cluster that is reached, the member that agrees most.
                hit = hit[np.lexsort((-top[hit], cluster[left[hit]]))]
                names, first = np.unique(cluster[left[hit]], return_index=True)
                for k in hit[first].tolist():
                    b = left[k]
                    if level < STRONG:
                        # Those that agree most, and the most central: a member at the edge of a group may resemble these alone.
                        able = np.flatnonzero(same[:, k] >= LEAST)
                        likely = {*able[np.argsort(-same[able, k], kind="stable")[:TRIES // 2]].tolist(), *able[:TRIES // 2].tolist()}
                        yield from ((int(rows[here[x]]), int(rows[b])) for x in sorted(likely))
                        continue
                    a = here[same[:, k].argmax()]
                    if not (signatures[a, :GROUP * group] == signatures[b, :GROUP * group]).reshape(-1, GROUP).all(axis=1).any():
                        yield int(rows[a]), int(rows[b])
                joined = np.flatnonzero(np.isin(cluster, names))
                cluster[joined], unseen[joined] = name, False
                frontier = np.concatenate((frontier, joined))
        if (cluster == cluster[0]).all():
            return


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of rows in one list; lists come whole and one after the other."""

    def pairs(entry: np.ndarray, rows: np.ndarray, signatures: np.ndarray) -> np.ndarray:
        edges = np.flatnonzero(np.concatenate(([True], entry[1:] != entry[:-1], [True])))
        size = np.diff(edges)
        found = [np.array(list(list_links(rows[a:a + n], signatures[a:a + n], int(entry[a] >> 32), int(entry[a]))), dtype=np.int64).reshape(-1, 2)
                 for a, n in zip(edges[:-1][size > 2].tolist(), size[size > 2].tolist())]
        a = edges[:-1][size == 2]
        same = signatures[a] == signatures[a + 1]
        count = np.add.reduce(same, axis=1, dtype=np.int16)
        earlier = np.arange(POSITIONS // GROUP) < (entry[a] >> 32)[:, None]
        met = (same.reshape(len(a), POSITIONS // GROUP, GROUP).all(axis=2) & earlier).any(axis=1)  # two that share a list meet there
        near = a[(count >= LEAST) & ~(met & (count >= STRONG))]
        both = np.concatenate([*found, np.stack((rows[near], rows[near + 1]), axis=1)])
        return np.unique(np.sort(both, axis=1), axis=0)

    def batch_of(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        found = pairs(*(np.concatenate([h[k] for h in held]) for k in range(3)))
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], names=["left", "right"])

    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        entry, rows = batch.column("entry").to_numpy(), batch.column("row").to_numpy()
        signatures = np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype=np.uint8).reshape(-1, POSITIONS)
        cut = int(np.searchsorted(entry, entry[-1]))
        if cut or (held and held[-1][0][-1] != entry[0]):
            yield from batch_of([*held, (entry[:cut], rows[:cut], signatures[:cut])])
            held = []
        held.append((entry[cut:], rows[cut:], signatures[cut:]))
    if held:
        yield from batch_of(held)


def _verified(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = ([np.frombuffer(x, dtype=np.uint64) for x in batch.column(c).to_pylist()] for c in ("a", "b"))
            score = np.array([resemblance(a, b) for a, b in zip(*sets)], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("left"), batch.column("right"), pa.array(score)], names=["left", "right", "resemblance"]).filter(pa.array(score >= least))

    return run


def _sets_of(sets: DataFrame, rows: DataFrame) -> DataFrame:
    """``row`` and ``hashes`` of the rows in ``rows``. A map with a bit for each row goes to all tasks, so that the other sets are not shuffled."""
    number, bit = F.bitmap_bucket_number("row"), F.bitmap_bit_position("row")
    marked = rows.select(number.alias("_at"), bit.alias("_bit")).groupBy("_at").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    byte = F.conv(F.hex(F.substring("_map", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    there = F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(bit, F.lit(8)))), F.lit(2)) == 1
    return sets.select("row", "hashes").join(F.broadcast(marked), number == F.col("_at")).filter(there).select("row", "hashes")


def _checked(sets: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """The pairs ``found`` whose sets resemble each other by ``least`` or more, with ``resemblance``.

    Only the sets of candidates are moved on. A member of a large group may be the left side of thousands:
    skewed keys of the pairs are split at run time.
    """
    needed = kept(_sets_of(sets, found.select(F.col("left").alias("row")).union(found.select(F.col("right").alias("row")))))
    a, b = (needed.select(F.col("row").alias(side), F.col("hashes").alias(name)) for side, name in (("left", "a"), ("right", "b")))
    both = found.join(b, "right").join(a, "left").select("left", "right", "a", "b")
    with arrow_rows(sets.sparkSession, 128):  # two sets each
        return kept(both.mapInArrow(_verified(least), "left long, right long, resemblance double"))


def _labels(links: DataFrame) -> DataFrame:
    """``id`` and ``component`` of the rows that have links."""
    linked = links.select(F.col("left").alias("id")).union(links.select(F.col("right").alias("id"))).distinct()
    return connected_components(linked, links.select("left", "right"))


def joining_pairs(left: list[dict], right: list[dict] | None, least: float) -> list[tuple[int, int, float]]:
    """Pairs (row, row, resemblance) that join the components of two blocks of rows, of all that resemble each other by ``least`` or more.

    Without ``right`` the block meets itself. Every pair of different components is measured on the whole sets.
    """
    others = left if right is None else right
    sets = [np.frombuffer(x["hashes"], dtype=np.uint64) for x in (left if right is None else left + right)]
    sizes = np.array([len(x) for x in sets])
    words, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    first = 0 if right is None else len(left)
    base = ends[first] - sizes[first]
    starts, stops, theirs, n = ends[first:] - sizes[first:] - base, ends[first:] - base, ids[base:], sizes[first:]
    components = np.array([x["component"] for x in others])
    label: dict[int, int] = {}
    marks, found = np.zeros(len(words), dtype=bool), []

    def root(c: int) -> int:
        while c in label:
            c = label[c]
        return c

    for i, x in enumerate(left):
        open_ = (components != x["component"]) & (np.minimum(n, sizes[i]) >= least * np.maximum(n, sizes[i]))
        if right is None:
            open_[:i + 1] = False
        if not open_.any():
            continue
        own = ids[ends[i] - sizes[i]:ends[i]]
        marks[own] = True
        total = np.concatenate(([0], np.cumsum(marks[theirs])))
        marks[own] = False
        both = total[stops] - total[starts]
        either = n + sizes[i] - both
        score = np.where(either > 0, both / np.maximum(either, 1), 1.0)
        for j in np.flatnonzero(open_ & (score >= least)).tolist():
            a, b = root(x["component"]), root(others[j]["component"])
            if a != b:
                label[max(a, b)] = min(a, b)
                found.append((*sorted((x["row"], others[j]["row"])), float(score[j])))
    return found


def _joining(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = joining_pairs(batch.column("left")[k].as_py(), batch.column("right")[k].as_py(), least)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*found)], names=["left", "right", "resemblance"])

    return run


def _apart(sets: DataFrame, tried: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """Links between rows that candidates connect but verified links do not.

    Candidates span what passes the count filter in each list, so rows that do are connected by them. Where such a neighbourhood has several
    components, its rows meet block by block, each with every other; their sets are written once, and only links that join are given.
    """
    spark = sets.sparkSession
    near = _labels(tried).select(F.col("id").alias("row"), F.col("component").alias("near"))
    named = kept(near.join(labels, F.col("row") == F.col("id"), "left").select("row", "near", F.coalesce("component", "row").alias("component")))
    several = named.groupBy("near").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.ceil(F.count(F.lit(1)) / _MEMBERS).alias("blocks")).filter("lo < hi").select("near", "blocks")
    rows = kept(named.join(several, "near"))
    whole = rows.join(_sets_of(sets, rows), "row").select("near", "blocks", F.pmod(F.xxhash64("row"), F.col("blocks")).alias("_b"), F.struct("row", "component", "hashes").alias("x"))
    blocks = whole.groupBy("near", "blocks", "_b").agg(F.collect_list("x").alias("x"))
    parts = math.ceil(math.sqrt(8 * partitions_of(sets)))  # every part meets every other in a task of its own
    blocks = kept(blocks)
    met = meetings(blocks.filter("blocks > 1").coalesce(parts), ["near"]).select("left", "right")
    pairs = met.unionByName(blocks.filter("blocks = 1").select(F.col("x").alias("left")), allowMissingColumns=True)
    with arrow_rows(spark, 4):
        return kept(pairs.mapInArrow(_joining(least), "left long, right long, resemblance double"))


def _joined(sets: DataFrame, least: float, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Verified links that join each group, and the labels of linked rows; ``known`` are links of another kind that join rows as well."""
    def labels() -> DataFrame:
        return _labels(links.select("left", "right") if known is None else links.select("left", "right").union(known))

    spark = sets.sparkSession
    with arrow_rows(spark, 20_000):
        entries = sets.select("row", "signature").mapInArrow(_index, "entry long, row long, signature binary").repartition("entry").sortWithinPartitions("entry", "row")
        tried = kept(entries.mapInArrow(_candidates, "left long, right long").distinct())
    links = _checked(sets, tried, least)
    found = labels()
    more = _apart(sets, tried, found, least)
    if more.isEmpty():
        return links, found
    links = links.union(more)
    return links, labels()


def near_links(sets: DataFrame, least: float = RESEMBLANCE) -> DataFrame:
    """``left``, ``right`` (rows, the smaller first) and ``resemblance`` of verified links that join each group.

    ``sets`` is read several times. Links span the groups; they are not all pairs.
    """
    return _joined(sets, least)[0]


def near_duplicates(docs: DataFrame, least: float = RESEMBLANCE, shingle: int = SHINGLE, simhash_bits: int | None = None) -> DataFrame:
    """``doc_id``, ``digest`` and ``component_id`` (smallest ``doc_id`` reachable, itself included) of every row.

    A null text is empty; texts without words resemble each other fully. Rows that repeat an id are taken
    one by one; null ids belong to a component but name it only if it has no other. Other columns are not
    read. An empty table gives no rows. With ``simhash_bits`` texts whose SimHash differs in at most as many bits
    link too, all of them.
    """
    sets = shingle_sets(docs, shingle, simhash_bits is not None)
    by_bits = None
    if simhash_bits is not None:
        bits = simhash.near_components(sets.select(F.col("row").alias("doc_id"), "fp"), simhash_bits)
        by_bits = kept(bits.filter("doc_id <> component_id").select(F.col("component_id").alias("left"), F.col("doc_id").alias("right")))
    labels = _joined(sets, least, by_bits)[1]
    # Most rows stand alone: only members of groups meet by their label.
    grouped = kept(sets.select("row", "doc_id", "digest").join(labels, F.col("row") == F.col("id"), "left").drop("id"))
    named = grouped.filter("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("_least"))
    return grouped.join(named, "component", "left").select(
        "doc_id", "digest", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("_least")).alias("component_id"), "row",
        F.coalesce("component", "row").alias("component"))


def drop_near_copies(docs: DataFrame, least: float = RESEMBLANCE, shingle: int = SHINGLE, simhash_bits: int | None = None) -> DataFrame:
    """``docs`` with the document of the smallest id of each group; columns as they came.

    Rows without an id come last; of rows that repeat the id the one with the smallest digest stays, and one
    of equal rows.
    """
    found = near_duplicates(docs, least, shingle, simhash_bits)
    best = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("digest").alias("d"))).alias("w"))

    def keys(i, d) -> list:
        return [i.isNull().alias("_none"), F.coalesce(i, F.lit(0).cast("long")).alias("_id"), d.alias("_digest")]

    winners = best.select(*keys(F.col("w.i"), F.col("w.d"))).distinct()
    rows = docs.select(F.struct("*").alias("row"), *keys(F.col("doc_id").cast("long"), F.xxhash64(whole_text())))
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_none", "_id", "_digest").orderBy(F.lit(0)))).filter("_n = 1")
    return first.join(winners, ["_none", "_id", "_digest"], "left_semi").select("row.*")
