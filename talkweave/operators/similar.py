"""Similar texts without comparing all pairs, and clusters of them.

The similarity of two strings is 2M/(la+lb) with M matched characters in k blocks.

At the threshold at most D = (1 - threshold)(la + lb) characters of both texts are unmatched. So of D + 1 segments of
the shorter text some stand unchanged in the longer one, among them one, number i, that has exactly i unmatched
characters before it: it is moved by -i, -i + 2, .. or i places, and at most D - i unmatched characters follow.
Candidates come from an equality join of segments with windows of that length and place, without loss, and are
verified with the exact ratio. Equal texts are merged first, so copies never multiply.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from talkweave import rules
from talkweave.functions.pandas_udfs import block_pairs, gestalt_ratio, ratios
from talkweave.functions.text import norm_link_key, normalize_question
from talkweave.operators.faq import merge_faq_groups
from talkweave.operators.substring import contains_join, keyword_scores
from talkweave.session import arrow_rows, cut_lineage


SEGMENTS_FROM = 0.9  # segments are long enough to tell candidates from here on; below, most texts of a language share some
STRETCH = 16  # characters; tokens of segments tell in which stretch of a text they stand
BLOCK = 512  # texts that are compared with as many at once
MEETINGS = 64  # pairs of blocks that a task reads at once
GRAM = 8  # characters; contained texts of as many are looked for by their grams


def _unmatched(n: Column, threshold: float) -> Column:
    """Most characters that stay unmatched in two texts at the threshold that have ``n`` characters together."""
    return F.floor(n * (1.0 - threshold) + 1e-9).cast("int")


def _segment_chars(n: Column, threshold: float) -> Column:
    """Length of the segments of a text of ``n`` characters: one more of them than can stay unmatched with any longer partner."""
    longest = F.floor(n * ((2.0 - threshold) / threshold) + 1e-9)
    return F.floor(n / (_unmatched(n + longest, threshold) + 1)).cast("int")


def _segments(rows: DataFrame, threshold: float) -> DataFrame:
    """Tokens (token, _row, n, ord, i, p) of the segments of every text: number ``i``, at ``p``, once for each stretch a partner can have it in."""
    size = _segment_chars(F.col("n"), threshold)
    places = F.transform(F.sequence(F.lit(0), F.floor(F.col("n") / F.col("_size")).cast("int") - 1), lambda i: F.struct(i.alias("i"), (i * F.col("_size")).alias("p")))
    cut = rows.withColumn("_size", size).select("*", F.explode(places).alias("_s"))
    # segment i lies i characters away at most; later ones than can stay unmatched are not needed
    longest = F.floor(F.col("n") * ((2.0 - threshold) / threshold) + 1e-9)
    cut = cut.filter(F.col("_s.i") <= _unmatched(F.col("n") + longest, threshold))
    low, high = (F.floor(x / STRETCH) for x in (F.greatest(F.col("_s.p") - F.col("_s.i"), F.lit(0)), F.col("_s.p") + F.col("_s.i")))
    piece = F.col("norm").substr(F.col("_s.p") + 1, F.col("_size"))
    return cut.select("*", F.explode(F.sequence(low, high)).alias("_at")).select(
        F.xxhash64("_group", "_size", "_at", piece).alias("token"), "_row", "n", "ord", F.col("_s.i").alias("i"), F.col("_s.p").alias("p"))


def _windows(rows: DataFrame, threshold: float) -> DataFrame:
    """Tokens (token, _row, n, ord, p) of all windows of every text that can be a segment of a partner that is not longer."""
    n = F.col("n")
    shortest = F.greatest(F.ceil(n * (threshold / (2.0 - threshold)) - 1e-9).cast("int"), F.lit(1))
    sizes = F.array_distinct(F.transform(F.sequence(shortest, n), lambda m: _segment_chars(m, threshold)))
    each = rows.select("*", F.explode(sizes).alias("_size"))
    each = each.select("*", F.explode(F.sequence(F.lit(0), n - F.col("_size"))).alias("p"))
    piece = F.col("norm").substr(F.col("p") + 1, F.col("_size"))
    return each.select(F.xxhash64("_group", "_size", F.floor(F.col("p") / STRETCH), piece).alias("token"), "_row", "n", "ord", "p")


def _candidates(rows: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of rows of which a segment of the one stands in the other where few enough characters can be unmatched around it."""
    a, b = _segments(rows, threshold).alias("a"), _windows(rows, threshold).alias("b")
    shift, rest = F.col("b.p") - F.col("a.p"), F.col("b.n") - F.col("a.n")
    open_ = _unmatched(F.col("a.n") + F.col("b.n"), threshold) - F.col("a.i")
    shorter = (rest > 0) | ((rest == 0) & (F.col("a.ord") < F.col("b.ord")))
    on = (F.col("a.token") == F.col("b.token")) & shorter & (F.abs(shift) <= F.col("a.i")) & (F.pmod(shift - F.col("a.i"), F.lit(2)) == 0) & (F.abs(rest - shift) <= open_)
    return a.join(b, on).select(F.col("a._row").alias("a"), F.col("b._row").alias("b")).distinct()


def _block_ratios(threshold: float, n_keys: int, both_ways: bool, names: list[str]):
    """Ratios between the texts of two blocks; ``right`` is null where a block meets itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types = [batch.schema.field(k).type for k in range(n_keys)] + [batch.schema.field("left").type.value_type.field("ord").type] * 2 + [pa.float64()]
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                left, right = row.column("left")[0].as_py(), row.column("right")[0].as_py()
                others = left if right is None else right
                places = block_pairs([x["norm"] for x in left], None if right is None else [x["norm"] for x in right], threshold)
                met = []
                for i, j in zip(*(p.tolist() for p in places)):
                    if left[i]["ord"] == others[j]["ord"]:
                        continue
                    x, y = (left[i], others[j]) if left[i]["ord"] < others[j]["ord"] else (others[j], left[i])
                    if not both_ways:
                        met.append((x, y))
                        continue
                    met += [(a, b) for a, b in ((x, y), (y, x)) if a["asks"] and b["answers"]]
                met.sort(key=lambda p: p[1]["norm"])
                found = [(a["ord"], b["ord"], s) for (a, b), s in zip(met, ratios([(a["norm"], b["norm"]) for a, b in met], threshold)) if s >= threshold]
                if found:
                    keys = [row.column(c)[0].as_py() for c in range(n_keys)]
                    columns = [[v] * len(found) for v in keys] + [list(c) for c in zip(*found)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return run


def meetings(blocks: DataFrame, group: list[str]) -> DataFrame:
    """Each block with each other of its group once, and with none (``right`` is null) for itself. Tasks read blocks where they lie; none is shuffled."""
    left = blocks.select(*group, F.col("_b").alias("_lo"), F.col("x").alias("left"))
    right = blocks.select(*[F.col(g).alias(f"{g}_") for g in group], F.col("_b").alias("_hi"), F.col("x").alias("right"))
    # of the two orders of a pair of blocks one counts: each for half of the pairs, so that tasks have even shares
    lo, hi = F.col("_lo"), F.col("_hi")
    on = (lo == hi) | ((lo != hi) & ((lo < hi) == (F.pmod(lo + hi, F.lit(2)) == 0)))
    for g in group:
        on = on & (F.col(g) == F.col(f"{g}_"))
    return left.join(right.hint("shuffle_replicate_nl"), on).select(*group, "left", F.when(lo != hi, F.col("right")).alias("right"))


def _compared(items: DataFrame, keys: list[str], threshold: float, both_ways: bool) -> DataFrame:
    """Pairs by comparing every block of texts with every other of its group, in bounded memory and on all tasks.

    Blocks are written once and read by each task that compares them, so texts are not copied on disk, however many blocks
    there are. The pairs are written out as well, since what is read at once has to stay bounded while they are searched for.
    """
    spark = items.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    flags = [F.col(c) if c in items.columns else F.lit(True).alias(c) for c in ("asks", "answers")]
    texts = cut_lineage(items.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct("ord", "norm", *flags).alias("x")))
    group = [f"_{k}" for k in keys]
    known = texts.filter("x.ord IS NOT NULL AND x.norm IS NOT NULL")
    for g in group:
        known = known.filter(F.col(g).isNotNull())
    sizes = known.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_blocks"))
    placed = known.join(sizes, group) if group else known.crossJoin(sizes)
    blocks = placed.groupBy(*group, "_blocks", F.pmod(F.xxhash64("x.ord"), F.col("_blocks")).alias("_b")).agg(F.collect_list("x").alias("x"))
    parts = math.ceil(math.sqrt(8 * tasks))  # every part meets every other in a task of its own
    blocks = cut_lineage(blocks.repartition(parts))
    met = meetings(blocks.filter("_blocks > 1"), group)
    alone = blocks.filter("_blocks = 1").select(*group, F.col("x").alias("left"))
    alone = alone.repartition(8 * tasks) if group else alone
    pairs = met.unionByName(alone, allowMissingColumns=True).select(*[F.col(f"_{k}").alias(k) for k in keys], "left", "right")
    kind = items.schema["ord"].dataType.simpleString()
    schema = ", ".join([*(f"`{k}` {items.schema[k].dataType.simpleString()}" for k in keys), f"left {kind}", f"right {kind}", "score double"])
    with arrow_rows(spark, MEETINGS):
        return cut_lineage(pairs.mapInArrow(_block_ratios(threshold, len(keys), both_ways, [*keys, "left", "right", "score"]), schema))


def ratio_pairs(items: DataFrame, threshold: float, group: str | None = None, both_ways: bool = False) -> DataFrame:
    """Pairs (left, right, score) of distinct texts with ratio at or above ``threshold``.

    ``items``: ord, norm and optionally ``group``; ``ord`` is unique (within its group) and
    the smaller one is on the left. With ``group`` only pairs inside a group are compared. The
    ratio depends on which text comes first: the score is ratio(left, right). With ``both_ways``
    a pair comes once in each order, with the score of that order; where ``items`` has booleans ``asks`` and
    ``answers``, only in orders from one that asks to one that answers.
    """
    keys = [group] if group else []
    if threshold < SEGMENTS_FROM:
        return _compared(items, keys, threshold, both_ways)
    known = items.filter(F.length("norm") > 0).filter(F.col("ord").isNotNull())
    for k in keys:
        known = known.filter(F.col(k).isNotNull())
    hashed = F.xxhash64(*keys) if keys else F.lit(0).cast("long")
    rows = cut_lineage(known.select(*keys, "ord", "norm", F.length("norm").alias("n"), hashed.alias("_group"), F.monotonically_increasing_id().alias("_row")))
    text = rows.select(*keys, "ord", "norm", "_row")
    x, y = (text.select("_row", F.struct(*keys, "ord", "norm").alias(side)) for side in ("x", "y"))
    pairs = _candidates(rows, threshold).join(x.withColumnRenamed("_row", "a"), "a").join(y.withColumnRenamed("_row", "b"), "b")
    for k in keys:
        pairs = pairs.filter(F.col(f"x.{k}") == F.col(f"y.{k}"))
    left, right = (F.when((F.col("x.ord") < F.col("y.ord")) == first, F.col("x")).otherwise(F.col("y")) for first in (True, False))
    pairs = pairs.select(left.alias("x"), right.alias("y")).select(
        *[F.col(f"x.{k}").alias(k) for k in keys], F.col("x.ord").alias("left"), F.col("y.ord").alias("right"), F.col("x.norm").alias("_a"), F.col("y.norm").alias("_b"))
    # the check is costly per row and small in bytes: spread it over all tasks
    if both_ways:
        pairs = pairs.unionByName(pairs.select(*keys, F.col("right").alias("left"), F.col("left").alias("right"), F.col("_b").alias("_a"), F.col("_a").alias("_b")))
    tasks = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scored = pairs.repartition(tasks).withColumn("score", gestalt_ratio(threshold)("_a", "_b"))
    return scored.filter(F.col("score") >= threshold).select(*keys, "left", "right", "score")


def distinct_questions(faqs: DataFrame) -> DataFrame:
    """Entries (ord, norm, category_id) with a normalised question. Written out: they are read several times, and questions are normalised once."""
    return cut_lineage(faqs.select(F.col("ord"), normalize_question(F.col("question")).alias("norm"), "category_id")).filter("norm <> ''")


def containment_pairs(texts: DataFrame, min_chars: int = 1) -> DataFrame:
    """Pairs of distinct texts (id, norm) where one contains the other. The texts are written out, as the join reads them several times.

    Contained texts of ``GRAM`` characters or more are found by their rarest gram. The grams of fewer characters of all texts
    would be several times as many; texts pass an automaton of the shorter ones instead.
    """
    texts = cut_lineage(texts.select("id", "norm", F.monotonically_increasing_id().alias("_row")))
    shortest = max(min_chars, GRAM)
    needles = texts.filter(F.length("norm") >= shortest).select(F.col("id").alias("needle_id"), F.col("norm").alias("needle"))
    hits = contains_join(needles, texts.select(F.col("id").alias("text_id"), F.col("norm").alias("text")), n=GRAM, proper=True, shortest=shortest)
    if min_chars < GRAM:
        few = texts.filter((F.length("norm") >= min_chars) & (F.length("norm") < GRAM))
        pages = texts.select(F.col("_row").alias("page"), F.lit(None).cast("string").alias("title"), F.col("norm").alias("text"))
        found = keyword_scores(pages, few.select(F.col("_row").alias("question"), F.array("norm").alias("keywords"))).select("question", "page")
        short = few.select(F.col("_row").alias("question"), F.col("id").alias("needle_id"), F.length("norm").alias("_n"))
        whole = texts.select(F.col("_row").alias("page"), F.col("id").alias("text_id"), F.length("norm").alias("_of"))
        found = found.join(short, "question").join(whole, "page").filter("_n < _of AND needle_id IS NOT NULL AND text_id IS NOT NULL")
        hits = hits.unionByName(found.select("needle_id", "text_id"))
    return hits.select(F.least("needle_id", "text_id").alias("left"), F.greatest("needle_id", "text_id").alias("right"),
                       F.lit(rules.CONTAINMENT_SCORE).alias("score"))


def similar_question_pairs(faqs: DataFrame, threshold: float = rules.SIMILARITY) -> DataFrame:
    """Edges that connect similar questions of every length.

    Copies link to the first entry of the same normalised question. Between different
    questions: containment counts 0.85 across all categories; otherwise the ratio must
    reach the threshold inside a category, or the higher one across categories.
    """
    cross = max(rules.CROSS_CATEGORY_SIMILARITY, threshold + 0.12)
    rows = distinct_questions(faqs)
    first = rows.groupBy("norm").agg(F.min("ord").alias("id"))
    copies = rows.join(first, "norm").filter("ord <> id").select(
        F.col("id").alias("left"), F.col("ord").alias("right"), F.lit(rules.CONTAINMENT_SCORE).alias("score"))
    texts = first.withColumn("ord", F.col("id"))
    contained = containment_pairs(texts)
    # a question asked in several categories is compared in each of them
    placed = rows.select("norm", "category_id").distinct().join(first, "norm").select("category_id", "norm", F.col("id").alias("ord"))
    same = ratio_pairs(placed, threshold, "category_id").select("left", "right", "score")
    other = ratio_pairs(texts, cross)
    # containment has its own score, whatever the ratio, and meets the same thresholds
    by_ratio = same.unionByName(other).groupBy("left", "right").agg(F.max("score").alias("score")).join(contained.select("left", "right"), ["left", "right"], "left_anti")
    if rules.CONTAINMENT_SCORE < threshold:
        contained = contained.limit(0)
    elif rules.CONTAINMENT_SCORE < cross:
        mine, other_side = placed.select(F.col("ord").alias("left"), "category_id"), placed.select(F.col("ord").alias("right"), "category_id")
        shared = contained.join(mine, "left").join(other_side, ["right", "category_id"]).select("left", "right").distinct()
        contained = contained.join(shared, ["left", "right"], "left_semi")
    return copies.unionByName(contained).unionByName(by_ratio)


def _follow(hooks: DataFrame) -> DataFrame:
    """Resolve chains of hooks (id, to) to their ends; every step doubles the distance."""
    while True:
        onward = hooks.select(F.col("id").alias("to"), F.col("to").alias("_next"))
        moved = cut_lineage(hooks.join(onward, "to", "left").select("id", F.coalesce("_next", "to").alias("to"), F.col("_next").isNotNull().alias("_moved")))
        hooks = moved.select("id", "to")
        if moved.filter("_moved").isEmpty():
            return hooks


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest reachable id per vertex (id, component).

    Every round hooks each remaining node to its smallest neighbour, follows the hooks to
    their ends and contracts the edges. Two rounds at least halve the nodes that still have
    edges, so it ends by itself. Hubs cost one partial minimum per task. The state is written out each round.
    """
    labels = vertices.select("id", F.col("id").alias("component"))
    left = edges.select("left", "right").filter("left <> right").distinct()
    while True:
        both = left.unionByName(left.select(F.col("right").alias("left"), F.col("left").alias("right")))
        near = both.groupBy(F.col("left").alias("id")).agg(F.min("right").alias("to")).filter("to < id")
        hooks = _follow(cut_lineage(near))
        if hooks.isEmpty():
            return labels
        to = hooks.select(F.col("id").alias("component"), F.col("to").alias("_to"))
        labels = cut_lineage(labels.join(to, "component", "left").select("id", F.coalesce("_to", "component").alias("component")))
        for side in ("left", "right"):
            end = hooks.select(F.col("id").alias(side), F.col("to").alias("_to"))
            left = left.join(end, side, "left").withColumn(side, F.coalesce("_to", side)).drop("_to")
        left = cut_lineage(left.filter("left <> right").distinct())


def cluster_faqs(faqs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Entries merged along the transitive closure of similar pairs. The pairs are written out, so that they are searched for once."""
    groups = connected_components(faqs.select(F.col("ord").alias("id")), cut_lineage(pairs.select("left", "right")))
    return merge_faq_groups(faqs.join(groups.withColumnRenamed("id", "ord"), "ord"), "component")


def upsert_matches(existing: DataFrame, new: DataFrame, threshold: float = rules.SIMILARITY) -> DataFrame:
    """Best existing entry for each new one: highest score, later entry on ties, else equal 80-character key.

    Both sides carry a unique ``ord``; existing entries come first.
    """
    def side(df: DataFrame, is_new: bool) -> DataFrame:
        return df.select("ord", normalize_question(F.col("question")).alias("norm"), F.lit(is_new).alias("is_new"))

    rows = side(existing, False).unionByName(side(new, True)).filter("norm <> ''")
    first = cut_lineage(rows.groupBy("norm").agg(F.min("ord").alias("id"), F.max(F.when(~F.col("is_new"), F.col("ord"))).alias("last_old"), F.bool_or("is_new").alias("any_new")))
    texts = first.withColumn("ord", F.col("id"))
    # ratio and containment pairs between distinct texts; equal texts count as containment
    # the score of a pair is ratio(new, existing); containment takes precedence over the ratio
    inside = containment_pairs(texts).filter(F.col("score") >= threshold)
    inside = inside.unionByName(inside.select(F.col("right").alias("left"), F.col("left").alias("right"), "score"))
    compared = texts.select("ord", "norm", F.col("any_new").alias("asks"), F.col("last_old").isNotNull().alias("answers"))
    scores = ratio_pairs(compared, threshold, both_ways=True).select("left", "right", "score")
    both = inside.unionByName(scores.join(inside.select("left", "right"), ["left", "right"], "left_anti"))
    old = first.filter("last_old IS NOT NULL").select(F.col("id").alias("right"), "last_old")
    scored = both.join(old, "right").select("left", "last_old", "score")
    equal = first.filter("any_new AND last_old IS NOT NULL").select(F.col("id").alias("left"), "last_old", F.lit(rules.CONTAINMENT_SCORE).alias("score"))
    best = scored.unionByName(equal).groupBy("left").agg(F.max(F.struct("score", "last_old")).alias("_b"))
    best = first.filter("any_new").select("norm", F.col("id").alias("left")).join(best, "left", "left")
    key = normalize_question(F.col("question"))
    by_key = existing.groupBy(key.alias("_k")).agg(F.min("ord").alias("_key_match"))
    out = new.select("ord", normalize_question(F.col("question")).alias("norm"), key.alias("_k"))
    out = out.join(best.select("norm", "_b"), "norm", "left").join(by_key, "_k", "left")
    return out.select("ord", F.coalesce("_b.last_old", "_key_match").alias("match"), F.col("_b.score").alias("score"))


def upsert_faqs(existing: DataFrame, new: DataFrame, threshold: float = rules.SIMILARITY) -> DataFrame:
    """Update best matches, insert the rest, delete nothing."""
    matches = upsert_matches(existing, new, threshold)
    grouped = existing.withColumn("group_id", F.col("ord")).unionByName(
        new.join(matches.select("ord", "match"), "ord").withColumn("group_id", F.coalesce("match", "ord")).drop("match"), allowMissingColumns=True)
    return merge_faq_groups(grouped, "group_id")


def near_duplicate_links(edges: DataFrame, threshold: float = rules.LINK_SIMILARITY) -> DataFrame:
    """Per page, pairs of distinct targets whose keys differ but are nearly equal. Edges: src, dst (text)."""
    links = edges.select("src", F.col("dst").alias("ord"), norm_link_key(F.col("dst")).alias("norm")).filter("norm <> ''").distinct()
    # targets of one key are compared once
    keys = cut_lineage(links.select("src", "norm").distinct().withColumn("ord", F.monotonically_increasing_id()))
    pairs = ratio_pairs(keys, threshold, "src", both_ways=True).select(F.col("left").alias("_l"), F.col("right").alias("_r"), "score")
    named = links.withColumnRenamed("ord", "dst").join(keys, ["src", "norm"])
    left = named.select("src", F.col("ord").alias("_l"), F.col("dst").alias("left"))
    right = named.select(F.col("ord").alias("_r"), F.col("dst").alias("right"))
    return pairs.join(left, "_l").join(right, "_r").filter(F.col("left") < F.col("right")).select("src", "left", "right", "score")
