"""The page graph: link resolution, reachability, lint findings. A graph is an edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from talkweave import rules
from talkweave.functions import links as lk
from talkweave.functions import text as tx
from talkweave.functions import urls as ux
from talkweave.operators.ordering import collect_in_order, top_rows
from talkweave.operators.similar import near_duplicate_links
from talkweave.session import cut_lineage

KNOWLEDGE = ["category", "concept", "faq"]


def page_edges(pages: DataFrame) -> DataFrame:
    """Edges of pages (stem, page_type, text): src, src_type, dst, kind, pos."""
    both = F.concat(
        F.transform(lk.wikilinks(F.col("text")), lambda x: F.struct(F.lit("wikilink").alias("kind"), x.alias("dst"))),
        F.transform(lk.md_rel_links(F.col("text")), lambda x: F.struct(F.lit("md").alias("kind"), x.alias("dst"))))
    return pages.select(F.col("stem").alias("src"), F.col("page_type").alias("src_type"), F.posexplode(both).alias("pos", "e")).select(
        "src", "src_type", F.col("e.dst").alias("dst"), F.col("e.kind").alias("kind"), F.col("pos").cast("bigint").alias("pos"))


def typed_edges(pages: DataFrame) -> DataFrame:
    """Edges src, dst along category, concept and question links, resolved to pages of that type:
    the exact name, else the first name that starts with the link. Retrieval follows these alone."""
    kind = F.when(F.col("link").startswith("分类-"), "category").when(F.col("link").startswith("概念-"), "concept").otherwise("faq")
    links = pages.select(F.col("stem").alias("src"), F.explode(lk.typed_wikilinks(F.col("text"))).alias("link")).withColumn("page_type", kind)
    return links.join(resolve_page(links, pages), ["page_type", "link"]).select("src", F.col("stem").alias("dst")).distinct()


# --- resolution ------------------------------------------------------------------------

def _prefix_summary(targets: DataFrame, names: DataFrame) -> DataFrame:
    """Per target that is the beginning of some name: how many (``_n``) and the first (``by_prefix``).

    Names emit their prefixes, which are counted per prefix before they meet the targets, so a short
    target costs one row, however many names begin with it.
    """
    spots = F.sequence(F.lit(1), F.length("name_key"))
    emitted = names.filter(F.length("name_key") > 0).select("name", F.explode(F.transform(spots, lambda i: F.substring(F.col("name_key"), F.lit(1), i))).alias("target_key"))
    wanted = targets.select("target_key").distinct()
    counted = emitted.join(wanted, "target_key", "left_semi").groupBy("target_key").agg(F.count(F.lit(1)).alias("_n"), F.min("name").alias("by_prefix"))
    return targets.join(counted, "target_key")


def resolve_wikilinks(targets: DataFrame, stems: DataFrame) -> DataFrame:
    """Existing stem for each link target: exact, alias key, soft key, or unique typed prefix.

    ``targets``: target; ``stems``: stem. Where several stems share a key the last in
    order is used. Unresolved targets keep NULL.
    """
    t = targets.select("target").distinct().withColumn("raw", F.regexp_replace(tx.strip(F.col("target")), "\\.md\\z", ""))
    t = t.withColumn("nkey", tx.alias_key(F.col("raw"))).withColumn("skey", tx.soft_alias_key(F.col("raw")))
    names = stems.select("stem").distinct()
    exact = names.select(F.col("stem").alias("raw"), F.col("stem").alias("by_name"))
    alias = names.groupBy(tx.alias_key(F.col("stem")).alias("nkey")).agg(F.max("stem").alias("by_alias"))
    soft = names.groupBy(tx.soft_alias_key(F.col("stem")).alias("skey")).agg(F.max("stem").alias("by_soft"))
    joined = t.join(exact, "raw", "left").join(alias, "nkey", "left").join(soft, "skey", "left").withColumn(
        "resolved", F.coalesce("by_name", "by_alias", "by_soft"))
    typed = F.col("raw").rlike("^(问答|文档|概念|分类)-")
    open_ones = joined.filter(F.col("resolved").isNull() & typed).select("target", F.col("nkey").alias("target_key"))
    unique = _prefix_summary(open_ones, names.select(F.col("stem").alias("name"), tx.alias_key(F.col("stem")).alias("name_key"))).filter("_n = 1")
    return joined.join(unique.select("target", "by_prefix"), "target", "left").select(
        "target", F.coalesce("resolved", "by_prefix").alias("resolved"))


def resolve_page(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Page for each (page_type, link): exact name, else the first name that starts with it.

    The prefix is the link cut at a full-width bracket.
    """
    wanted = links.select("page_type", "link").distinct()
    exact = pages.select("page_type", F.col("stem").alias("link"), F.col("stem").alias("by_name"))
    joined = wanted.join(exact, ["page_type", "link"], "left")
    prefix = tx.strip(F.regexp_replace("link", "(?s)（.*", ""))
    open_ones = joined.filter(F.col("by_name").isNull()).select("page_type", "link", F.concat("page_type", F.lit("\u0000"), prefix).alias("target_key"))
    # the type is part of the key, so only prefixes longer than it are of use
    names = pages.select(F.col("stem").alias("name"), F.concat("page_type", F.lit("\u0000"), "stem").alias("name_key"))
    first = _prefix_summary(open_ones, names).select("page_type", "link", "by_prefix")
    return joined.join(first, ["page_type", "link"], "left").select("page_type", "link", F.coalesce("by_name", "by_prefix").alias("stem")).filter(
        F.col("stem").isNotNull())


# --- findings ---------------------------------------------------------------------------

def broken_links(edges: DataFrame, pages: DataFrame) -> DataFrame:
    return edges.join(pages.select(F.col("stem").alias("dst")), "dst", "left_anti")


def index_diff(pages: DataFrame, index_targets: DataFrame) -> DataFrame:
    """Index targets without a page, and category and concept pages the index lacks."""
    listed = index_targets.select(F.col("dst").alias("stem")).distinct()
    missing = listed.join(pages.select("stem"), "stem", "left_anti").select(F.lit("missing_on_disk").alias("finding"), "stem")
    absent = pages.filter(F.col("page_type").isin("category", "concept")).join(listed, "stem", "left_anti").select(
        F.concat(F.lit("missing_in_index_"), "page_type").alias("finding"), "stem")
    return missing.unionByName(absent)


def incoming_links(pages: DataFrame, edges: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """In-degree of every page, zero included."""
    used = edges.filter(F.col("kind").isin(kinds)) if kinds else edges
    counts = used.groupBy(F.col("dst").alias("stem")).agg(F.count(F.lit(1)).alias("n"))
    return pages.select("stem", "page_type").join(counts, "stem", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def orphans(pages: DataFrame, edges: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    return incoming_links(pages, edges, kinds).filter((F.col("n") == 0) & F.col("page_type").isin(KNOWLEDGE)).select("stem", "page_type")


def missing_heading(pages: DataFrame, heading: str = rules.SUMMARY_HEADING) -> DataFrame:
    return pages.filter((F.col("page_type") == "category") & ~F.contains("text", F.lit(heading))).select("stem")


def concept_backlinks(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """Concept pages that link to no FAQ page."""
    faqs = pages.filter("page_type = 'faq'").select(F.col("stem").alias("dst"))
    linked = edges.join(faqs, "dst", "left_semi").select(F.col("src").alias("stem")).distinct()
    return pages.filter("page_type = 'concept'").select("stem").join(linked, "stem", "left_anti")


def duplicate_key_groups(stems: DataFrame, key: Column, sample: int = 20) -> DataFrame:
    """FAQ stems that share a normalised key: group size and the first stems in name order."""
    keyed = stems.select(key.alias("key"), "stem").filter("key <> ''")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return sizes.join(_first_names(keyed, ["key"], "stem", sample, sizes), "key")


def same_key_links(edges: DataFrame, pages: DataFrame | None = None, key: Column | None = None, sample: int = 20) -> DataFrame:
    """Per taxonomy page, distinct targets that share a normalised key."""
    links = edges
    if pages is not None:
        taxonomy = pages.filter(F.col("page_type").isin("category", "concept")).select(F.col("stem").alias("src"))
        links = edges.join(taxonomy, "src", "left_semi")
    key = tx.norm_link_key(F.col("dst")) if key is None else key
    keyed = links.select("src", key.alias("key"), F.col("dst").alias("stem")).filter("key <> ''").distinct()
    sizes = keyed.groupBy("src", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return sizes.join(_first_names(keyed, ["src", "key"], "stem", sample, sizes), ["src", "key"])


def _first_names(rows: DataFrame, keys: list[str], value: str, k: int, groups: DataFrame) -> DataFrame:
    top = top_rows(rows.join(groups.select(*keys), keys, "left_semi"), keys, [F.col(value)], k, "_n")
    return collect_in_order(top, keys, "_n", value, "stems")


def kb_check(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """Totals per page type, broken links, and orphans by wikilinks alone and by all links."""
    def one(df: DataFrame, metric: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(metric).alias("metric"), "n")

    totals = pages.rollup("page_type").agg(F.count(F.lit(1)).alias("n")).select(
        F.coalesce(F.concat(F.lit("pages_"), "page_type"), F.lit("total_md")).alias("metric"), "n")
    return (
        totals.unionByName(one(broken_links(edges.filter("kind = 'wikilink'"), pages), "broken_links"))
        .unionByName(one(orphans(pages, edges, ["wikilink"]), "orphan_pages_wikilink_only"))
        .unionByName(one(orphans(pages, edges), "orphan_pages_including_md_links"))
    )


def kb_check_samples(pages: DataFrame, edges: DataFrame, k: int = 15) -> DataFrame:
    """The first ``k`` broken links and orphans of :func:`kb_check` by name: (sample, n, stem, target)."""
    none = F.lit(None).cast("string")
    found = (broken_links(edges.filter("kind = 'wikilink'"), pages).select(F.lit("broken").alias("sample"), F.col("src").alias("stem"), F.col("dst").alias("target"))
             .unionByName(orphans(pages, edges, ["wikilink"]).select(F.lit("orphans_wiki").alias("sample"), "stem", none.alias("target")))
             .unionByName(orphans(pages, edges).select(F.lit("orphans_full").alias("sample"), "stem", none.alias("target"))))
    return top_rows(found.distinct(), ["sample"], [F.col("stem"), F.col("target")], k, "n")


def draft_counts(pages: DataFrame) -> DataFrame:
    """Pages whose front matter calls them drafts, by type."""
    head = F.regexp_extract("text", "(?s)\\A---\\n(.*?)\\n---", 1)
    return pages.filter(head.rlike("(?m)^status:\\s*\"?draft\"?\\s*$")).groupBy("page_type").agg(F.count(F.lit(1)).alias("drafts"))


def lint_report(pages: DataFrame, edges: DataFrame, index_targets: DataFrame, link_threshold: float = rules.LINK_SIMILARITY) -> DataFrame:
    """The seven checks: name, number of findings, and whether the check passed."""
    taxonomy = pages.filter(F.col("page_type").isin("category", "concept")).select(F.col("stem").alias("src"))
    faqs = pages.filter("page_type = 'faq'").select("stem")
    checks = {
        "1_index_consistency": index_diff(pages, index_targets),
        "2_no_orphans": orphans(pages, edges),
        "3_no_broken_wikilinks": broken_links(edges.filter("kind = 'wikilink'"), pages),
        "4_category_has_summary_heading": missing_heading(pages),
        "5_similar_faq_merged": duplicate_key_groups(faqs, tx.norm_faq_key(F.col("stem"))),
        "6_concept_backlinks": concept_backlinks(pages, edges),
        "7a_same_key_links": same_key_links(edges, pages),
        "7b_near_duplicate_links": near_duplicate_links(edges.join(taxonomy, "src", "left_semi"), link_threshold),
    }
    rows = None
    for name, found in checks.items():
        row = found.agg(F.count(F.lit(1)).alias("findings")).select(F.lit(name).alias("check"), "findings")
        rows = row if rows is None else rows.unionByName(row)
    return rows.withColumn("ok", F.col("findings") == 0)


def lint_summary(pages: DataFrame, report: DataFrame) -> DataFrame:
    """One row over a lint report: whether all checks passed, findings, and pages in all and by type."""
    kinds = [F.count_if(F.col("page_type") == t).alias(f"{t}_pages") for t in KNOWLEDGE]
    totals = pages.agg(F.count(F.lit(1)).alias("pages"), *kinds)
    return totals.select(report.agg(F.bool_and("ok")).scalar().alias("all_ok"), report.agg(F.sum("findings")).scalar().alias("findings"), "*")


# --- reachability ---------------------------------------------------------------------------

def expand_neighbors(seeds: DataFrame, graph: DataFrame, pages: DataFrame, min_confidence: float = rules.GRAPH_CONFIDENCE) -> DataFrame:
    """Seeds plus their one-hop neighbours in either direction that exist as pages."""
    strong = graph.filter(F.col("confidence") >= min_confidence)
    s = seeds.select("stem")
    forward = strong.join(s.select(F.col("stem").alias("src")), "src", "left_semi").select(F.col("dst").alias("stem"))
    # an edge whose source is a seed counts in that direction only
    backward = strong.join(s.select(F.col("stem").alias("dst")), "dst", "left_semi").join(
        s.select(F.col("stem").alias("src")), "src", "left_anti").select(F.col("src").alias("stem"))
    near = forward.unionByName(backward).distinct().join(pages.select("stem"), "stem", "left_semi")
    return s.unionByName(near).distinct()


def link_closure(seeds: DataFrame, edges: DataFrame, pages: DataFrame, depth: int = 2, keys: list[str] | None = None) -> DataFrame:
    """Pages reachable from the seeds within ``depth`` links, each at its least depth.

    ``keys`` keep separate closures apart (one per question, say). The number of rounds
    is fixed, and pages seen before are left out of the next frontier.
    """
    keys = keys or []
    exists = pages.select("stem", "page_type")
    reached = cut_lineage(seeds.select(*keys, "stem").distinct().join(exists, "stem").withColumn("depth", F.lit(0)))
    links = edges.select(F.col("src").alias("stem"), "dst").distinct()
    frontier = reached
    for d in range(1, depth + 1):
        step = frontier.select(*keys, "stem").join(links, "stem").select(*keys, F.col("dst").alias("stem")).distinct()
        fresh = step.join(reached.select(*keys, "stem"), [*keys, "stem"], "left_anti").join(exists, "stem").withColumn("depth", F.lit(d))
        frontier = cut_lineage(fresh)
        reached = reached.unionByName(frontier)
    return reached


def page_anchors(pages: DataFrame) -> DataFrame:
    """Absolute link targets of crawled pages (url, html): src, dst."""
    hrefs = F.regexp_extract_all("html", F.lit("(?is)<a\\s[^>]*?href\\s*=\\s*[\"']([^\"']*)[\"']"), F.lit(1))
    found = pages.select(F.col("url").alias("src"), F.explode(F.array_distinct(hrefs)).alias("href"))
    return found.select("src", ux.resolve_url(F.col("src"), F.col("href")).alias("dst")).distinct()


def crawl_frontier(pages: DataFrame, anchors: DataFrame, starts: DataFrame, depth: int = 2, prefix: str = "", allow_query: bool = False) -> DataFrame:
    """Fetched pages within ``depth`` same-host links of their start, under the crawl rules.

    ``pages``: url; ``anchors``: src, dst; ``starts``: start (url).
    """
    known = pages.select("url").distinct()
    reached = starts.select("start", ux.drop_fragment(F.col("start")).alias("url")).filter(
        ux.crawlable_url(F.col("url"), F.col("start"), prefix, allow_query)).join(known, "url", "left_semi").distinct().withColumn("depth", F.lit(0))
    reached = cut_lineage(reached)
    frontier = reached
    for d in range(1, depth + 1):
        step = frontier.select("start", F.col("url").alias("src")).join(anchors, "src").select("start", F.col("dst").alias("url")).filter(
            ux.crawlable_url(F.col("url"), F.col("start"), prefix, allow_query)).distinct()
        fresh = step.join(known, "url", "left_semi").join(reached.select("start", "url"), ["start", "url"], "left_anti").withColumn("depth", F.lit(d))
        frontier = cut_lineage(fresh)
        reached = reached.unionByName(frontier)
    return reached
