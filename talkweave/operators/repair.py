"""Repairs of the page graph: rewritten pages and lines to add."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from talkweave import rules
from talkweave.functions import links as lk
from talkweave.functions import text as tx
from talkweave.operators.graph import concept_backlinks, index_diff, orphans, page_edges, resolve_wikilinks
from talkweave.operators.ordering import in_parts, top_rows, with_ordinal
from talkweave.operators.substring import contains_join

LINK = "\\[\\[([^\\]|]+)(\\|[^\\]]+)?\\]\\]"
FENCE = "(?s)```.*?```"


def _link_table(pages: DataFrame) -> DataFrame:
    """Per page a map from raw link target to the page it resolves to.

    The map holds only the links of that page's own text.
    """
    targets = F.array_distinct(F.regexp_extract_all("text", F.lit(LINK), F.lit(1)))
    used = pages.select("stem", F.explode(targets).alias("target"))
    resolved = resolve_wikilinks(used.select("target"), pages.select("stem"))
    info = pages.select(F.col("stem").alias("resolved"), "rel_path", lk.heading_title(F.col("text"), F.col("stem")).alias("title"))
    found = used.join(resolved, "target").join(info, "resolved", "left")
    entry = F.struct("target", F.struct("resolved", "rel_path", "title").alias("to"))
    return found.groupBy("stem").agg(F.map_from_entries(F.collect_list(entry)).alias("_links"))


def _rebuild(text: Column, pattern: str, literal, match) -> Column:
    """Cut a text at the matches of a pattern, map both kinds of pieces, and join them again."""
    pieces = F.struct(F.split(text, pattern, -1).alias("lits"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return tx.let(pieces, lambda p: F.array_join(F.transform(
        p["lits"], lambda s, i: F.concat(literal(s), F.coalesce(match(F.get(p["hits"], i)), F.lit("")))), ""))


def _target(link: Column) -> Column:
    return F.regexp_extract(link, LINK, 1)


def _alias(link: Column) -> Column:
    return F.regexp_extract(link, LINK, 2)


def rewrite_links(pages: DataFrame) -> DataFrame:
    """Replace link targets by the stems they resolve to; counts the rewrites."""
    joined = pages.join(_link_table(pages), "stem", "left")

    def changed(link: Column) -> Column:
        to = F.try_element_at("_links", _target(link))["resolved"]
        return ~_target(link).startswith(".agent-queue/") & to.isNotNull() & (to != _target(link))

    def swap(link: Column) -> Column:
        to = F.try_element_at("_links", _target(link))["resolved"]
        return F.when(changed(link), F.concat(F.lit("[["), to, _alias(link), F.lit("]]"))).otherwise(link)

    n = F.size(F.filter(F.regexp_extract_all("text", F.lit(LINK), F.lit(0)), lambda x: F.coalesce(changed(x), F.lit(False))))
    return joined.withColumn("rewrites", n).withColumn("text", _rebuild(F.col("text"), LINK, lambda s: s, swap)).drop("_links")


def tidy_taxonomy_text(c: Column) -> Column:
    """Leftovers of removed links: stray brackets, empty bold labels and empty bullets."""
    c = F.regexp_replace(c, "\\.md\\)\\]\\]+\\]+", ".md)")
    c = F.regexp_replace(c, "\\.md\\]\\]+\\]+", ".md")
    c = F.regexp_replace(c, f"：[{tx.BLANK}]*\\]+[{tx.BLANK}]*（", "：（")
    c = F.regexp_replace(c, f"\\]\\]+[{tx.BLANK}]*（", "（")
    rows = F.transform(F.split(c, "\n"), lambda s: F.regexp_replace(s, f"[{tx.BLANK}]+\\z", ""))
    rows = F.transform(rows, lambda s: F.regexp_replace(s, "^(\\s*[-*]\\s*)\\*\\*[：:]\\s*(\\S.*)$", "$1$2"))
    rows = F.filter(rows, lambda s: ~s.rlike("^\\s*[-*]\\s*$"))
    return F.regexp_replace(F.array_join(rows, "\n"), "\\n{4,}", "\n\n\n")


def normalize_taxonomy_links(pages: DataFrame) -> DataFrame:
    """Category and concept pages outside code: drop dead links, write bracketed stems as
    Markdown links, canonicalise the rest; counts each kind."""
    taxonomy = F.col("page_type").isin("category", "concept")
    joined = pages.join(_link_table(pages), "stem", "left")

    def to(link: Column, name: str) -> Column:
        return F.try_element_at("_links", _target(link))[name]

    def kept(link: Column) -> Column:
        raw = F.regexp_replace(tx.strip(_target(link)), "\\.md\\z", "")
        return _target(link).startswith(".agent-queue/") | lk.is_noise_target(raw)

    def dead(link: Column) -> Column:
        return to(link, "resolved").isNull() | to(link, "rel_path").isNull()

    def bracketed(link: Column) -> Column:
        return to(link, "resolved").rlike("[\\[\\]]")

    def differs(link: Column) -> Column:
        raw = F.regexp_replace(tx.strip(_target(link)), "\\.md\\z", "")
        return (raw != to(link, "resolved")) | (_alias(link) != "")

    def action(link: Column) -> Column:
        return F.when(kept(link), "keep").when(dead(link), "removed").when(bracketed(link), "to_markdown").when(differs(link), "canonicalized").otherwise("keep")

    def swap(link: Column) -> Column:
        shown = tx.strip(F.regexp_replace(_alias(link), "^\\|", ""))
        label = tx.strip(tx.collapse_blanks(F.coalesce(F.nullif(shown, F.lit("")), F.nullif(to(link, "title"), F.lit("")), to(link, "resolved"))))
        return tx.let(action(link), lambda a: F.when(a == "keep", link).when(a == "removed", "")
                      .when(a == "to_markdown", F.concat(F.lit("["), label, F.lit("]("), to(link, "rel_path"), F.lit(")")))
                      .otherwise(F.concat(F.lit("[["), to(link, "resolved"), _alias(link), F.lit("]]"))))

    def chunk(s: Column) -> Column:
        return tidy_taxonomy_text(_rebuild(s, LINK, lambda x: x, swap))

    actions = F.transform(F.regexp_extract_all(F.regexp_replace("text", FENCE, ""), F.lit(LINK), F.lit(0)), action)
    counted = joined.withColumn("_a", F.when(taxonomy, actions).otherwise(F.array().cast("array<string>")))
    for name in ("removed", "to_markdown", "canonicalized"):
        counted = counted.withColumn(name, F.size(F.array_compact(F.transform("_a", _when_is(name)))))
    text = F.when(taxonomy, _rebuild(F.col("text"), FENCE, chunk, lambda m: m)).otherwise(F.col("text"))
    return counted.withColumn("text", text).drop("_links", "_a")


def _when_is(name: str):
    return lambda a: F.when(a == name, F.lit(1))


# --- lines to add -----------------------------------------------------------------------------

def _plain(c: str) -> Column:
    return ~F.col(c).rlike("[\\[\\]]")


def relink_orphans(pages: DataFrame) -> DataFrame:
    """Lines that give orphan pages an incoming link: (page, section, ord, line).

    FAQ orphans go to the category page their front matter names; categories and
    concepts go to the index; pages whose name cannot be a wikilink get a Markdown link.
    """
    edges = page_edges(pages)
    alone = orphans(pages, edges, ["wikilink"]).join(pages.select("stem", "text", "rel_path"), "stem")
    named = F.regexp_replace(tx.strip(F.regexp_extract("text", "(?m)^category:\\s*\"\\[\\[([^\\]]+)\\]\\]\"", 1)), "\\.md\\z", "")
    cats = pages.filter("page_type = 'category'").select(F.col("stem").alias("page"))
    faq = alone.filter("page_type = 'faq'").withColumn("page", named).join(cats, "page", "left_semi").filter(_plain("stem")).select(
        "page", F.lit(rules.ORPHAN_HEADING).alias("section"), F.col("stem").alias("ord"), F.concat(F.lit("- [["), "stem", F.lit("]]")).alias("line"))
    heads = {"category": "### 其他主题页（补链索引）", "concept": "### 概念页补链（无入链别名）"}
    head = F.when(F.col("page_type") == "category", heads["category"]).otherwise(heads["concept"])
    index = alone.filter(F.col("page_type").isin("category", "concept") & _plain("stem")).select(
        F.lit("index").alias("page"), head.alias("section"), F.col("stem").alias("ord"), F.concat(F.lit("- [["), "stem", F.lit("]]")).alias("line"))
    # everything that still has no link gets one by path
    linked = faq.select(F.col("ord").alias("stem")).unionByName(index.select(F.col("ord").alias("stem")))
    title = F.coalesce(F.nullif(F.substring(tx.strip(F.regexp_extract("text", "(?m)^# (.+)$", 1)), 1, 120), F.lit("")), F.col("stem"))
    rest = alone.join(linked, "stem", "left_anti").select(
        F.lit("index").alias("page"), F.lit("### 标准 Markdown 补链（wikilink 不适用的页面）").alias("section"), F.col("rel_path").alias("ord"),
        F.concat(F.lit("- ["), title, F.lit("]("), "rel_path", F.lit(")")).alias("line"))
    return faq.unionByName(index).unionByName(rest)


def complete_index(pages: DataFrame, index_targets: DataFrame) -> DataFrame:
    """Index lines for category and concept pages the index lacks, by name under two headings."""
    lacking = index_diff(pages, index_targets).filter(F.col("finding").startswith("missing_in_index"))
    head = F.when(F.col("finding").endswith("category"), "### 自动补链主题").otherwise("### 自动补链概念")
    return lacking.select(F.lit("index").alias("page"), head.alias("section"), F.col("stem").alias("ord"), F.concat(F.lit("- [["), "stem", F.lit("]]")).alias("line"))


BACKFILL_HEADING = "## 自动补链 FAQ"


def backfill_concept_faqs(pages: DataFrame, cap: int = 5) -> DataFrame:
    """For concept pages without FAQ links: the first FAQs whose name contains a word of the title."""
    edges = page_edges(pages)
    lonely = pages.join(concept_backlinks(pages, edges), "stem", "left_semi").filter(~F.contains("text", F.lit(BACKFILL_HEADING)))
    title = F.coalesce(F.nullif(tx.strip(F.regexp_extract("text", "(?m)^#\\s+(.+)$", 1)), F.lit("")), F.col("stem"))
    words = F.array_distinct(F.filter(F.split(F.lower(title), f"[{tx.BLANK}\\-（）()、，,]+"), lambda w: F.length(w) >= 2))
    tokens = lonely.select("stem", F.explode(words).alias("needle"))
    needles = tokens.select("needle").distinct().select(F.col("needle").alias("needle_id"), "needle")
    names = pages.filter("page_type = 'faq'").select(F.col("stem").alias("text_id"), F.lower("stem").alias("text"))
    found = contains_join(needles, names, shortest=2)
    picked = tokens.join(found, tokens["needle"] == found["needle_id"]).select("stem", F.col("text_id").alias("faq")).distinct()
    top = top_rows(picked, ["stem"], [F.col("faq")], cap, "_n")
    return top.select(F.col("stem").alias("page"), F.lit(BACKFILL_HEADING).alias("section"), F.col("faq").alias("ord"),
                      F.concat(F.lit("- [["), "faq", F.lit("]]")).alias("line"))


def _with_bucket(lines: DataFrame, width: int = 3) -> DataFrame:
    """Add ``_after``: the ``width`` characters after what all ``ord`` of the section begin with, which
    follow the order and tell the lines of one folder apart too."""
    ends = lines.groupBy("page", "section").agg(F.min("ord").alias("_least"), F.max("ord").alias("_most"))
    # What the least and the greatest begin with, all begin with.
    places = F.sequence(F.lit(0), F.least(F.length("_least"), F.length("_most")))
    same = F.filter(places, lambda i: F.substring(F.col("_least"), F.lit(1), i) == F.substring(F.col("_most"), F.lit(1), i))
    shared = ends.select("page", "section", F.array_max(same).alias("_shared"))
    return lines.join(shared, ["page", "section"]).withColumn("_after", F.substring(F.col("ord"), F.col("_shared") + 1, F.lit(width))).drop("_shared")


def apply_additions(pages: DataFrame, additions: DataFrame, lines_per_part: int = 4096) -> DataFrame:
    """Pages with their lines appended under section headings.

    Part 0 is the page itself; pages that gain more lines than a part holds continue in
    further parts.
    """
    lines = additions.distinct()
    placed = with_ordinal(_with_bucket(lines), ["page", "section"], [F.col("ord")], F.col("_after"), "n").drop("_after")
    parts = in_parts(placed, ["page", "section"], "n", lines_per_part)
    block = F.concat(F.lit("\n"), "section", F.lit("\n\n"), F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n"), F.lit("\n"))
    blocks = parts.groupBy("page", "section", "part").agg(block.alias("block"))
    merged = blocks.groupBy("page", "part").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("section", "block"))), lambda x: x["block"]), "").alias("_more"))
    body = F.regexp_replace("text", f"[{tx.BLANK}]+\\z", "")
    first = pages.join(merged.filter("part = 0").select(F.col("page").alias("stem"), "_more"), "stem", "left").select(
        "stem", F.lit(0).cast("bigint").alias("part"), F.when(F.col("_more").isNotNull(), F.concat(body, F.lit("\n"), "_more")).otherwise(F.col("text")).alias("text"))
    later = merged.filter("part > 0").select(F.col("page").alias("stem"), "part", F.col("_more").alias("text"))
    return first.unionByName(later)


def autofix_report(rewritten: DataFrame, normalized: DataFrame, additions: DataFrame) -> DataFrame:
    """Counters of a repair run (or of its plan)."""
    links = rewritten.agg(F.count(F.lit(1)).alias("files_scanned"), F.coalesce(F.sum("rewrites"), F.lit(0)).alias("link_rewrites"))
    tax = normalized.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"taxonomy_{c}") for c in ("removed", "to_markdown", "canonicalized")])
    rows = links.select(F.explode(F.create_map(*[x for c in links.columns for x in (F.lit(c), F.col(c))])).alias("metric", "n"))
    rows = rows.unionByName(tax.select(F.explode(F.create_map(*[x for c in tax.columns for x in (F.lit(c), F.col(c))])).alias("metric", "n")))
    added = additions.groupBy(F.concat(F.lit("added: "), "section").alias("metric")).agg(F.count(F.lit(1)).alias("n"))
    return rows.unionByName(added)
