"""Link expressions over Markdown text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from talkweave.functions.text import strip, strip_code_blocks

WIKILINK = "\\[\\[([^\\]|]+)(?:\\|[^\\]]+)?\\]\\]"
TYPED_WIKILINK = "\\[\\[((?:分类|问答|概念)-[^\\]]+)\\]\\]"
MD_LINK = "\\]\\(([^)]+)\\)"


def is_noise_target(stem: Column) -> Column:
    return (stem == "") | stem.rlike("\\$\\{|\"|/opt/|https?://")


def _stem(link: Column) -> Column:
    return F.regexp_replace(strip(link), "\\.md\\z", "")


def wikilinks(c: Column) -> Column:
    """Targets of ``[[stem|alias]]`` outside code blocks, in order, duplicates kept."""
    found = F.regexp_extract_all(strip_code_blocks(c), F.lit(WIKILINK), F.lit(1))
    return F.filter(F.transform(found, _stem), lambda s: ~s.startswith(".agent-queue/") & ~is_noise_target(s))


def typed_wikilinks(c: Column) -> Column:
    """Distinct category, question and concept targets, cut at a full-width bracket."""
    found = F.regexp_extract_all(c, F.lit(TYPED_WIKILINK), F.lit(1))
    names = F.transform(found, lambda s: strip(F.regexp_replace(s, "(?s)（.*", "")))
    return F.array_distinct(F.filter(names, lambda s: s != ""))


def md_rel_links(c: Column) -> Column:
    """Stems of relative Markdown links into the page folders."""
    found = F.regexp_extract_all(strip_code_blocks(c), F.lit(MD_LINK), F.lit(1))
    hrefs = F.transform(found, lambda h: strip(F.regexp_replace(strip(h), "(?s)#.*", "")))
    hrefs = F.filter(hrefs, lambda h: ~h.startswith("http"))
    hrefs = F.transform(hrefs, lambda h: F.regexp_replace(F.replace(h, F.lit("\\"), F.lit("/")), "^[./]+", ""))
    hrefs = F.filter(hrefs, lambda h: h.rlike("^(faqs|concepts|categories)/") & h.endswith(".md"))
    stems = F.transform(hrefs, lambda h: F.regexp_replace(F.regexp_extract(h, "[^/]*\\z", 0), "\\.md\\z", ""))
    return F.filter(stems, lambda s: ~is_noise_target(s))


def page_type(rel_path: Column) -> Column:
    name = F.regexp_extract(rel_path, "[^/]*\\z", 0)
    return (
        F.when(rel_path.startswith("categories/"), "category")
        .when(rel_path.startswith("faqs/"), "faq")
        .when(rel_path.startswith("concepts/"), "concept")
        .when(name == "overview.md", "overview")
        .otherwise("page")
    )


def heading_title(c: Column, stem: Column) -> Column:
    """First top-level heading within the first 48 lines, else the stem; at most 120 chars."""
    early = F.slice(F.split(c, "\n"), 1, 48)
    heads = F.filter(early, lambda s: s.rlike("^#\\s+\\S"))
    title = strip(F.regexp_replace(F.get(heads, F.lit(0)), "^#\\s+", ""))
    return F.substring(F.coalesce(title, stem), 1, 120)
