"""Markdown pages from tables, and tables from Markdown pages.

Pages that list the members of a group (categories, index, overview) come as numbered
fragments, so a group of any size is written piece by piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from talkweave import rules
from talkweave.functions import text as tx
from talkweave.functions import urls as ux
from talkweave.operators.faq import parse_link_blocks
from talkweave.operators.ordering import in_parts, with_ordinal
from talkweave.operators.rulematch import best_category, category_rules

NONE = "array<string>"


def _list(c: str | Column) -> Column:
    return F.coalesce(c if isinstance(c, Column) else F.col(c), F.array().cast(NONE))


def bullets(c: Column, mark: str = "- ") -> Column:
    return F.array_join(F.transform(c, lambda s: F.concat(F.lit(mark), s, F.lit("\n"))), "")


def numbered(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s, F.lit("\n"))), "")


def wiki_bullets(c: Column) -> Column:
    names = F.filter(F.transform(c, lambda s: F.regexp_replace(tx.strip(s), "\\.md\\z", "")), lambda s: s != "")
    return F.array_join(F.transform(names, lambda s: F.concat(F.lit("- [["), s, F.lit("]]\n"))), "")


def _section(title: str, body: Column, when: Column) -> Column:
    return F.when(when, F.concat(F.lit(title), body)).otherwise("")


def _cat(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def link_blocks_section(blocks: Column, max_body: int) -> Column:
    rows = F.transform(blocks, lambda b: _cat(
        "### [", b["kind"], "] ", b["title"], "\n\n", F.when(b["url"] != "", _cat("来源: ", b["url"], "\n\n")).otherwise(""),
        F.when(tx.strip(F.substring(b["body"], 1, max_body)) != "", _cat(tx.strip(F.substring(b["body"], 1, max_body)), "\n\n")).otherwise("")))
    return _section("\n## 链接与附件内容（会话内解析）\n\n", F.array_join(rows, ""), F.size(blocks) > 0)


def render_faq_pages(faqs: DataFrame, today: str) -> DataFrame:
    """Question pages. Columns: file_name, question, answer, variants, steps, links, related_wikilinks,
    source_count, category_title, category_page, and link_blocks if present."""
    blocks = link_blocks_section(F.col("link_blocks"), 2500) if "link_blocks" in faqs.columns else F.lit("")
    text = _cat(
        "---\ntype: faq\ncategory: \"[[", F.col("category_page"), "]]\"\ntags: [", F.col("category_title"), "]\nsource_count: ",
        F.col("source_count").cast("string"), f"\nupdated_at: {today}\n---\n\n# ", F.col("question"), "\n\n## 客户问法\n\n",
        bullets(F.concat(F.array("question"), _list("variants"))), "\n## 标准回答\n\n", tx.strip(F.col("answer")), "\n", blocks,
        _section("\n## 操作步骤\n", numbered(_list("steps")), F.size(_list("steps")) > 0),
        _section("\n## 参考链接\n", bullets(_list("links")), F.size(_list("links")) > 0),
        "\n## 相关\n- [[", F.col("category_page"), "]]\n", wiki_bullets(F.slice(_list("related_wikilinks"), 1, 12)))
    return faqs.select(_cat("faqs/", F.col("file_name"), ".md").alias("rel_path"), F.lit("faq").alias("page_type"), text.alias("text"))


def render_concept_pages(concepts: DataFrame, today: str, web: bool = False) -> DataFrame:
    """Concept pages. Columns: concept_id, title, definition, file_name, points, related_names, category_pages."""
    points_head, names_head, none = (("## 要点", "## 关联文档", "（见下方关联文档）") if web
                                     else ("## 从客户问答中归纳的要点", "## 关联问答", "（见下方关联问答）"))
    text = _cat(
        "---\ntype: concept\nconcept_id: ", F.col("concept_id"), f"\nupdated_at: {today}\n", "taxonomy: llm\n" if web else "", "---\n\n# ",
        F.col("title"), "\n\n## 定义\n\n", F.col("definition"), f"\n\n{points_head}\n\n",
        F.when(F.size(_list("points")) > 0, bullets(_list("points"))).otherwise(f"- {none}\n"),
        f"\n{names_head}\n", wiki_bullets(F.slice(_list("related_names"), 1, 25 if web else 20)), "\n## 相关主题\n", wiki_bullets(_list("category_pages")))
    return concepts.select(_cat("concepts/", F.col("file_name"), ".md").alias("rel_path"), F.lit("concept").alias("page_type"), text.alias("text"))


def render_doc_pages(docs: DataFrame, today: str) -> DataFrame:
    """Document pages. Columns: file_name, title, summary, content, source_url, source_site, category_page, category_title, related_doc_names."""
    text = _cat(
        "---\ntype: website-doc\ncategory: \"[[", F.col("category_page"), "]]\"\ntags: [", F.col("category_title"), "]\nsource_url: ", F.col("source_url"),
        "\nsource_site: ", F.col("source_site"), f"\nupdated_at: {today}\n---\n\n# ", F.col("title"), "\n\n## 内容摘要\n\n", F.col("summary"),
        "\n\n## 正文内容\n\n", F.col("content"), "\n\n## 相关\n- [[", F.col("category_page"), "]]\n- 来源：", F.col("source_url"), "\n",
        wiki_bullets(F.slice(_list("related_doc_names"), 1, 15)))
    return docs.select(_cat("faqs/", F.col("file_name"), ".md").alias("rel_path"), F.lit("faq").alias("page_type"), text.alias("text"))


def render_draft_pages(ext: DataFrame, today: str) -> DataFrame:
    """Drafts of single extractions for review. Columns as given by enrich_extractions, plus category_page."""
    variants = F.filter(F.concat(F.array("question"), _list("question_variants")), lambda v: v != "")
    related = F.filter(F.transform(_list("related_wikilinks"), lambda s: F.regexp_replace(tx.strip(s), "\\.md\\z", "")), lambda s: s != F.col("category_page"))
    text = _cat(
        "---\ntype: faq\nsource: cursor-agent\ncategory: \"[[", F.col("category_page"), "]]\"\ntags: [", F.col("category_title"), "]\nsource_session_id: ",
        F.col("source_session_id"), f"\nupdated_at: {today}\n---\n\n# ", F.col("question"), "\n\n## 会话摘要\n\n", F.col("summary"),
        "\n\n## 客户问法\n\n", bullets(variants), "\n## 标准回答\n\n", tx.strip(F.col("answer")), "\n",
        _section("## 操作步骤\n", numbered(_list("steps")), F.size(_list("steps")) > 0), "\n## 相关\n- [[", F.col("category_page"), "]]\n", wiki_bullets(related))
    return ext.select(_cat(".agent-queue/faq-drafts/", F.col("source_session_id"), ".md").alias("rel_path"), F.lit("draft").alias("page_type"), text.alias("text"))


def render_session_pages(summaries: DataFrame, today: str) -> DataFrame:
    """Session pages from session summaries (session_id, title, summary, value, tags, key_points, procedure_points)."""
    sid = F.col("session_id").cast("string")
    slug = tx.session_slug(sid)
    tags = F.coalesce(F.nullif(F.array_join(_list("tags"), ", "), F.lit("")), F.lit("客服"))

    def or_line(c: str, line: str) -> Column:
        return F.when(F.size(_list(c)) > 0, bullets(_list(c))).otherwise(f"- {line}\n")

    text = _cat(
        "---\ntype: session\nsession_id: \"", sid, "\"\ntags: [", tags, "]\nsources:\n  - \"[[source-session-", slug, f"]]\"\nupdated_at: {today}\nvalue: ",
        F.col("value"), "\n---\n\n# 会话 ", tx.truncate_text(sid, 40), " — ", F.col("title"), "\n\n## 会话摘要\n", F.col("summary"), "\n\n## 关键信息\n",
        or_line("key_points", "（见对话记录）"), "\n## 操作与政策摘录\n", or_line("procedure_points", "（会话未给出明确操作步骤）"), "\n## 相关\n- [[source-session-", slug, "]]\n")
    return summaries.select(_cat("sessions/", slug, ".md").alias("rel_path"), F.lit("session").alias("page_type"), text.alias("text"))


def render_source_pages(summaries: DataFrame, today: str) -> DataFrame:
    """Source pages of sessions (session_id, summary), with the path of the raw file if there is a column ``raw_path``."""
    raw = _cat("\n## 原始路径\n`", F.coalesce("raw_path", F.lit("")), "`\n") if "raw_path" in summaries.columns else F.lit("")
    sid = F.col("session_id").cast("string")
    slug = tx.session_slug(sid)
    text = _cat(
        "---\ntype: source\nsource_type: chat\nsource_id: session_", slug, f"\ningested_at: {today}\n---\n\n# 来源：会话 ", tx.truncate_text(sid, 50),
        "\n\n## 摘要\n", F.col("summary"), "\n\n## 萃取清单\n- [[session-", slug, "]] — 会话级要点（非 QA）\n", raw)
    return summaries.select(_cat("sources/source-session-", slug, ".md").alias("rel_path"), F.lit("source").alias("page_type"), text.alias("text"))


# --- pages in fragments --------------------------------------------------------------------------

def category_fragments(faqs: DataFrame, today: str, per_part: int = 500) -> DataFrame:
    """Category pages as fragments (rel_path, part, frag, text): head, one block per entry, closing list.

    Entries follow source count. Columns: category_id, category_title, category_page, overview, plus the entry.
    """
    by_count = [F.desc("source_count"), F.col("ord")]
    slot = F.struct((-F.col("source_count")).alias("c"), F.floor(F.col("ord") / 65536).alias("s"))
    placed = in_parts(with_ordinal(faqs, ["category_page"], by_count, slot, "idx"), ["category_page"], "idx", per_part)
    path = _cat("categories/", F.col("category_page"), ".md")
    variants, steps, links = _list("variants"), _list("steps"), _list("links")
    block = _cat(
        "### ", F.col("idx").cast("string"), ". ", F.col("question"), "\n\n> 详情页：[[", F.col("file_name"), "]]（合并来源 ",
        F.col("source_count").cast("string"), " 条会话）\n\n",
        F.when(F.size(variants) > 0, _cat("**常见问法：**\n", bullets(F.slice(variants, 1, 6)), "\n")).otherwise(""),
        "**标准回答：**\n\n", tx.strip(F.col("answer")), "\n\n",
        F.when(F.size(steps) > 0, _cat("**操作步骤：**\n", numbered(steps), "\n")).otherwise(""),
        F.when(F.size(links) > 0, _cat("**参考链接：** ", F.array_join(F.transform(F.slice(links, 1, 4), lambda u: _cat("`", u, "`")), "、"), "\n\n")).otherwise(""),
        "---\n\n")
    counts = faqs.groupBy("category_id", "category_page", "category_title", "overview").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.size(steps) > 0).alias("with_steps"))
    head = _cat(
        "---\ntype: category\ncategory_id: ", F.col("category_id"), "\nfaq_count: ", F.col("n").cast("string"), f"\nupdated_at: {today}\n---\n\n# ",
        F.col("category_title"), "\n\n## 主题概述\n\n", F.col("overview"), "\n\n本主题共整理 **", F.col("n").cast("string"),
        "** 条客户问答（相似问题已合并），**", F.col("with_steps").cast("string"), "** 条含操作步骤。\n\n", F.lit(rules.SUMMARY_HEADING), "\n\n")
    zero = F.lit(0).cast("bigint")
    frags = counts.select(path.alias("rel_path"), zero.alias("part"), zero.alias("frag"), head.alias("text"))
    frags = frags.unionByName(placed.select(path.alias("rel_path"), "part", F.col("idx").alias("frag"), block.alias("text")))
    index_line = _cat(F.when(F.col("idx") == 1, "## 本主题 FAQ 索引\n\n").otherwise(""), "- [[", F.col("file_name"), "]]\n")
    return frags.unionByName(placed.select(path.alias("rel_path"), "part", (F.col("idx") + (1 << 40)).alias("frag"), index_line.alias("text")))


def index_fragments(categories: DataFrame, concepts: DataFrame, stats: DataFrame, today: str) -> DataFrame:
    """Index page as fragments: head with counts, one section per category, one line per concept.

    ``categories``: ord, title, overview, category_page, n, top_questions; ``concepts``: ord, title, file_name;
    ``stats``: categories, faqs, concepts, raw_sessions.
    """
    head = _cat(
        f"# 智能客服知识库\n\n> 按业务主题分类的客户知识索引。更新：{today}\n\n## 统计\n\n- 主题分类：**", F.col("categories").cast("string"),
        "** 个\n- 客户问答（合并后）：**", F.col("faqs").cast("string"), "** 条\n- 产品概念：**", F.col("concepts").cast("string"),
        "** 个\n- 原始会话（仅 raw）：", F.col("raw_sessions").cast("string"), " 条\n\n## 主题分类\n\n")
    section = _cat(
        "### ", F.col("title"), "\n\n", F.col("overview"), "\n\n- 主题页（含全部 FAQ 内总结）：[[", F.col("category_page"), "]]\n- 本主题 FAQ 约 **",
        F.col("n").cast("string"), "** 条\n- 高频问题：\n", bullets(_list("top_questions"), "  - "), "\n")
    line = _cat(F.when(F.col("ord") == 0, "## 产品概念\n\n").otherwise(""), "- [[", F.col("file_name"), "]]：", F.col("title"), "\n")

    def out(df: DataFrame, base: int, pos: Column, text: Column) -> DataFrame:
        return df.select(F.lit("index.md").alias("rel_path"), F.lit(0).cast("bigint").alias("part"), (pos + base).cast("bigint").alias("frag"), text.alias("text"))

    return out(stats, 0, F.lit(0), head).unionByName(out(categories, 1, F.col("ord"), section)).unionByName(out(concepts, 1 << 30, F.col("ord"), line))


def overview_fragments(categories: DataFrame, stats: DataFrame, today: str) -> DataFrame:
    head = _cat(f"# 知识库总览\n\n> 更新：{today}\n\n- 合并后 FAQ：**", F.col("faqs").cast("string"), "** 条\n- 概念页：**",
                F.col("concepts").cast("string"), "** 个\n\n## 主题分布\n\n")
    line = _cat("- **", F.col("title"), "**：", F.col("n").cast("string"), " 条 FAQ → [[", F.col("category_page"), "]]\n")
    zero = F.lit(0).cast("bigint")
    return stats.select(F.lit("overview.md").alias("rel_path"), zero.alias("part"), zero.alias("frag"), head.alias("text")).unionByName(
        categories.select(F.lit("overview.md").alias("rel_path"), zero.alias("part"), (F.col("ord") + 1).cast("bigint").alias("frag"), line.alias("text")))


def draft_review_fragments(drafts: DataFrame, cap: int = 200) -> DataFrame:
    """Review list: drafts (stem, category, question) by category, at most ``cap`` each plus the remainder count."""
    from talkweave.operators.ordering import top_rows

    sizes = drafts.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    top = top_rows(drafts, ["category"], [F.col("stem")], cap, "rank")
    lines = top.select("category", F.col("rank").cast("bigint").alias("frag"), _cat("- [[.agent-queue/faq-drafts/", F.col("stem"), "|", F.col("question"), "]]").alias("text"))
    heads = sizes.select("category", F.lit(0).cast("bigint").alias("frag"), _cat("### ", F.col("category"), "（", F.col("n").cast("string"), "）").alias("text"))
    rest = sizes.filter(F.col("n") > cap).select("category", F.lit(1 << 30).cast("bigint").alias("frag"), _cat("- ... 其余 ", (F.col("n") - cap).cast("string"), " 条").alias("text"))
    return heads.unionByName(lines).unionByName(rest)


# --- pages back to tables ----------------------------------------------------------------------------

def _field(name: str) -> Column:
    return tx.strip(F.regexp_extract("text", f"(?m)^{name}:\\s*(.+)$", 1))


def _heading() -> Column:
    return tx.strip(F.regexp_extract("text", "(?m)^# (.+)$", 1))


def _items(section: Column) -> Column:
    return F.filter(F.transform(F.filter(tx.lines(section), lambda s: s.startswith("- ")), lambda s: tx.strip(F.substring(s, 3, 1 << 30))), lambda s: s != "")


def parse_faq_pages(pages: DataFrame, categories: list | None = None) -> DataFrame:
    is_faq = F.contains(F.substring("text", 1, 400), F.lit("type: faq")) | F.contains("text", F.lit("## 客户问法"))
    steps = F.transform(tx.lines(tx.md_section(F.col("text"), "## 操作步骤")), lambda s: F.regexp_replace(tx.strip(s), "^\\d+\\.\\s*", ""))
    out = pages.filter(is_faq & (_heading() != "")).select(
        F.col("stem").alias("file_name"), _heading().alias("question"), tx.standard_answer(F.col("text")).alias("answer"),
        _items(tx.md_section(F.col("text"), "## 客户问法")).alias("variants"), F.filter(steps, lambda s: s != "").alias("steps"),
        F.slice(F.regexp_extract_all("text", F.lit("(?m)^-\\s+(https?://\\S+)"), F.lit(1)), 1, 10).alias("links"),
        parse_link_blocks(F.regexp_extract("text", "(?s)## 链接与附件内容[^\\n]*\\n+(.*?)(?=\\n## |\\z)", 1)).alias("link_blocks"),
        F.coalesce(_field("source_count").try_cast("bigint"), F.lit(1)).alias("source_count"))
    return out.withColumn("variants", F.filter("variants", lambda v: v != F.col("question"))).withColumn(
        "category_id", best_category(F.concat("question", "answer"), category_rules(categories)))


def parse_concept_pages(pages: DataFrame, concepts: list | None = None) -> DataFrame:
    cid = F.regexp_extract("text", "(?m)^concept_id:\\s*(\\S+)", 1)
    title = F.coalesce(F.nullif(_heading(), F.lit("")), cid)
    definition = F.coalesce(F.nullif(tx.md_section(F.col("text"), "## 定义"), F.lit("")), title)
    for known, t, d, _ in (rules.CONCEPTS if concepts is None else concepts):
        title, definition = F.when(cid == known, t).otherwise(title), F.when(cid == known, d).otherwise(definition)
    points = F.concat(_items(tx.md_section(F.col("text"), "## 从客户问答中归纳的要点")), _items(tx.md_section(F.col("text"), "## 要点")))
    return pages.filter(cid != "").select(cid.alias("concept_id"), title.alias("title"), definition.alias("definition"),
                                          F.col("stem").alias("file_name"), F.slice(points, 1, 8).alias("points"))


def parse_doc_pages(pages: DataFrame) -> DataFrame:
    content = tx.strip(F.regexp_extract("text", "(?s)## 正文内容\\s*\\n+(.*?)(?=\\n## |\\z)", 1))
    summary = tx.strip(F.regexp_extract("text", "(?s)## 内容摘要\\s*\\n+(.*?)(?=\\n## |\\z)", 1))
    return pages.filter(F.contains(F.substring("text", 1, 400), F.lit("type: website-doc")) & (_heading() != "")).select(
        _heading().alias("title"), content.alias("content"), _field("source_url").alias("source_url"), _field("source_site").alias("source_site"),
        F.coalesce(F.nullif(summary, F.lit("")), tx.doc_summary(content)).alias("summary"), F.col("stem").alias("file_name"))


def parse_category_names(pages: DataFrame) -> DataFrame:
    """Existing category pages: category_id to file name."""
    cid = F.regexp_extract(F.substring("text", 1, 500), "(?m)^category_id:\\s*(\\S+)", 1)
    return pages.filter((F.col("page_type") == "category") & (cid != "")).select(cid.alias("category_id"), F.col("stem").alias("file_name"))


def parse_drafts(pages: DataFrame) -> DataFrame:
    category = F.regexp_extract("text", "(?m)^category:\\s*\"\\[\\[(.+?)\\]\\]\"", 1)
    return pages.select(
        "stem", F.coalesce(F.nullif(tx.strip(category), F.lit("")), F.lit("未分类")).alias("category"),
        F.coalesce(F.nullif(_heading(), F.lit("")), F.col("stem")).alias("question"),
        F.substring(tx.strip(F.regexp_extract("text", "## 会话摘要\\s*\\n+(.+)", 1)), 1, 80).alias("summary"))


def attach_link_content(messages: DataFrame, contents: DataFrame, keys: list[str], max_urls: int | None = 3,
                        tool: str = rules.SEARCH_TOOL) -> DataFrame:
    """Messages (keys, text) with a block for each of the first ``max_urls`` links (None: all): content, or why there is none.

    ``contents``: url, kind, content, error. Unsafe links are marked as blocked.
    """
    listed = messages.select(*keys, "text", F.posexplode(F.slice(ux.extract_urls_distinct(F.col("text")), 1, max_urls or 1 << 30)).alias("i", "url"))
    # each step uses the one before several times
    joined = listed.withColumn("_safe", ux.is_safe_url(F.col("url"))).join(contents, "url", "left")
    joined = joined.withColumn("_kind", F.when(~F.col("_safe"), "blocked").otherwise(F.coalesce("kind", F.lit("error"))))
    kind = F.col("_kind")
    joined = joined.withColumn("_error", F.when(kind == "blocked", "不允许访问的内网或非法 URL").otherwise(
        F.when(F.col("content").isNull(), F.coalesce("error", F.lit("未抓取到内容"))).otherwise(F.col("error"))))
    error = F.col("_error")
    label = F.when(kind == "image", "图片 OCR").otherwise("网页正文")
    head = _cat("### 附件 ", (F.col("i") + 1).cast("string"), "：", F.col("url"), "\n")
    block = F.when(error.isNotNull(), _cat(head, "类型：", kind, "，解析失败：", error, "\n")).otherwise(_cat(head, "类型：", label, "\n", tx.strip(F.col("content")), "\n"))
    packed = joined.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", block.alias("b")))), lambda x: x["b"]).alias("blocks"),
        F.count_if(error.isNotNull()).alias("failed"))
    out = messages.join(packed, keys, "left")
    text = _cat("【客户原始消息】\n", tx.strip(F.col("text")), "\n\n【链接附件解析】（以下由系统自动抓取/OCR，请结合客户问题作答；图片请特别关注客户标注位置）\n",
                F.array_join("blocks", "\n"), "\n请根据上述附件内容理解客户意图；回答产品问题时仍须调用 ", F.lit(tool), "，附件仅作上下文，勿编造附件中未出现的信息。")
    return out.select(*keys, F.when(F.col("blocks").isNotNull(), text).otherwise(F.col("text")).alias("text"),
                      F.coalesce(F.size("blocks"), F.lit(0)).alias("n_links"), F.coalesce("failed", F.lit(0)).alias("failed"))


def session_link_sections(urls: DataFrame, contents: DataFrame, min_chars: int = 25) -> DataFrame:
    """Link section of each session from its links (session_id, url, ord) and fetched contents (url, content).

    Only meaningful contents enter; a session's section is bounded by its distinct links.
    """
    from talkweave.functions.text import is_meaningful_text

    good = urls.join(contents.select("url", "content"), "url").filter(is_meaningful_text(F.col("content"), min_chars))
    name = F.regexp_replace(F.regexp_extract("url", "[^/]*\\z", 0), "\\?.*", "")
    kind = F.when(ux.is_image_url(F.col("url")), "图片 OCR").otherwise("网页")
    block = _cat("### [", kind, "] ", F.coalesce(F.nullif(name, F.lit("")), F.col("url")), "\n\n来源: ", F.col("url"), "\n\n", tx.strip(F.col("content")), "\n")
    packed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", block.alias("b")))), lambda x: x["b"]), "\n")
    return good.groupBy("session_id").agg(F.concat(F.lit(rules.LINK_HEADING + "\n\n"), packed, F.lit("\n")).alias("link_section"))
