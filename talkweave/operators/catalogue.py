"""Catalogue pages: document categories, the document index and overview, the session catalogue and overview.

Pages come as numbered fragments (rel_path, part, frag, text) for
:func:`talkweave.sources.writers.assemble_fragments`, so a category of any size is written piece by piece.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from talkweave.functions import text as tx
from talkweave.operators.ordering import collect_in_order, id_bucket, in_parts, top_rows, with_ordinal

# --- fixed values: wording of the pages ----------------------------------------------------------
CATEGORY_HEAD = ("---\ntype: category\ncategory_id: {id}\ndoc_count: {n}\nupdated_at: {today}\ntaxonomy: llm\n---\n\n# {title}\n\n"
                 "## 主题概述\n\n{overview}\n\n本主题共整理 **{n}** 篇文档。\n\n")
CATEGORY_CONCEPTS = "## 相关产品概念\n\n"
CATEGORY_CONCEPT = "- **[[{file_name}]]**：{definition}\n"
CATEGORY_DOCS = "## 文档列表\n\n"
CATEGORY_DOC = "### {idx}. {title}\n\n> 详情页：[[{file_name}]]\n\n**摘要：** {summary}\n\n**来源：** {source_url}\n\n---\n\n"
INDEX_HEAD = ("# {name}\n\n> 网站文档萃取（分类/概念由 **{mode}** 生成）。更新：{today}\n\n## 使用说明\n\n1. 从 **主题分类** 进入各主题汇总页\n"
              "2. 单篇文档见 `wiki/faqs/`\n3. 概念见 `wiki/concepts/`\n4. LLM 生成的分类树见 `wiki/taxonomy.json`\n\n## 统计\n\n"
              "- 主题分类：**{categories}** 个（动态生成）\n- 文档数量：**{docs}** 篇\n- 产品概念：**{concepts}** 个（动态生成）\n"
              "- 原始页面：**{raw_pages}** 页\n- 来源站点：{sites}\n\n## 主题分类\n")
INDEX_CATEGORY = "\n### {title}\n\n{overview}\n\n- 主题页：[[{category_page}]]\n- 本主题文档 **{n}** 篇\n- 代表文档：{top}\n"
INDEX_DOC = "\n  - [[{file_name}]] {title}"
INDEX_CONCEPTS = "\n## 产品概念\n"
INDEX_CONCEPT = "\n- [[{file_name}]]：{title}"
OVERVIEW_HEAD = ("# 知识库总览\n\n> 更新：{today}\n\n## 知识结构\n\n| 层级 | 目录 | 说明 |\n|------|------|------|\n| 索引 | `index.md` | 主题入口 |\n"
                 "| 分类树 | `taxonomy.json` | LLM 生成的分类与概念定义 |\n| 主题 | `categories/` | 各主题文档汇总 |\n"
                 "| 文档 | `faqs/` | 单篇萃取文档 |\n| 概念 | `concepts/` | 术语与产品概念 |\n\n- 文档：**{docs}** 篇\n- 概念：**{concepts}** 个\n\n## 主题分布\n")
OVERVIEW_CATEGORY = "\n- **{title}**：{n} 篇 → [[{category_page}]]"
SESSION_HEAD = "# {name}\n\n> 每次 ingest 后更新。最近 ingest：{today}\n\n| 页面 | 类型 | 来源数 | 更新 |\n|------|------|--------|------|\n"
SESSION_LINE = "| [[session-{slug}]] | session ({value}) | 1 | {today} |"
SESSION_REST = "\n| … | 另有 {rest} 条 | — | — |"
SESSION_TAIL = "\n\n## 统计\n\n- wiki/sessions: {n}\n- wiki/sources: {sources}\n- concepts: 0\n- procedures: 0\n"
TAGS_HEAD = ("# 知识库总览\n\n> 跨来源 living synthesis。更新：{today}\n\n## 当前状态\n\n- 已入库会话：**{n}** 条（来自 Excel 清洗后的 raw/chats）\n"
             "- 高价值 (high)：{high}\n- 中价值 (medium)：{medium}\n- 低价值 (low)：{low}\n\n## 主题索引（按标签频次）\n")
TAGS_LINE = "\n- **{tag}**：{n} 条会话"
TAGS_TAIL = "\n\n## 使用说明\n\n- 检索：`{search}`\n- 详情：打开 `wiki/sessions/` 对应页\n"

BODY = 1 << 40  # fragments of a list come after all of a page's opening ones
END = 1 << 60


def fill(template: str, **values: Column | str) -> Column:
    """``template`` with each ``{name}`` replaced by its value; null becomes empty."""
    def cell(i: int, part: str) -> Column:
        value = part if i % 2 == 0 else values[part]
        return F.lit(value) if isinstance(value, str) else F.coalesce(value.cast("string"), F.lit(""))

    return F.concat(*[cell(i, p) for i, p in enumerate(re.split(r"\{(\w+)\}", template))])


def _cols(*names: str) -> dict[str, Column]:
    return {n: F.col(n) for n in names}


def _fragment(df: DataFrame, path: Column | str, frag: Column | int, text: Column, part: Column | int = 0) -> DataFrame:
    return df.select((F.lit(path) if isinstance(path, str) else path).alias("rel_path"), F.lit(part).cast("bigint").alias("part"),
                     F.lit(frag).cast("bigint").alias("frag"), text.alias("text"))


def doc_category_fragments(docs: DataFrame, categories: DataFrame, concepts: DataFrame, today: str, per_part: int = 500) -> DataFrame:
    """A page for each category that has documents: head, its concepts, then its documents, longest first.

    ``docs``: ord, category_id, title, file_name, summary, content, source_url; ``categories``: category_id, title,
    overview, category_page; ``concepts``: ord, file_name, definition, category_ids. Documents of unknown or null
    categories are on no page; equal lengths follow ``ord``. More than ``per_part`` documents make further parts.
    """
    known = categories.select("category_id", "category_page")
    rows = docs.select("category_id", "ord", "title", "file_name", "summary", "source_url",
                       F.coalesce(F.length("content"), F.lit(0)).alias("_len")).join(known, "category_id")
    slot = F.struct((-F.col("_len")).alias("l"), id_bucket("ord").alias("s"))
    placed = in_parts(with_ordinal(rows, ["category_page"], [F.desc("_len"), F.col("ord")], slot, "idx"), ["category_page"], "idx", per_part)
    counts = rows.groupBy("category_id").agg(F.count(F.lit(1)).alias("n"))
    heads = categories.join(counts, "category_id")
    named = concepts.select(F.explode(F.array_distinct("category_ids")).alias("category_id"), F.col("ord").alias("_o"), "file_name", "definition")
    named = named.join(heads.select("category_id", "category_page"), "category_id")
    path = F.concat(F.lit("categories/"), "category_page", F.lit(".md"))
    with_concepts = named.select("category_page").distinct()
    pages = [
        _fragment(heads, path, 0, fill(CATEGORY_HEAD, id=F.col("category_id"), today=today, **_cols("n", "title", "overview"))),
        _fragment(with_concepts, path, 1, F.lit(CATEGORY_CONCEPTS)),
        _fragment(named, path, F.col("_o") + 2, fill(CATEGORY_CONCEPT, **_cols("file_name", "definition"))),
        _fragment(with_concepts, path, BODY - 1, F.lit("\n")),
        _fragment(heads, path, BODY, F.lit(CATEGORY_DOCS)),
        _fragment(placed, path, F.col("idx") + BODY, fill(CATEGORY_DOC, **_cols("idx", "title", "file_name", "summary", "source_url")), F.col("part")),
    ]
    out = pages[0]
    for p in pages[1:]:
        out = out.unionByName(p)
    return out


def doc_sections(docs: DataFrame, categories: DataFrame, top: int = 5) -> DataFrame:
    """Categories that have documents, with their number ``n`` and the ``top`` longest (struct file_name, title)."""
    known, order = categories.select("category_id"), [F.desc_nulls_last("_len"), F.col("ord")]
    rows = docs.select("category_id", "ord", "title", "file_name", F.length("content").alias("_len"))
    counts = docs.groupBy("category_id").agg(F.count(F.lit(1)).alias("n")).join(known, "category_id").groupBy("category_id").agg(F.sum("n").alias("n"))
    # only the first of each category meet it, so neither texts nor long titles are shuffled
    first = top_rows(rows, ["category_id"], order, top, "_r").drop("_r").join(known, "category_id")
    best = top_rows(first, ["category_id"], order, top, "_r").withColumn("_d", F.struct("file_name", "title"))
    return categories.join(counts, "category_id").join(collect_in_order(best, ["category_id"], "_r", "_d", "top"), "category_id")


def doc_stats(docs: DataFrame, sections: DataFrame, concepts: DataFrame, raw_pages: DataFrame) -> DataFrame:
    """One row: numbers of docs, categories, concepts and raw pages, and the sorted source sites."""
    sites = docs.groupBy("source_site").agg(F.count(F.lit(1)).alias("n"))
    named = F.sort_array(F.collect_list(F.when(F.col("source_site") != "", F.col("source_site"))))
    count = F.count(F.lit(1))
    return sites.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("docs"), named.alias("sites")).select(
        "docs", "sites", sections.agg(count).scalar().alias("categories"), concepts.agg(count).scalar().alias("concepts"),
        raw_pages.agg(count).scalar().alias("raw_pages"))


def doc_index_fragments(sections: DataFrame, concepts: DataFrame, stats: DataFrame, today: str, name: str = "知识库", mode: str = "agent") -> DataFrame:
    """Index page of a document base. ``sections``: as by :func:`doc_sections`, plus ord; ``concepts``: ord, title, file_name."""
    top = F.array_join(F.transform("top", lambda d: fill(INDEX_DOC, file_name=d["file_name"], title=d["title"])), "")
    numbers = _cols("categories", "docs", "concepts", "raw_pages")
    head = fill(INDEX_HEAD, name=name, mode=mode, today=today, sites=F.array_join("sites", ", "), **numbers)
    section = fill(INDEX_CATEGORY, top=top, **_cols("title", "overview", "category_page", "n"))
    out = _fragment(stats, "index.md", 0, head).unionByName(_fragment(sections, "index.md", F.col("ord") + 1, section))
    out = out.unionByName(_fragment(stats.filter("concepts > 0"), "index.md", BODY - 1, F.lit(INDEX_CONCEPTS)))
    return out.unionByName(_fragment(concepts, "index.md", F.col("ord") + BODY, fill(INDEX_CONCEPT, **_cols("file_name", "title"))))


def doc_overview_fragments(sections: DataFrame, stats: DataFrame, today: str) -> DataFrame:
    line = fill(OVERVIEW_CATEGORY, **_cols("title", "n", "category_page"))
    return _fragment(stats, "overview.md", 0, fill(OVERVIEW_HEAD, today=today, **_cols("docs", "concepts"))).unionByName(
        _fragment(sections, "overview.md", F.col("ord") + 1, line))


def parse_session_pages(pages: DataFrame) -> DataFrame:
    """Session pages (stem, text) to slug, title (the slug without one), value (null without one) and tags in page order."""
    def line(pattern: str) -> Column:
        return F.nullif(F.regexp_extract("text", f"(?md){pattern}", 1), F.lit(""))

    listed = F.transform(F.split(F.coalesce(line("^tags:\\s*\\[(.+)\\]"), F.lit("")), "[,\\[\\]]+"), tx.strip)
    return pages.select(
        F.col("stem").alias("slug"), F.coalesce(line("^# 会话 .+ — (.+)$"), F.col("stem")).alias("title"),
        line(f"^value:\\s*([{tx.WORD}]+)").alias("value"), F.filter(listed, lambda s: s != "").alias("tags"))


def session_catalogue_fragments(sessions: DataFrame, sources: DataFrame, today: str, name: str = "知识库目录", cap: int = 500) -> DataFrame:
    """Catalogue of session pages (slug, value) in order of file name: the first ``cap`` lines, how many more, and counts."""
    by_name = F.concat("slug", F.lit(".md"))
    first = sessions.select("slug", F.coalesce("value", F.lit("medium")).alias("value"), by_name.alias("_f")).orderBy("_f").limit(cap)
    ranked = first.withColumn("_i", F.row_number().over(Window.orderBy("_f")))  # at most ``cap`` rows
    row = F.concat(F.when(F.col("_i") > 1, "\n").otherwise(""), fill(SESSION_LINE, today=today, **_cols("slug", "value")))
    stats = sessions.agg(F.count(F.lit(1)).alias("n")).withColumn("sources", sources.agg(F.count(F.lit(1))).scalar())
    out = _fragment(stats, "index.md", 0, fill(SESSION_HEAD, name=name, today=today)).unionByName(_fragment(ranked, "index.md", F.col("_i"), row))
    rest = _fragment(stats.filter(F.col("n") > cap), "index.md", END - 1, fill(SESSION_REST, rest=F.col("n") - cap))
    return out.unionByName(rest).unionByName(_fragment(stats, "index.md", END, fill(SESSION_TAIL, **_cols("n", "sources"))))


def session_overview_fragments(sessions: DataFrame, today: str, top: int = 12, search: str = "query: <问题>") -> DataFrame:
    """Overview of session pages (slug, value, tags): counts by value, the ``top`` tags; equal counts follow first sight by file name."""
    stats = sessions.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("value") == v).alias(v) for v in ("high", "medium", "low")])
    seen = sessions.select(F.concat("slug", F.lit(".md")).alias("_f"), F.posexplode("tags").alias("_p", "tag"))
    tags = seen.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_f", "_p")).alias("_first"))
    best = tags.orderBy(F.desc("n"), "_first").limit(top)
    best = best.withColumn("_i", F.row_number().over(Window.orderBy(F.desc("n"), "_first")))  # at most ``top`` rows
    out = _fragment(stats, "overview.md", 0, fill(TAGS_HEAD, today=today, **_cols("n", "high", "medium", "low")))
    out = out.unionByName(_fragment(best, "overview.md", F.col("_i"), fill(TAGS_LINE, **_cols("tag", "n"))))
    return out.unionByName(_fragment(stats, "overview.md", END, fill(TAGS_TAIL, search=search)))
