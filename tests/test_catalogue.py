"""Catalogue pages against whole expected texts."""

import re

from talkweave.operators import catalogue as ct
from talkweave.operators import render as rd
from talkweave.sources.writers import assemble_fragments

DOCS = "ord long, category_id string, title string, file_name string, summary string, content string, source_url string, source_site string"
ROWS = [(1, "a", "T1", "文档-1", "s1", "short", "u1", "x"), (2, "a", "T2", "文档-2", None, "a longer text", "u2", "y"),
        (3, "a", "T3", "文档-3", "s3", "short", "u3", "x"), (4, None, "T4", "文档-4", "s4", "lost", "u4", ""),
        (5, "zzz", "T5", "文档-5", "s5", "unknown", "u5", None), (6, "a", "T6", "文档-6", "s6", None, "u6", "x")]


def _inputs(spark, rows=ROWS):
    docs = spark.createDataFrame(rows, DOCS)
    cats = spark.createDataFrame([(0, "a", "A", "about a", "分类-A"), (1, "b", "B", "about b", "分类-B")],
                                 "ord int, category_id string, title string, overview string, category_page string")
    concepts = spark.createDataFrame([(0, "C0", "概念-0", "d0", ["a", "a"]), (1, "C1", "概念-1", "d1", ["b"]), (2, "C2", "概念-2", "d2", ["b", "a"])],
                                     "ord int, title string, file_name string, definition string, category_ids array<string>")
    return docs, cats, concepts


def _texts(frags):
    return {r.rel_path: r.text for r in assemble_fragments(frags).collect()}


def test_category_pages(spark):
    docs, cats, concepts = _inputs(spark)
    got = _texts(ct.doc_category_fragments(docs, cats, concepts, "2024-01-01", per_part=3))
    head = ("---\ntype: category\ncategory_id: a\ndoc_count: 4\nupdated_at: 2024-01-01\ntaxonomy: llm\n---\n\n# A\n\n## 主题概述\n\nabout a\n\n"
            "本主题共整理 **4** 篇文档。\n\n## 相关产品概念\n\n- **[[概念-0]]**：d0\n- **[[概念-2]]**：d2\n\n## 文档列表\n\n")

    def block(i, n, s):
        return f"### {i}. T{n}\n\n> 详情页：[[文档-{n}]]\n\n**摘要：** {s}\n\n**来源：** u{n}\n\n---\n\n"

    assert got == {"categories/分类-A.md": head + block(1, 2, "") + block(2, 1, "s1") + block(3, 3, "s3"),
                   "categories/分类-A.part1.md": block(4, 6, "s6")}
    no_concepts = _texts(ct.doc_category_fragments(docs, cats, concepts.limit(0), "2024-01-01"))
    assert "相关产品概念" not in no_concepts["categories/分类-A.md"] and "。\n\n## 文档列表" in no_concepts["categories/分类-A.md"]


def test_index_and_overview(spark):
    docs, cats, concepts = _inputs(spark)
    sections = ct.doc_sections(docs, cats, 2)
    stats = ct.doc_stats(docs, sections, concepts, docs)
    got = _texts(ct.doc_index_fragments(sections, concepts, stats, "D", "N", "M").unionByName(ct.doc_overview_fragments(sections, stats, "D")))
    assert got["index.md"] == "\n".join([
        "# N", "", "> 网站文档萃取（分类/概念由 **M** 生成）。更新：D", "", "## 使用说明", "", "1. 从 **主题分类** 进入各主题汇总页", "2. 单篇文档见 `wiki/faqs/`",
        "3. 概念见 `wiki/concepts/`", "4. LLM 生成的分类树见 `wiki/taxonomy.json`", "", "## 统计", "", "- 主题分类：**1** 个（动态生成）", "- 文档数量：**6** 篇",
        "- 产品概念：**3** 个（动态生成）", "- 原始页面：**6** 页", "- 来源站点：x, y", "", "## 主题分类", "", "### A", "", "about a", "", "- 主题页：[[分类-A]]",
        "- 本主题文档 **4** 篇", "- 代表文档：", "  - [[文档-2]] T2", "  - [[文档-1]] T1", "", "## 产品概念\n", "- [[概念-0]]：C0", "- [[概念-1]]：C1", "- [[概念-2]]：C2"])
    assert got["overview.md"].endswith("- 文档：**6** 篇\n- 概念：**3** 个\n\n## 主题分布\n\n- **A**：4 篇 → [[分类-A]]")


def test_empty_base(spark):
    docs, cats, concepts = _inputs(spark, [])
    sections = ct.doc_sections(docs, cats)
    stats = ct.doc_stats(docs, sections, concepts.limit(0), docs)
    assert ct.doc_category_fragments(docs, cats, concepts, "D").isEmpty()
    got = _texts(ct.doc_index_fragments(sections, concepts.limit(0), stats, "D"))
    assert got["index.md"].endswith("- 原始页面：**0** 页\n- 来源站点：\n\n## 主题分类\n")


def test_session_catalogue(spark):
    def page(value, tags, title="t"):
        return f"---\ntype: session\n{tags}\n{value}\n---\n\n# 会话 1 — {title}\n\nvalue: low\n"

    pages = spark.createDataFrame([
        ("a", page("value: high", "tags: [x, y]")), ("a-b", page("value: low", "tags: [y,  [z]]")), ("c", page("", "tags: []").replace("value: low", "")),
        ("d", "no head")], "stem string, text string")
    parsed = ct.parse_session_pages(pages)
    rows = {r.slug: r for r in parsed.collect()}
    assert rows["a"].tags == ["x", "y"] and rows["a"].value == "high" and rows["a"].title == "t"
    assert rows["a-b"].tags == ["y", "z"] and rows["c"].tags == [] and rows["c"].value is None
    assert rows["d"].title == "d" and rows["d"].value is None
    got = _texts(ct.session_catalogue_fragments(parsed, pages.limit(3), "D", "N", cap=3).unionByName(ct.session_overview_fragments(parsed, "D", 2, "S")))
    assert got["index.md"] == (
        "# N\n\n> 每次 ingest 后更新。最近 ingest：D\n\n| 页面 | 类型 | 来源数 | 更新 |\n|------|------|--------|------|\n"
        "| [[session-a-b]] | session (low) | 1 | D |\n| [[session-a]] | session (high) | 1 | D |\n| [[session-c]] | session (medium) | 1 | D |\n"
        "| … | 另有 1 条 | — | — |\n\n## 统计\n\n- wiki/sessions: 4\n- wiki/sources: 3\n- concepts: 0\n- procedures: 0\n")
    assert got["overview.md"] == (
        "# 知识库总览\n\n> 跨来源 living synthesis。更新：D\n\n## 当前状态\n\n- 已入库会话：**4** 条（来自 Excel 清洗后的 raw/chats）\n- 高价值 (high)：1\n"
        "- 中价值 (medium)：0\n- 低价值 (low)：1\n\n## 主题索引（按标签频次）\n\n- **y**：2 条会话\n- **z**：1 条会话\n\n## 使用说明\n\n- 检索：`S`\n"
        "- 详情：打开 `wiki/sessions/` 对应页\n")
    empty = _texts(ct.session_catalogue_fragments(parsed.limit(0), pages.limit(0), "D").unionByName(ct.session_overview_fragments(parsed.limit(0), "D")))
    assert "- wiki/sessions: 0\n" in empty["index.md"] and "**0** 条" in empty["overview.md"]


def test_source_page_names_its_raw_file(spark):
    row = spark.createDataFrame([("S.1", "sum", "raw/chats/a.md")], "session_id string, summary string, raw_path string")
    text = rd.render_source_pages(row, "D").first().text
    assert text.endswith("## 摘要\nsum\n\n## 萃取清单\n- [[session-s-1]] — 会话级要点（非 QA）\n\n## 原始路径\n`raw/chats/a.md`\n")
    assert "原始路径" not in rd.render_source_pages(row.drop("raw_path"), "D").first().text


def test_long_category_in_parts(spark):
    """A category with nearly all rows and many equal lengths is numbered without gaps over its parts."""
    rows = [(i, "a" if i % 50 else "b", f"T{i}", f"文档-{i}", "s", "x" * (i % 3), "u", "x") for i in range(700)]
    docs, cats, concepts = _inputs(spark, rows)
    got = _texts(ct.doc_category_fragments(docs, cats, concepts, "D", per_part=100))
    want = [i for _, i in sorted((-(i % 3), i) for i in range(700) if i % 50)]
    parts = [got["categories/分类-A.md"], *(got[f"categories/分类-A.part{k}.md"] for k in range(1, 7))]
    seen = re.findall(r"### (\d+)\. T(\d+)\n", "".join(parts))
    assert [(int(n), int(i)) for n, i in seen] == list(enumerate(want, 1))


def test_sections_shuffle_no_text(spark):
    docs = spark.createDataFrame([(i, f"c{i % 2}", f"title {i}", f"f{i}", "x" * (i % 5)) for i in range(40)], "ord long, category_id string, title string, file_name string, content string")
    cats = spark.createDataFrame([("c0", "C"), ("c1", "D"), ("c2", "E")], "category_id string, title string")
    out = ct.doc_sections(docs, cats, 2)
    steps = out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).split("\n\n")
    assert not any("content#" in x for x in steps if "Exchange" in x.split("\n")[0])
    got = {r.category_id: (r.n, [d.file_name for d in r.top]) for r in out.collect()}
    assert got == {"c0": (20, ["f4", "f14"]), "c1": (20, ["f9", "f19"])}
