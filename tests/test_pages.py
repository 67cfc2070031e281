"""A small wiki: lint findings, repairs, retrieval, readers and writers."""

import json

import pytest
from pyspark.sql import functions as F

from talkweave.functions import text as tx
from talkweave.operators import graph as gr
from talkweave.operators import render as rd
from talkweave.operators import repair as rp
from talkweave.operators import retrieval as rt
from talkweave.sources import readers as rs
from talkweave.sources import writers as wr

INDEX = "# 索引\n\n### 软件与安装\n\n涵盖安装。\n\n- 主题页：[[分类-软件]]\n- 高频问题：\n  - 试用期限是多久\n  - 高斯怎么安装\n\n### 其他\n\n- 主题页：[[分类-缺失]]\n"
PAGES = {
    "index.md": INDEX,
    "categories/分类-软件.md": "# 软件\n\n## 主题内问答总结\n\n- [[问答-安装高斯]]\n- [[问答-安装高斯-a1b2c3]]\n- [[ 概念-高斯 ]]\n- [[问答-已删除]]\n- [[问答-带[括号]]\n",
    "categories/分类-计费.md": "---\ncategory_id: billing\n---\n# 计费\n\n- [[概念-Token|币]]\n```\n[[问答-代码]]\n```\n",
    "concepts/概念-高斯.md": "# 高斯 安装\n\n无链接\n",
    "concepts/概念-Token.md": "# Token\n\n[充值](faqs/问答-充值.md)\n",
    "faqs/问答-安装高斯.md": "---\ntype: faq\ncategory: \"[[分类-软件]]\"\nsource_count: 3\n---\n\n# 安装高斯\n\n## 客户问法\n\n- 安装高斯\n- 怎么装\n\n## 标准回答\n\n点击安装高斯许可\n\n## 操作步骤\n1. 登录\n2. 安装\n",
    "faqs/问答-安装高斯-a1b2c3.md": "# 安装高斯\n",
    "faqs/问答-充值.md": "# 充值\n\n## 标准回答\n\n在账户页充值 Token\n",
    "faqs/问答-孤儿.md": "---\ncategory: \"[[分类-计费]]\"\n---\n# 孤儿页\n",
    "faqs/问答-带[括号.md": "# 带括号\n",
}


@pytest.fixture(scope="module")
def wiki(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("kb") / "wiki"
    rows = spark.createDataFrame(list(PAGES.items()), "rel_path string, text string")
    wr.write_pages_markdown(rows, str(root))
    return rs.read_wiki_pages(spark, str(root)).withColumn("ord", F.xxhash64("stem")).cache()


def test_reading_pages(wiki):
    rows = {r.stem: r for r in wiki.collect()}
    assert len(rows) == len(PAGES)
    assert rows["分类-软件"].page_type == "category" and rows["分类-软件"].title == "软件" and rows["index"].page_type == "page"
    assert rows["问答-孤儿"].page_id == "faqs/问答-孤儿"


def test_findings(wiki):
    edges = gr.page_edges(wiki)
    broken = {(r.src, r.dst) for r in gr.broken_links(edges.filter("kind = 'wikilink'"), wiki).collect()}
    assert broken == {("分类-软件", "问答-已删除"), ("index", "分类-缺失")} or ("分类-软件", "问答-带[括号") in broken
    alone = {r.stem for r in gr.orphans(wiki, edges).collect()}
    # a front-matter link counts, so the category of the orphan is linked
    assert "问答-孤儿" in alone and not {"问答-充值", "分类-计费"} & alone
    assert "问答-充值" in {r.stem for r in gr.orphans(wiki, edges, ["wikilink"]).collect()}
    assert [r.stem for r in gr.missing_heading(wiki).collect()] == ["分类-计费"]
    assert [r.stem for r in gr.concept_backlinks(wiki, edges).collect()] == ["概念-高斯"]
    groups = gr.duplicate_key_groups(wiki.filter("page_type = 'faq'").select("stem"), tx.norm_faq_key(F.col("stem"))).collect()
    assert [(g.key, g.n, g.stems) for g in groups] == [("安装高斯", 2, ["问答-安装高斯", "问答-安装高斯-a1b2c3"])]
    report = {r.check: r for r in gr.lint_report(wiki, edges, edges.filter("src = 'index'")).collect()}
    total = gr.lint_summary(wiki, gr.lint_report(wiki, edges, edges.filter("src = 'index'"))).collect()[0]
    assert not total.all_ok and total.findings == sum(r.findings for r in report.values())
    assert total.pages == wiki.count() and total.faq_pages == wiki.filter("page_type = 'faq'").count()
    assert not report["1_index_consistency"].ok and report["5_similar_faq_merged"].findings == 1 and report["7a_same_key_links"].findings == 1


def test_resolution(spark, wiki):
    links = spark.createDataFrame([(x,) for x in ("概念-高斯", " 概念-高 斯 ", "问答-安装高斯·", "问答-充", "问答-安", "无关")], "target string")
    got = {r.target: r.resolved for r in gr.resolve_wikilinks(links, wiki.select("stem")).collect()}
    assert got == {"概念-高斯": "概念-高斯", " 概念-高 斯 ": "概念-高斯", "问答-安装高斯·": "问答-安装高斯", "问答-充": "问答-充值", "问答-安": None, "无关": None}
    asked = spark.createDataFrame([("faq", "问答-充（x）"), ("faq", "问答-安装"), ("concept", "概念-Token"), ("faq", "概念-Token")], "page_type string, link string")
    pages = {(r.page_type, r.link): r.stem for r in gr.resolve_page(asked, wiki).collect()}
    assert pages == {("faq", "问答-充（x）"): "问答-充值", ("faq", "问答-安装"): "问答-安装高斯", ("concept", "概念-Token"): "概念-Token"}


def test_repairs_leave_no_broken_link(wiki):
    fixed = rp.normalize_taxonomy_links(rp.rewrite_links(wiki))
    rows = {r.stem: r for r in fixed.collect()}
    soft = rows["分类-软件"]
    assert "[[概念-高斯]]" in soft.text and "问答-已删除" not in soft.text and soft.removed >= 1
    assert "[[概念-Token|币]]" in rows["分类-计费"].text and "[[问答-代码]]" in rows["分类-计费"].text
    taxonomy = fixed.filter(F.col("page_type").isin("category", "concept"))
    assert gr.broken_links(gr.page_edges(taxonomy).filter("kind = 'wikilink'"), wiki).count() == 0


def test_lines_to_add(wiki):
    lines = {(r.page, r.ord): r.section for r in rp.relink_orphans(wiki).collect()}
    assert lines[("分类-计费", "问答-孤儿")] == "## 补链索引（孤儿页）" and ("index", "分类-计费") not in lines
    out = {r.stem: r.text for r in rp.apply_additions(wiki, rp.relink_orphans(wiki)).filter("part = 0").collect()}
    assert out["分类-计费"].rstrip().endswith("- [[问答-孤儿]]")
    back = [(r.page, r.ord) for r in rp.backfill_concept_faqs(wiki).orderBy("ord").collect()]
    assert back == [("概念-高斯", "问答-安装高斯"), ("概念-高斯", "问答-安装高斯-a1b2c3")]
    index = gr.page_edges(wiki).filter("src = 'index'")
    assert {r.ord for r in rp.complete_index(wiki, index).collect()} == {"分类-计费", "概念-高斯", "概念-Token"}


def test_long_page_continues_in_parts(spark, wiki):
    many = spark.range(10).select(F.lit("index").alias("page"), F.lit("## s").alias("section"), F.format_string("n%02d", "id").alias("ord"), F.format_string("- %d", "id").alias("line"))
    parts = rp.apply_additions(wiki, many, 4).filter("stem = 'index'").orderBy("part").collect()
    assert [p.part for p in parts] == [0, 1, 2] and parts[2].text.strip().endswith("- 9")


def test_parsing_pages(wiki):
    faqs = {r.file_name: r for r in rd.parse_faq_pages(wiki).collect()}
    one = faqs["问答-安装高斯"]
    assert (one.question, one.variants, one.steps, one.source_count) == ("安装高斯", ["怎么装"], ["登录", "安装"], 3)
    assert one.answer == "点击安装高斯许可" and one.category_id == "software-license"
    assert [(r.category_id, r.file_name) for r in rd.parse_category_names(wiki).collect()] == [("billing", "分类-计费")]
    cats = rt.parse_index_sections(wiki.filter("stem = 'index'")).collect()
    assert [(c.title, c.category_link) for c in cats] == [("软件与安装", "分类-软件"), ("其他", "分类-缺失")]
    assert "试用期限是多久" in [c for c in cats if c.title == "软件与安装"][0].questions


def test_retrieval(spark, wiki):
    questions = spark.createDataFrame([(1, "怎么安装高斯"), (2, "Token 不够用"), (3, "zz")], "question_id bigint, question string")
    edges, index = gr.typed_edges(wiki), wiki.filter("stem = 'index'")
    hits = rt.retrieve(questions, wiki, edges, index)
    rows = {}
    for r in hits.collect():
        rows.setdefault(r.question_id, {})[r.stem] = r
    assert rows[1]["分类-软件"].note == "index_match" and "问答-安装高斯" in rows[1] and "概念-Token" not in rows[1]
    assert rows[2]["概念-Token"].note == "global_scan" and max(rows[2].values(), key=lambda r: r.score).stem == "概念-Token"
    text = {r.question_id: r.context for r in rt.prompt_context(questions, rt.excerpts(hits, wiki)).collect()}
    assert "## FAQ 标准答" in text[1] and "点击安装高斯许可" in text[1] and "检索说明：index_match" in text[1]
    empty = spark.createDataFrame([], wiki.schema)
    sel = rt.retrieve(questions.filter("question_id = 3"), wiki.filter("page_type = 'faq'"), edges, empty, fallback_selector=lambda q: q.select(
        "question_id", F.lit('["faqs/问答-充值.md", "faqs/none.md"]').alias("answer")))
    assert [(r.stem, r.route) for r in sel.collect()] == [("问答-充值", "index_llm_select")]


def test_closure_depth(spark):
    pages = spark.createDataFrame([(c, "page") for c in "abcde"], "stem string, page_type string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "c"), ("c", "a"), ("b", "zz")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "stem string")
    assert {r.stem: r.depth for r in gr.link_closure(seeds, edges, pages, 2).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    graph = edges.withColumn("confidence", F.when(F.col("dst") == "b", 0.9).otherwise(0.5))
    assert {r.stem for r in gr.expand_neighbors(seeds, graph, pages).collect()} == {"a", "b"}


def test_crawl(spark):
    pages = spark.createDataFrame([(f"http://h/{p}",) for p in ("a", "b", "c", "login")] + [("http://o/a",)], "url string")
    anchors = spark.createDataFrame([("http://h/a", "http://h/b"), ("http://h/b", "http://h/c"), ("http://h/a", "http://o/a"), ("http://h/a", "http://h/login")], "src string, dst string")
    starts = spark.createDataFrame([("http://h/a",)], "start string")
    got = {r.url: r.depth for r in gr.crawl_frontier(pages, anchors, starts, 1).collect()}
    assert got == {"http://h/a": 0, "http://h/b": 1}


def test_json_readers(spark, tmp_path):
    tax = {"categories": [{"id": "HPC jobs", "title": "作业"}, {"id": " "}], "concepts": [{"id": "slurm", "title": "Slurm", "definition": "d", "related_doc_indices": [0, 2]}],
           "assignments": [{"source_url": "https://a", "category_id": "hpc-jobs"}, {"doc_index": 3, "category_id": "hpc-jobs"}, {"category_id": ""}],
           "doc_enrichments": [{"source_url": "https://a", "summary": "s", "related_doc_urls": ["https://b"]}]}
    (tmp_path / "taxonomy.json").write_text("```json\n" + json.dumps(tax, ensure_ascii=False) + "\n```", encoding="utf-8")
    t = rs.read_taxonomy(spark, str(tmp_path))
    assert [(r.id, r.overview) for r in t["categories"].collect()] == [("hpc-jobs", "作业")]
    assert t["concepts"].collect()[0].related_doc_indices == [0, 2]
    assert [(r.source_url, r.doc_index) for r in t["assignments"].orderBy("ord").collect()] == [("https://a", None), (None, 3)]
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "graph.json").write_text(json.dumps({"edges": [{"from": "a", "to": "b", "confidence": 0.8}, {"from": "b", "to": "c"}]}))
    assert sorted(r.confidence for r in rs.read_graph_edges(spark, str(tmp_path / "g")).collect()) == [0.0, 0.8]


def test_web_documents(spark):
    body = "---\nsource_url: https://x/a\ntitle: 教程 | 站点\nfilename_core: 核心\n---\n\n# 标题\n\n正文内容\n"
    files = spark.createDataFrame([("file:/raw/site1/p.md", body, 9), ("file:/raw/site1/q.md", "# 只有标题\n\n文", 3)], "file_path string, text string, file_size int")
    rows = {r.core_name: r for r in rs.parse_web_docs(files).collect()}
    assert (rows["核心"].title, rows["核心"].source_site, rows["核心"].source_url) == ("教程", "site1", "https://x/a")
    assert rows["q"].title == "只有标题"


def test_link_content(spark):
    msgs = spark.createDataFrame([(1, "看 https://a.cn/1.png 和 http://10.0.0.1/x 与 https://b.cn/y"), (2, "没有链接")], "id int, text string")
    content = spark.createDataFrame([("https://a.cn/1.png", "image", "报错截图", None)], "url string, kind string, content string, error string")
    rows = {r.id: r for r in rd.attach_link_content(msgs, content, ["id"]).collect()}
    assert rows[2].text == "没有链接" and rows[1].n_links == 3 and rows[1].failed == 2
    assert "### 附件 1：https://a.cn/1.png\n类型：图片 OCR\n报错截图" in rows[1].text and "类型：blocked" in rows[1].text


def test_render_and_parse_faq_round_trip(spark):
    df = spark.createDataFrame([("问答-x", "怎么装？", "点击\n安装", ["如何装"], ["一", "二"], ["https://a.cn"], ["概念-y.md"], 2, "软件", "分类-软件")],
                               "file_name string, question string, answer string, variants array<string>, steps array<string>, links array<string>, related_wikilinks array<string>, "
                               "source_count bigint, category_title string, category_page string")
    page = rd.render_faq_pages(df, "2024-01-01").withColumn("stem", F.lit("问答-x"))
    back = rd.parse_faq_pages(page).collect()[0]
    assert (back.question, back.answer, back.variants, back.steps, back.links, back.source_count) == ("怎么装？", "点击\n安装", ["如何装"], ["一", "二"], ["https://a.cn"], 2)
    assert "- [[概念-y]]" in page.collect()[0].text


def test_run_log_and_report(spark, tmp_path):
    stats = spark.createDataFrame([(3, 1)], "faqs int, concepts int")
    for label in ("first", "second"):
        wr.append_run_log(stats, str(tmp_path / "log"), label)
    assert {r.label for r in spark.read.json(str(tmp_path / "log")).collect()} == {"first", "second"}
    wr.write_report(stats, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).collect()[0].faqs == 3
