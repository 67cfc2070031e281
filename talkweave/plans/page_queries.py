"""Repair, rendering, parsing and writer queries over pages derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkweave.functions import text as tx
from talkweave.operators import docs as dc
from talkweave.operators import faq as fq
from talkweave.operators import render as rd
from talkweave.operators import repair as rp
from talkweave.plans.faq_queries import CATS, CHAT_FAQ_SQL, FAQ_EXT_SQL, FAQ_RULES, _STEPN, _summary_sql, chat_faqs, extracted
from talkweave.plans.message_queries import POINTS_SQL, SUMMARY_SQL, summaries
from talkweave.plans import sqltext as s
from talkweave.plans.graph_queries import RESOLVED_SQL, WIKI_EDGES
from talkweave.plans.registry import SQL, query
from talkweave.plans.text_queries import _CORE, WIKI_WITH
from talkweave.session import cut_lineage, shared_folder
from talkweave.sources import readers as rs
from talkweave.sources.adapters import DOCS_SQL
from talkweave.sources.writers import append_run_log, assemble_fragments, taxonomy_document, write_pages_markdown, write_report

DAY = "2024-01-01"


def pages(t):
    return t.wiki_pages()


@query("fix1_rewrite_links", WIKI_WITH + """, l AS (SELECT stem, unnest(regexp_extract_all(text, '\\[\\[ ([^\\]|]+) \\]\\]', 1)) AS raw FROM wiki)
SELECT wiki.stem, (SELECT count(*) FROM l WHERE l.stem = wiki.stem AND raw IN (SELECT stem FROM wiki)) AS rewrites FROM wiki""")
def _(t):
    # blanks around a target are the only difference that resolves here
    p = pages(t)
    known = p.select("stem")
    out = rp.rewrite_links(p)
    return out.join(known, "stem", "left_semi").select("stem", F.col("rewrites").cast("bigint").alias("rewrites"))


@query("fix2_normalize_taxonomy_links")
def _(t):
    return rp.normalize_taxonomy_links(pages(t)).filter(F.col("page_type").isin("category", "concept")).select(
        "stem", "removed", "to_markdown", "canonicalized", F.md5("text").alias("text"))


ORPHAN_SQL = WIKI_EDGES + ", o AS (SELECT stem, page_type, rel_path, text FROM wiki WHERE stem NOT IN (SELECT dst FROM we WHERE kind = 'wikilink'))"


@query("fix3_relink_orphans", ORPHAN_SQL + """, f AS (SELECT *, regexp_extract(text, 'category: "\\[\\[([^\\]]+)\\]\\]"', 1) AS page FROM o WHERE page_type = 'faq')
SELECT page, '## 补链索引（孤儿页）' AS section, stem AS ord, '- [[' || stem || ']]' AS line FROM f WHERE page IN (SELECT stem FROM wiki WHERE page_type = 'category')
UNION ALL SELECT 'index', CASE page_type WHEN 'category' THEN '### 其他主题页（补链索引）' ELSE '### 概念页补链（无入链别名）' END, stem, '- [[' || stem || ']]' FROM o WHERE page_type <> 'faq'
UNION ALL SELECT 'index', '### 标准 Markdown 补链（wikilink 不适用的页面）', rel_path, concat('- [', regexp_extract(text, '\\n# ([^\\n]+)', 1), '](', rel_path, ')') FROM o WHERE page_type = 'faq' AND stem NOT IN (SELECT stem FROM f WHERE page IN (SELECT stem FROM wiki WHERE page_type = 'category'))""")
def _(t):
    return rp.relink_orphans(pages(t))


@query("fix4_complete_index", WIKI_WITH + """SELECT 'index' AS page, CASE page_type WHEN 'category' THEN '### 自动补链主题' ELSE '### 自动补链概念' END AS section, stem AS ord, '- [[' || stem || ']]' AS line
FROM wiki WHERE page_type IN ('category', 'concept') AND NOT contains(text, chr(10) || '# en ')""")
def _(t):
    p = pages(t)
    return rp.complete_index(p, p.filter(F.contains("text", F.lit("\n# en "))).select(F.col("stem").alias("dst")))


@query("fix5_backfill_concept_faqs", WIKI_WITH + """, c AS (SELECT stem, regexp_extract(text, '\\n# ([^\\n]+)', 1) AS title FROM wiki WHERE page_type = 'concept'),
w AS (SELECT stem, unnest(string_split(lower(title), ' ')) AS w FROM c), m AS (SELECT DISTINCT w.stem AS page, f.stem AS faq FROM w JOIN wiki f ON f.page_type = 'faq' AND length(w) >= 2 AND contains(f.stem, w)),
r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY faq) AS n FROM m) SELECT page, '## 自动补链 FAQ' AS section, faq AS ord, '- [[' || faq || ']]' AS line FROM r WHERE n <= 5""")
def _(t):
    # pages without their link lists
    bare = pages(t).withColumn("text", F.regexp_replace("text", "(?s)## 相关.*", ""))
    return rp.backfill_concept_faqs(bare)


_LINK_SQL = "'\\[\\[([^\\]|]+)(\\|[^\\]]+)?\\]\\]'"


@query("fix6_autofix_report", RESOLVED_SQL + f""", bare AS (SELECT {s.sub("text", "(?s)```.*?```")} AS t FROM wiki WHERE page_type IN ('category', 'concept')),
tl AS (SELECT unnest(regexp_extract_all(t, {_LINK_SQL}, 1)) AS target, unnest(regexp_extract_all(t, {_LINK_SQL}, 2)) AS alias FROM bare),
act AS (SELECT CASE WHEN starts_with(target, '.agent-queue/') OR raw = '' OR {s.hit("raw", '[$][{]|"|/opt/|https?://')} THEN 'keep' WHEN resolved IS NULL THEN 'removed'
  WHEN {s.hit("resolved", "[]" + chr(92) + "[]")} THEN 'to_markdown' WHEN raw <> resolved OR alias <> '' THEN 'canonicalized' ELSE 'keep' END AS a FROM tl JOIN resolved USING (target))
SELECT 'files_scanned' AS metric, count(*) AS n FROM wiki
UNION ALL SELECT 'link_rewrites', CAST(sum(rewrites) AS BIGINT) FROM ({SQL["fix1_rewrite_links"]})
UNION ALL SELECT 'taxonomy_' || k, (SELECT count(*) FROM act WHERE a = k) FROM (VALUES ('removed'), ('to_markdown'), ('canonicalized')) v(k)
UNION ALL SELECT 'added: ' || section, count(*) FROM (SELECT section FROM ({SQL["fix4_complete_index"]}) UNION ALL SELECT section FROM ({SQL["fix3_relink_orphans"]})) GROUP BY 1""")
def _(t):
    p = pages(t)
    index = p.filter(F.contains("text", F.lit("\n# en "))).select(F.col("stem").alias("dst"))
    return rp.autofix_report(rp.rewrite_links(p), rp.normalize_taxonomy_links(p), rp.complete_index(p, index).unionByName(rp.relink_orphans(p)))


@query("fix3b_apply_additions", ORPHAN_SQL.replace("WITH ", "WITH ", 1) + """, f AS (SELECT stem, regexp_extract(text, 'category: "\\[\\[([^\\]]+)\\]\\]"', 1) AS page FROM o WHERE page_type = 'faq'),
b AS (SELECT page, '\n## 补链索引（孤儿页）\n\n' || string_agg('- [[' || stem || ']]', chr(10) ORDER BY stem) || chr(10) AS more FROM f GROUP BY 1)
SELECT stem, 0 AS part, md5(CASE WHEN more IS NULL THEN text ELSE """.replace("\n##", "' || chr(10) || '##").replace("）\n\n'", "）' || chr(10) || chr(10)") + f"{s.sub('text', f'[{tx.BLANK}]+' + chr(92) + 'z')} || chr(10) || more END) AS h FROM wiki LEFT JOIN b ON b.page = wiki.stem WHERE page_type = 'category'")
def _(t):
    p = pages(t)
    out = rp.apply_additions(p, rp.relink_orphans(p))
    return out.join(p.filter("page_type = 'category'").select("stem"), "stem", "left_semi").select("stem", "part", F.md5("text").alias("h"))


# --- parsing --------------------------------------------------------------------------------------

@query("ext10_parse_faq_pages", WIKI_WITH + f"""SELECT stem AS file_name, lang || ' ' || source || ' ' || doc_id AS question, md5({s.strip("regexp_extract(wiki.text || chr(10) || '## ', '(?s)## 标准回答' || chr(92) || 's*' || chr(92) || 'n+(.*?)' || chr(92) || 'n##' || chr(92) || 's', 1)")}) AS answer,
 source || '|' || lang AS variants, source || '|' || lang AS steps, CAST(1 + doc_id % 4 AS BIGINT) AS source_count FROM wiki JOIN documents ON doc_id = ord""")
def _(t):
    return rd.parse_faq_pages(pages(t)).select("file_name", "question", F.md5("answer").alias("answer"), F.array_join("variants", "|").alias("variants"),
                                               F.array_join("steps", "|").alias("steps"), "source_count")


def _concept_pages(t):
    rows = t.read("documents").groupBy("source").agg(F.min("doc_id").alias("d"), F.max("lang").alias("l"))
    return rd.render_concept_pages(rows.select(
        F.col("source").alias("concept_id"), F.concat(F.lit("T "), "source").alias("title"), F.concat(F.lit("D "), "l").alias("definition"),
        F.concat(F.lit("概念-"), "source").alias("file_name"), F.array("l", F.col("d").cast("string")).alias("points"),
        F.array(F.concat(F.lit("问答-"), "d")).alias("related_names"), F.array(F.concat(F.lit("分类-"), "l")).alias("category_pages")), DAY)


@query("ext10b_parse_concept_pages", "SELECT source AS concept_id, 'T ' || source AS title, 'D ' || max(lang) AS definition, '概念-' || source AS file_name, max(lang) || '|' || min(doc_id) AS points FROM documents GROUP BY source")
def _(t):
    stem = F.regexp_extract("rel_path", "([^/]*)\\.md\\z", 1)
    return rd.parse_concept_pages(_concept_pages(t).withColumn("stem", stem)).withColumn("points", F.array_join("points", "|"))


def _doc_pages(t):
    docs = t.docs().withColumn("file_name", F.concat(F.lit("文档-"), "doc_id")).withColumn("summary", tx.doc_summary(F.col("content")))
    docs = docs.withColumn("category_page", F.concat(F.lit("分类-"), "lang")).withColumn("category_title", F.col("lang")).withColumn(
        "content", F.regexp_replace(tx.strip(F.col("content")), "\\n#", "\n")).withColumn("related_doc_names", F.array("file_name"))
    return rd.render_doc_pages(docs.filter("title <> ''"), DAY)


@query("ext10c_parse_doc_pages", f"""WITH {DOCS_SQL}, c AS (SELECT *, {s.sub(s.strip('content'), chr(92) + 'n#', chr(10))} AS body FROM docs WHERE title <> '')
SELECT source_url, source_site, '文档-' || doc_id AS file_name, md5(body) AS content FROM c""")
def _(t):
    stem = F.regexp_extract("rel_path", "([^/]*)\\.md\\z", 1)
    return rd.parse_doc_pages(_doc_pages(t).withColumn("stem", stem)).select("source_url", "source_site", "file_name", F.md5("content").alias("content"))


# --- rendering ----------------------------------------------------------------------------------------

def _named_faqs(t):
    faqs = dc.unique_names(cut_lineage(chat_faqs(t)).drop("file_name"), F.concat(F.lit("问答-"), tx.faq_core_title(F.col("question"))), F.col("question"), "ord")
    return faqs.withColumn("category_page", F.concat(F.lit("分类-"), "category_id")).withColumn("category_title", F.upper("category_id")).withColumn(
        "overview", F.concat(F.lit("about "), "category_id"))


def _list_sql(x: str, line: str) -> str:
    """A line for each entry ``y`` (number ``i``) of a list."""
    return f"coalesce(array_to_string(list_transform({x}, lambda y, i: {line} || chr(10)), ''), '')"


def _section_sql(head: str, x: str, line: str) -> str:
    return f"CASE WHEN len({x}) > 0 THEN {s.q(head)} || {_list_sql(x, line)} ELSE '' END"


_CORE_Q = _CORE.replace("content", "question")
_TITLE_Q = f"coalesce(nullif(CASE WHEN length(x) > 42 THEN {s.sub('substr(x, 1, 42)', '[，、的了吗呢]+' + chr(92) + 'z')} ELSE x END, ''), '未命名问题')"
NAMED_SQL = f"""{CHAT_FAQ_SQL}, nb AS (SELECT *, '问答-' || {_TITLE_Q} AS base FROM (SELECT *, {_CORE_Q} AS x FROM merged)),
nr AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY ord) AS rn, base || '-' || substr(md5(question), 1, 6) AS cand FROM nb),
nc AS (SELECT *, row_number() OVER (PARTITION BY cand, rn > 1 ORDER BY ord) AS cn FROM nr),
named AS (SELECT *, CASE WHEN rn = 1 THEN base WHEN cn = 1 THEN cand ELSE cand || cn END AS file_name, '分类-' || category_id AS page FROM nc)"""
_FAQ_PAGE = s.filled(
    "---\ntype: faq\ncategory: \"[[{page}]]\"\ntags: [{title}]\nsource_count: {n}\nupdated_at: {day}\n---\n\n# {question}\n\n## 客户问法\n\n{asked}\n"
    "## 标准回答\n\n{answer}\n{steps}\n## 相关\n- [[{page}]]\n", page="page", title="upper(category_id)", n="source_count", day=s.q(DAY), question="question",
    asked=_list_sql("[question] || variants", "'- ' || y"), answer=s.strip("answer"), steps=_section_sql("\n## 操作步骤\n", "steps", "i || '. ' || y"))


@query("ext11_render_faq_pages", f"""WITH {NAMED_SQL}, p AS (SELECT 'faqs/' || file_name || '.md' AS rel_path, {_FAQ_PAGE} AS text FROM named)
SELECT rel_path, md5(text) AS h, length(text)::INT AS n FROM p""")
def _(t):
    return rd.render_faq_pages(_named_faqs(t), DAY).select("rel_path", F.md5("text").alias("h"), F.length("text").alias("n"))


_CATEGORY_HEAD = s.filled(
    "---\ntype: category\ncategory_id: {id}\nfaq_count: {n}\nupdated_at: {day}\n---\n\n# {title}\n\n## 主题概述\n\nabout {id}\n\n"
    "本主题共整理 **{n}** 条客户问答（相似问题已合并），**{steps}** 条含操作步骤。\n\n## 主题内问答总结\n\n",
    id="category_id", n="count(*)", day=s.q(DAY), title="upper(category_id)", steps="count(*) FILTER (len(steps) > 0)")
_ENTRY = s.filled(
    "### {i}. {question}\n\n> 详情页：[[{name}]]（合并来源 {n} 条会话）\n\n{asked}**标准回答：**\n\n{answer}\n\n{steps}---\n\n", i="idx", question="question", name="file_name",
    n="source_count", answer=s.strip("answer"), asked=_section_sql("**常见问法：**\n", "variants[1:6]", "'- ' || y").replace("ELSE ''", "|| chr(10) ELSE ''"),
    steps=_section_sql("**操作步骤：**\n", "steps", "i || '. ' || y").replace("ELSE ''", "|| chr(10) ELSE ''"))


@query("ext11b_category_fragments", f"""WITH {NAMED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY source_count DESC, ord) AS idx FROM named),
f AS (SELECT page, 0 AS part, 0 AS frag, {_CATEGORY_HEAD} AS text FROM named GROUP BY page, category_id
UNION ALL SELECT page, (idx - 1) // 10, idx, {_ENTRY} FROM r
UNION ALL SELECT page, (idx - 1) // 10, idx + {1 << 40}, CASE WHEN idx = 1 THEN {s.q("## 本主题 FAQ 索引" + chr(10) * 2)} ELSE '' END || '- [[' || file_name || ']]' || chr(10) FROM r)
SELECT 'categories/' || page || '.md' AS rel_path, part, frag, md5(text) AS h FROM f""")
def _(t):
    return rd.category_fragments(_named_faqs(t), DAY, 10).select("rel_path", "part", "frag", F.md5("text").alias("h"))


@query("ext11c_render_concept_pages", """WITH c AS (SELECT source, 'D ' || max(lang) AS d, max(lang) AS l, min(doc_id) AS i FROM documents GROUP BY 1)
SELECT concat('concepts/概念-', source, '.md') AS rel_path, md5(concat('---', chr(10), 'type: concept', chr(10), 'concept_id: ', source, chr(10), 'updated_at: 2024-01-01', chr(10), '---', chr(10), chr(10), '# T ', source, chr(10), chr(10),
 '## 定义', chr(10), chr(10), d, chr(10), chr(10), '## 从客户问答中归纳的要点', chr(10), chr(10), '- ', l, chr(10), '- ', i, chr(10), chr(10), '## 关联问答', chr(10), '- [[问答-', i, ']]', chr(10), chr(10), '## 相关主题', chr(10), '- [[分类-', l, ']]', chr(10))) AS h FROM c""")
def _(t):
    return _concept_pages(t).select("rel_path", F.md5("text").alias("h"))


_BODY = s.sub(s.strip("content"), "\\n#", "\n")
_DOC_PAGE = s.filled(
    "---\ntype: website-doc\ncategory: \"[[分类-{lang}]]\"\ntags: [{lang}]\nsource_url: {url}\nsource_site: {site}\nupdated_at: {day}\n---\n\n# {title}\n\n"
    "## 内容摘要\n\n{summary}\n\n## 正文内容\n\n{body}\n\n## 相关\n- [[分类-{lang}]]\n- 来源：{url}\n- [[文档-{id}]]\n",
    lang="lang", url="source_url", site="source_site", day=s.q(DAY), title="title", summary="summary", body=_BODY, id="doc_id")


@query("ext11d_render_doc_pages", f"""WITH {DOCS_SQL}, x AS (SELECT *, {s.strip(s.one_space(s.sub("content", "[#*`" + chr(92) + "[" + chr(92) + "]()" + chr(92) + "-_]", " ")))} AS x FROM docs WHERE title <> ''),
y AS (SELECT *, CASE WHEN length(x) > 300 THEN substr(x, 1, 300) || '...' ELSE x END AS summary FROM x)
SELECT 'faqs/文档-' || doc_id || '.md' AS rel_path, md5({_DOC_PAGE}) AS h FROM y""")
def _(t):
    return _doc_pages(t).select("rel_path", F.md5("text").alias("h"))


_BULLETS = "(CASE WHEN {c} IS NULL THEN '- {none}' || chr(10) ELSE array_to_string(list_transform(string_split({c}, '|'), lambda y: '- ' || y || chr(10)), '') END)"
_SESSION_PAGE = s.filled(
    "---\ntype: session\nsession_id: \"{id}\"\ntags: [{tags}]\nsources:\n  - \"[[source-session-{id}]]\"\nupdated_at: {day}\nvalue: {value}\n---\n\n# 会话 {id} — {title}\n\n"
    "## 会话摘要\n{summary}\n\n## 关键信息\n{points}\n## 操作与政策摘录\n{steps}\n## 相关\n- [[source-session-{id}]]\n",
    id="session_id", tags="coalesce(nullif(array_to_string(tags, ', '), ''), '客服')", day=s.q(DAY), value="value", title="title", summary="summary",
    points=_BULLETS.format(c="key_points", none="（见对话记录）"), steps=_BULLETS.format(c="steps", none="（会话未给出明确操作步骤）"))
_SOURCE_PAGE = s.filled(
    "---\ntype: source\nsource_type: chat\nsource_id: session_{id}\ningested_at: {day}\n---\n\n# 来源：会话 {id}\n\n## 摘要\n{summary}\n\n"
    "## 萃取清单\n- [[session-{id}]] — 会话级要点（非 QA）\n", id="session_id", day=s.q(DAY), summary="summary")


@query("ext11e_render_session_pages", f"""WITH {SUMMARY_SQL}, {POINTS_SQL}, a AS (SELECT * FROM summ LEFT JOIN kp USING (session_id) LEFT JOIN sp USING (session_id))
SELECT 'sessions/' || session_id || '.md' AS rel_path, 'session' AS page_type, md5({_SESSION_PAGE}) AS h FROM a
UNION ALL SELECT 'sources/source-session-' || session_id || '.md', 'source', md5({_SOURCE_PAGE}) FROM a""")
def _(t):
    both = cut_lineage(summaries(t))
    out = rd.render_session_pages(both, DAY).unionByName(rd.render_source_pages(both, DAY))
    return out.select("rel_path", "page_type", F.md5("text").alias("h"))


_CATEGORY_ORDER = "CASE category_id WHEN 'german' THEN 0 WHEN 'french' THEN 1 WHEN 'spanish' THEN 2 WHEN 'english' THEN 3 ELSE 4 END"
_STAT = {"categories": "(SELECT count(*) FROM c)", "faqs": "(SELECT count(*) FROM named)", "concepts": "2", "raw": "(SELECT sum(source_count) FROM named)", "day": s.q(DAY)}
_INDEX_HEAD = s.filled(
    "# 智能客服知识库\n\n> 按业务主题分类的客户知识索引。更新：{day}\n\n## 统计\n\n- 主题分类：**{categories}** 个\n- 客户问答（合并后）：**{faqs}** 条\n"
    "- 产品概念：**{concepts}** 个\n- 原始会话（仅 raw）：{raw} 条\n\n## 主题分类\n\n", **_STAT)
_INDEX_SECTION = s.filled(
    "### {title}\n\nabout {id}\n\n- 主题页（含全部 FAQ 内总结）：[[分类-{id}]]\n- 本主题 FAQ 约 **{n}** 条\n- 高频问题：\n{top}\n",
    title="upper(category_id)", id="category_id", n="n", top=_list_sql("top", "'  - ' || y"))
_HIT = "regexp_matches(lower(question || answer || array_to_string(variants, ' ')), {p})"


@query("ext11f_index_and_overview", f"""WITH {NAMED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY category_id ORDER BY source_count DESC, ord) AS place FROM named),
c AS (SELECT category_id, {_CATEGORY_ORDER} AS o, count(*) AS n, list(question ORDER BY place) FILTER (place <= 5) AS top FROM r GROUP BY 1),
k AS (SELECT 0 AS o, 'con-a' AS id WHERE (SELECT bool_or({_HIT.format(p="'with'")}) FROM named) UNION ALL SELECT 1, 'con-b' WHERE (SELECT bool_or({_HIT.format(p="'les'")}) FROM named)),
w AS (SELECT 'index.md' AS rel_path, {_INDEX_HEAD} || (SELECT string_agg({_INDEX_SECTION}, '' ORDER BY o) FROM c)
  || coalesce((SELECT string_agg(CASE WHEN o = 0 THEN {s.q("## 产品概念" + chr(10) * 2)} ELSE '' END || '- [[概念-' || id || ']]：' || id || chr(10), '' ORDER BY o) FROM k), '') AS text
UNION ALL SELECT 'overview.md', {s.filled("# 知识库总览" + chr(10) * 2 + "> 更新：{day}" + chr(10) * 2 + "- 合并后 FAQ：**{faqs}** 条" + chr(10) + "- 概念页：**{concepts}** 个" + chr(10) * 2 + "## 主题分布" + chr(10) * 2, **_STAT)}
  || (SELECT string_agg('- **' || upper(category_id) || '**：' || n || ' 条 FAQ → [[分类-' || category_id || ']]' || chr(10), '' ORDER BY o) FROM c))
SELECT rel_path, md5(text) AS h, length(text)::INT AS n FROM w""")
def _(t):
    faqs = cut_lineage(_named_faqs(t))
    order = F.when(F.col("category_id") == "german", 0).when(F.col("category_id") == "french", 1).when(F.col("category_id") == "spanish", 2).when(
        F.col("category_id") == "english", 3).otherwise(4)
    cats = fq.faq_by_category(faqs).select(order.alias("ord"), F.upper("category_id").alias("title"), F.concat(F.lit("about "), "category_id").alias("overview"),
                                           F.concat(F.lit("分类-"), "category_id").alias("category_page"), "n", "top_questions")
    concepts = fq.extract_concepts(faqs, [("con-a", ["with"]), ("con-b", ["les"])]).select(
        F.when(F.col("concept_id") == "con-a", 0).otherwise(1).alias("ord"), F.col("concept_id").alias("title"), F.concat(F.lit("概念-"), "concept_id").alias("file_name"))
    stats = faqs.agg(F.count_distinct("category_id").alias("categories"), F.count(F.lit(1)).alias("faqs"), F.lit(2).alias("concepts"), F.sum("source_count").alias("raw_sessions"))
    frags = rd.index_fragments(cats, concepts, stats, DAY).unionByName(rd.overview_fragments(cats, stats, DAY))
    return assemble_fragments(frags).select("rel_path", F.md5("text").alias("h"), F.length("text").alias("n"))


_DRAFT_PAGE = s.filled(
    "---\ntype: faq\nsource: cursor-agent\ncategory: \"[[分类-{id}]]\"\ntags: [{title}]\nsource_session_id: {session}\nupdated_at: {day}\n---\n\n# {question}\n\n"
    "## 会话摘要\n\n{summary}\n\n## 客户问法\n\n{asked}\n## 标准回答\n\n{answer}\n{steps}\n## 相关\n- [[分类-{id}]]\n",
    id="category_id", title=f"(CASE category_id {' '.join(f'WHEN {s.q(c)} THEN {s.q(n)}' for c, n, _ in CATS)} END)", session="session_id", day=s.q(DAY),
    question="question", summary=_summary_sql(), asked=_list_sql("list_filter([question] || variants, lambda v: v <> '')", "'- ' || y"),
    answer=s.strip("answer"), steps=_section_sql("## 操作步骤\n", f"({_STEPN}[1:10])", "i || '. ' || y"))


@query("ext11g_render_drafts", f"""WITH {FAQ_EXT_SQL} SELECT '.agent-queue/faq-drafts/' || session_id || '.md' AS rel_path, md5({_DRAFT_PAGE}) AS h FROM ext""")
def _(t):
    ext = fq.enrich_extractions(extracted(t), FAQ_RULES).withColumn("category_page", F.concat(F.lit("分类-"), "category_id"))
    return rd.render_draft_pages(ext, DAY).select("rel_path", F.md5("text").alias("h"))


@query("agg18_draft_review_index", WIKI_WITH + """, d AS (SELECT stem, regexp_extract(text, 'category: "\\[\\[([^\\]]+)\\]\\]"', 1) AS category, regexp_extract(text, '\\n# ([^\\n]+)', 1) AS question FROM wiki),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY stem) AS n, count(*) OVER (PARTITION BY category) AS c FROM d)
SELECT category, 0 AS frag, concat('### ', category, '（', count(*), '）') AS text FROM d GROUP BY 1
UNION ALL SELECT category, n, concat('- [[.agent-queue/faq-drafts/', stem, '|', question, ']]') FROM r WHERE n <= 6
UNION ALL SELECT DISTINCT category, 1073741824, concat('- ... 其余 ', c - 6, ' 条') FROM r WHERE c > 6""")
def _(t):
    return rd.draft_review_fragments(rd.parse_drafts(pages(t)), 6)


# --- readers over documents made of table rows ---------------------------------------------------------

@query("src2_session_docs", """SELECT conv_id AS session_id, count(*) AS n, min(turn) AS first_turn, 'note ' || conv_id AS link_section FROM conversations WHERE role <> 'system' AND text <> '' GROUP BY 1""")
def _(t):
    m = t.chat_messages().filter("sender_type <> 3 AND content <> ''")
    line = F.concat(F.lit("- ["), "msg_id", F.lit("] **"), tx.role_label(F.col("sender_type")), F.lit("**: x "), F.regexp_extract("content", "^[^\\n]*", 0))
    rows = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("msg_id", line.alias("l")))), lambda x: x["l"]), "\n")
    docs = m.groupBy("session_id").agg(rows.alias("rows"))
    text = F.concat(F.lit("---\nsource_type: chat\nsession_id: \""), "session_id", F.lit("\"\nmessage_count: 9\n---\n\n# 会话\n\n## 对话记录\n"), "rows",
                    F.lit("\n\n## 链接与附件内容\n\nnote "), "session_id", F.lit("\n"))
    files = docs.select(F.concat(F.lit("file:/chats/session_"), "session_id", F.lit(".md")).alias("file_path"), text.alias("text"))
    out = rs.parse_session_docs(files)
    return out.select(F.col("session_id").cast("bigint").alias("session_id"), F.size("transcript").cast("bigint").alias("n"),
                      F.get("transcript", F.lit(0))["ts"].cast("bigint").alias("first_turn"), "link_section")


@query("src3_wiki_pages", WIKI_WITH + "SELECT stem, rel_path, page_type, regexp_extract(text, '\\n# ([^\\n]+)', 1) AS title FROM wiki")
def _(t):
    files = pages(t).select(F.concat(F.lit("file:/kb/wiki/"), "rel_path").alias("file_path"), "text")
    return rs.parse_wiki_pages(files, "/kb/wiki").select("stem", "rel_path", "page_type", "title")


@query("src5_extractions", """SELECT CAST(doc_id AS VARCHAR) AS session_id, CASE doc_id % 3 WHEN 0 THEN 'api-token' ELSE 'job-schedule' END AS category_id, md5(text) AS answer FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0""")
def _(t):
    n = F.col("doc_id")
    body = F.to_json(F.struct((n % 5 == 0).alias("skip"), F.when(n % 3 == 0, "api-token").alias("category_id"),
                              F.when(n % 3 != 0, "作业提交与调度（Slurm / 排队 / 任务异常）").alias("category_title"), F.col("source").alias("question"), F.col("text").alias("answer")))
    text = F.when(n % 7 == 0, "not json").otherwise(F.concat(F.lit("```json\n"), body, F.lit("\n```")))
    files = t.read("documents").select(F.concat(F.lit("file:/q/"), "doc_id", F.lit(".json")).alias("file_path"), text.alias("text"))
    return rs.parse_extractions(files).select("session_id", "category_id", F.md5("answer").alias("answer"))


def _taxonomy_raw(t):
    n = F.col("doc_id")
    row = F.struct(n.alias("o"), F.concat(F.lit("Cat "), "doc_id").alias("id"), F.concat("lang", F.lit(" "), "doc_id").alias("title"), F.when(n % 2 == 0, F.col("source")).otherwise("").alias("overview"))
    docs = t.read("documents")
    cats = docs.groupBy("source").agg(F.sort_array(F.collect_list(row)).alias("c"))
    return cats.select("source", F.transform("c", lambda x: F.struct(x["id"].alias("id"), x["title"].alias("title"), x["overview"].alias("overview"))).alias("categories"),
                       F.expr("cast(array() as array<struct<id:string,title:string,definition:string,related_doc_indices:array<double>>>)").alias("concepts"),
                       F.expr("cast(array() as array<struct<source_url:string,doc_index:string,category_id:string>>)").alias("assignments"),
                       F.expr("cast(array() as array<struct<source_url:string,summary:string,related_concept_ids:array<string>,related_doc_urls:array<string>,related_urls:array<string>>>)").alias("doc_enrichments"))


@query("src6_taxonomy", "SELECT 'cat-' || doc_id AS id, lang || ' ' || doc_id AS title, CASE doc_id % 2 WHEN 0 THEN source ELSE lang || ' ' || doc_id END AS overview FROM documents")
def _(t):
    return rs.parse_taxonomy(_taxonomy_raw(t))["categories"].select("id", "title", "overview")


@query("src7_graph_edges", """SELECT page_id AS s, 'p' || page_id AS src, 'p' || (page_id + 1) AS dst, CASE page_id % 3 WHEN 0 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM pages""")
def _(t):
    n = F.col("page_id")
    edge = F.struct(F.concat(F.lit("p"), n).alias("from"), F.concat(F.lit("p"), n + 1).alias("to"), F.when(n % 3 != 0, 0.5).alias("confidence"))
    out = rs.parse_graph_edges(t.read("pages").select(F.array(edge).alias("edges")))
    return out.select(F.substring("src", 2, 20).cast("bigint").alias("s"), "src", "dst", "confidence")


@query("jon15_attach_link_content", """SELECT page_id, CASE WHEN page_id % 4 = 1 THEN 1 ELSE 0 END + 1 AS failed, 3 AS n_links FROM pages""")
def _(t):
    n = F.col("page_id")
    own = F.concat(F.lit("https://doc.example/"), "page_id")
    text = F.concat(F.lit("see "), own, F.lit(" and http://10.0.0.1/x and https://doc.example/same then "), own)
    contents = t.read("pages").select(own.alias("url"), F.lit("page").alias("kind"), F.when(n % 4 != 1, F.col("html")).alias("content"), F.lit(None).cast("string").alias("error"))
    common = contents.limit(1).select(F.lit("https://doc.example/same").alias("url"), "kind", F.lit("shared").alias("content"), "error")
    out = rd.attach_link_content(t.read("pages").select("page_id", text.alias("text")), contents.unionByName(common), ["page_id"])
    return out.select("page_id", F.col("failed").cast("int").alias("failed"), F.col("n_links").cast("int").alias("n_links"))


@query("mrg13_rename_extractions", "SELECT CAST(doc_id AS VARCHAR) AS stem, concat('s', doc_id, '-x') AS session_id FROM documents")
def _(t):
    from talkweave.operators.merges import rename_extractions

    d = t.read("documents")
    ext = d.select(F.concat(F.lit("s"), "doc_id", F.lit("-")).alias("stem"))
    sessions = d.select(F.concat(F.lit("s"), "doc_id", F.lit("-x")).alias("session_id"))
    out = rename_extractions(ext, sessions)
    return out.select(F.regexp_extract("stem", "\\d+", 0).alias("stem"), "session_id")


@query("snk7_write_taxonomy", "SELECT count(*) AS categories, CAST(sum(n) AS BIGINT) AS docs FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)")
def _(t):
    cats, _docs = dc.site_taxonomy(t.docs())
    cats = cats.withColumn("ord", F.col("n_docs"))
    concepts = cats.select("ord", "id", "title", F.col("overview").alias("definition"), F.array("n_docs").alias("related_doc_indices"))
    back = F.from_json("value", rs.TAXONOMY_SCHEMA)
    doc = taxonomy_document(cats, concepts, "heuristic").select(back.alias("j"))
    return doc.select(F.size("j.categories").cast("bigint").alias("categories"), F.aggregate(
        "j.concepts", F.lit(0.0), lambda a, c: a + F.get(c["related_doc_indices"], F.lit(0))).cast("bigint").alias("docs"))




@query("snk1_write_pages", WIKI_WITH + "SELECT rel_path, stem, page_type, md5(text) AS h FROM wiki")
def _(t):
    folder = shared_folder(t.spark)
    write_pages_markdown(pages(t), folder)
    return rs.read_wiki_pages(t.spark, folder).select("rel_path", "stem", "page_type", F.md5("text").alias("h"))


@query("snk3_write_report", "SELECT source AS kind, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    folder = shared_folder(t.spark)
    write_report(t.read("documents").groupBy(F.col("source").alias("kind")).agg(F.count(F.lit(1)).alias("n")), folder)
    return t.spark.read.schema("kind string, n bigint").json(folder)


@query("snk6_append_run_log", """SELECT 'first' AS label, count(*) AS docs, count(DISTINCT source) AS sources FROM documents
UNION ALL SELECT 'second', count(*), count(DISTINCT source) FROM documents WHERE lang = 'en'""")
def _(t):
    folder, docs = shared_folder(t.spark), t.read("documents")
    for label, rows in (("first", docs), ("second", docs.filter("lang = 'en'"))):
        append_run_log(rows.agg(F.count(F.lit(1)).alias("docs"), F.countDistinct("source").alias("sources")), folder, label)
    return t.spark.read.schema("label string, docs bigint, sources bigint").json(folder)


@query("src1_chat_messages", """SELECT CASE WHEN conv_id % 13 = 5 THEN '  ' ELSE conv_id::VARCHAR END AS session_id, conv_id * 100000 + turn AS msg_id, CASE WHEN turn % 11 = 3 THEN NULL ELSE CASE role WHEN 'user' THEN 2 WHEN 'assistant' THEN 1 ELSE 3 END END AS sender_type,
 CASE WHEN conv_id % 13 = 5 THEN 'NO_SESSION' WHEN turn % 7 = 2 THEN 'BAD_TIME' WHEN turn % 11 = 3 THEN 'BAD_SENDER' WHEN text IS NULL THEN 'NO_CONTENT' END AS problem,
 CASE WHEN conv_id % 13 = 5 THEN '  ' WHEN turn % 7 = 2 THEN '2024-13-99' WHEN turn % 11 = 3 THEN 'x' || role END AS bad_value, md5(text) AS h FROM conversations""")
def _(t):
    # An export with other headers, in which some rows are broken.
    turn, conv = F.col("turn"), F.col("conv_id")
    raw = t.read("conversations").select(
        F.when(conv % 13 == 5, "  ").otherwise(conv.cast("string")).alias("mainUniqueId"), F.when(turn % 7 == 2, "2024-13-99").otherwise("2024-01-01 08:00:00").alias("createTime"),
        F.when(turn % 11 == 3, F.concat(F.lit("x"), "role")).otherwise(F.when(F.col("role") == "user", "2").when(F.col("role") == "assistant", "1").otherwise("3")).alias("senderType"),
        F.col("text").alias("content"), (conv * 100000 + turn).alias("msg_id"))
    return rs.checked_chat_rows(raw).select("session_id", "msg_id", "sender_type", "problem", "bad_value", F.md5("content").alias("h"))
