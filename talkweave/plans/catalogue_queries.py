"""Catalogue pages of documents and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkweave.functions import text as tx
from talkweave.operators import catalogue as ct
from talkweave.operators import render as rd
from talkweave.plans import sqltext as s
from talkweave.plans.message_queries import SUMMARY_SQL, summaries
from talkweave.plans.registry import query
from talkweave.session import cut_lineage
from talkweave.sources.adapters import DOCS_SQL
from talkweave.sources.writers import assemble_fragments

DAY = "2024-01-01"
PER_PART = 100


def _base(t):
    """Documents by language, categories per language, concepts per source."""
    docs = t.docs().select("*", F.col("doc_id").alias("ord"), F.col("lang").alias("category_id"), tx.doc_summary(F.col("content")).alias("summary"),
                           F.concat(F.lit("文档-"), "doc_id").alias("file_name"))
    cats = docs.filter("lang IS NOT NULL").groupBy(F.col("lang").alias("category_id")).agg(F.min("ord").alias("ord")).select(
        "ord", "category_id", F.upper("category_id").alias("title"), F.concat(F.lit("about "), "category_id").alias("overview"),
        F.concat(F.lit("分类-"), "category_id").alias("category_page"))
    concepts = docs.filter("source_site IS NOT NULL").groupBy("source_site").agg(F.min("ord").alias("ord"), F.collect_set("category_id").alias("category_ids")).select(
        "ord", F.col("source_site").alias("title"), F.concat(F.lit("概念-"), "source_site").alias("file_name"),
        F.concat(F.lit("D "), "source_site").alias("definition"), "category_ids")
    return docs, cats, concepts


_SUMMARY = s.strip(s.one_space(s.sub("content", "[#*`\\[\\]()\\-_]", " ")))
BASE_SQL = f"""{DOCS_SQL}, cats AS (SELECT lang, min(doc_id) AS ord, count(*) AS n FROM docs WHERE lang IS NOT NULL GROUP BY 1),
cons AS (SELECT source_site AS site, min(doc_id) AS ord, list(DISTINCT lang) AS langs FROM docs WHERE source_site IS NOT NULL GROUP BY 1),
d AS (SELECT doc_id, lang, title, source_url, {_SUMMARY} AS x, row_number() OVER (PARTITION BY lang ORDER BY length(content) DESC, doc_id) AS i FROM docs WHERE lang IS NOT NULL)"""
_BLOCK = s.filled(ct.CATEGORY_DOC, idx="i", title="title", file_name="'文档-' || doc_id", source_url="source_url",
                  summary="CASE WHEN length(x) > 300 THEN substr(x, 1, 300) || '...' ELSE x END")
_HEAD = s.filled(ct.CATEGORY_HEAD, id="lang", n="n", today=s.q(DAY), title="upper(lang)", overview="'about ' || lang")
_CONCEPT = s.filled(ct.CATEGORY_CONCEPT, file_name="'概念-' || site", definition="'D ' || site")


@query("ext11h_doc_category_pages", f"""WITH {BASE_SQL},
b AS (SELECT lang, (i - 1) // {PER_PART} AS part, string_agg({_BLOCK}, '' ORDER BY i) AS body FROM d GROUP BY 1, 2),
k AS (SELECT cats.lang, string_agg({_CONCEPT}, '' ORDER BY cons.ord) AS lines FROM cats JOIN cons ON list_contains(cons.langs, cats.lang) GROUP BY 1),
p AS (SELECT lang, part, CASE WHEN part > 0 THEN body ELSE {_HEAD} || coalesce({s.q(ct.CATEGORY_CONCEPTS)} || lines || chr(10), '') || {s.q(ct.CATEGORY_DOCS)} || body END AS text
  FROM b JOIN cats USING (lang) LEFT JOIN k USING (lang))
SELECT 'categories/分类-' || lang || CASE WHEN part > 0 THEN '.part' || part ELSE '' END || '.md' AS rel_path, md5(text) AS h, length(text) AS n FROM p""")
def _(t):
    frags = ct.doc_category_fragments(*_base(t), DAY, PER_PART)
    return assemble_fragments(frags).select("rel_path", F.md5("text").alias("h"), F.length("text").cast("bigint").alias("n"))


_SECTION = s.filled(ct.INDEX_CATEGORY, title="upper(lang)", overview="'about ' || lang", category_page="'分类-' || lang", n="n", top="best")
_INDEX_DOC = s.filled(ct.INDEX_DOC, file_name="'文档-' || doc_id", title="title")
_INDEX_HEAD = s.filled(ct.INDEX_HEAD, name="'知识库'", mode="'agent'", today=s.q(DAY), categories="(SELECT count(*) FROM cats)",
                       docs="(SELECT count(*) FROM docs)", concepts="(SELECT count(*) FROM cons)", raw_pages="(SELECT count(*) FROM pages)",
                       sites="(SELECT string_agg(DISTINCT source_site, ', ' ORDER BY source_site) FROM docs WHERE source_site <> '')")
_OVER_HEAD = s.filled(ct.OVERVIEW_HEAD, today=s.q(DAY), docs="(SELECT count(*) FROM docs)", concepts="(SELECT count(*) FROM cons)")


@query("ext11i_doc_index_and_overview", f"""WITH {BASE_SQL},
best AS (SELECT lang, string_agg({_INDEX_DOC}, '' ORDER BY i) AS best FROM d WHERE i <= 5 GROUP BY 1),
w AS (SELECT 'index.md' AS rel_path, {_INDEX_HEAD} || (SELECT string_agg({_SECTION}, '' ORDER BY ord) FROM cats JOIN best USING (lang))
  || {s.q(ct.INDEX_CONCEPTS)} || (SELECT string_agg({s.filled(ct.INDEX_CONCEPT, file_name="'概念-' || site", title="site")}, '' ORDER BY ord) FROM cons) AS text
UNION ALL SELECT 'overview.md', {_OVER_HEAD} || (SELECT string_agg({s.filled(ct.OVERVIEW_CATEGORY, title="upper(lang)", n="n", category_page="'分类-' || lang")}, '' ORDER BY ord) FROM cats))
SELECT rel_path, md5(text) AS h, length(text) AS n FROM w""")
def _(t):
    docs, cats, concepts = _base(t)
    sections = cut_lineage(ct.doc_sections(docs, cats))
    stats = cut_lineage(ct.doc_stats(docs, sections, concepts, t.read("pages")))
    frags = ct.doc_index_fragments(sections, concepts, stats, DAY).unionByName(ct.doc_overview_fragments(sections, stats, DAY))
    return assemble_fragments(frags).select("rel_path", F.md5("text").alias("h"), F.length("text").cast("bigint").alias("n"))


_S_LINE = s.filled(ct.SESSION_LINE, slug="slug", value="value", today=s.q(DAY))
_TAG_HEAD = s.filled(ct.TAGS_HEAD, today=s.q(DAY), n="(SELECT count(*) FROM p)", **{v: f"(SELECT count(*) FROM p WHERE value = '{v}')" for v in ("high", "medium", "low")})


@query("ext11j_session_catalogue_and_overview", f"""WITH {SUMMARY_SQL},
p AS (SELECT CAST(session_id AS VARCHAR) AS slug, value, CASE WHEN len(tags) > 0 THEN tags ELSE ['客服'] END AS tags, row_number() OVER (ORDER BY CAST(session_id AS VARCHAR) || '.md') AS i FROM summ),
g AS (SELECT tag, count(*) AS n, min(i * 1000 + pos) AS o FROM (SELECT i, unnest(tags) AS tag, generate_subscripts(tags, 1) AS pos FROM p) GROUP BY 1 ORDER BY n DESC, o LIMIT 12),
w AS (SELECT 'index.md' AS rel_path, {s.filled(ct.SESSION_HEAD, name="'知识库目录'", today=s.q(DAY))} || (SELECT string_agg({_S_LINE}, chr(10) ORDER BY i) FROM p WHERE i <= 500)
  || (SELECT CASE WHEN count(*) > 500 THEN {s.filled(ct.SESSION_REST, rest="count(*) - 500")} ELSE '' END FROM p)
  || {s.filled(ct.SESSION_TAIL, n="(SELECT count(*) FROM p)", sources="(SELECT count(*) FROM p)")} AS text
UNION ALL SELECT 'overview.md', {_TAG_HEAD} || (SELECT string_agg({s.filled(ct.TAGS_LINE, tag="tag", n="n")}, '' ORDER BY n DESC, o) FROM g) || {s.filled(ct.TAGS_TAIL, search="'query: <问题>'")})
SELECT rel_path, md5(text) AS h, length(text) AS n FROM w""")
def _(t):
    # pages are rendered and parsed back
    both = cut_lineage(summaries(t))
    stem = F.regexp_extract("rel_path", "([^/]*)\\.md\\z", 1)
    sessions = cut_lineage(ct.parse_session_pages(rd.render_session_pages(both, DAY).withColumn("stem", stem)))
    sources = rd.render_source_pages(both, DAY)
    frags = ct.session_catalogue_fragments(sessions, sources, DAY).unionByName(ct.session_overview_fragments(sessions, DAY))
    return assemble_fragments(frags).select("rel_path", F.md5("text").alias("h"), F.length("text").cast("bigint").alias("n"))
