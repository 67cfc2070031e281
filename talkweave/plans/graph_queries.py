"""Page graph and retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkweave.functions import scoring as sc
from talkweave.functions import text as tx
from talkweave.operators import graph as gr
from talkweave.operators import retrieval as rt
from talkweave.plans import sqltext as s
from talkweave.plans.registry import query
from talkweave.plans.text_queries import LATIN_STOP, MDLINKS_SQL, WIKILINKS_SQL, WIKI_WITH
from talkweave.sources.adapters import LINKS_SQL

W = f"WITH {LINKS_SQL} "
SEEDS_SQL = "seeds AS (SELECT stem FROM nodes WHERE page_type = 'category')"


@query("jon6_broken_links", W + "SELECT src, dst, pos FROM edges WHERE dst NOT IN (SELECT stem FROM nodes)")
def _(t):
    return gr.broken_links(t.link_edges(), t.page_nodes()).select("src", "dst", "pos")


@query("jon7_index_diff", W + """, i AS (SELECT DISTINCT dst FROM edges)
SELECT 'missing_on_disk' AS finding, dst AS stem FROM i WHERE dst NOT IN (SELECT stem FROM nodes)
UNION ALL SELECT 'missing_in_index_' || page_type, stem FROM nodes WHERE page_type IN ('category', 'concept') AND stem NOT IN (SELECT dst FROM i)""")
def _(t):
    return gr.index_diff(t.page_nodes(), t.link_edges())


def _graph(t):
    return t.link_edges().select("src", "dst", ((F.col("src") * 7 + F.col("pos")) % 10 / 10.0).alias("confidence"))


@query("jon9_expand_neighbors", W + f""", g AS (SELECT src, dst, (src * 7 + pos) % 10 / 10.0 AS confidence FROM edges), {SEEDS_SQL},
n AS (SELECT dst AS stem FROM g WHERE confidence >= 0.7 AND src IN (FROM seeds) UNION SELECT src FROM g WHERE confidence >= 0.7 AND dst IN (FROM seeds) AND src NOT IN (FROM seeds))
SELECT stem FROM seeds UNION SELECT stem FROM n WHERE stem IN (SELECT stem FROM nodes)""")
def _(t):
    seeds = t.page_nodes().filter("page_type = 'category'")
    return gr.expand_neighbors(seeds, _graph(t), t.page_nodes())


@query("jon10_link_closure", f"""WITH RECURSIVE {LINKS_SQL}, seeds AS (SELECT stem FROM nodes WHERE stem NOT IN (SELECT dst FROM edges)),
r AS (SELECT stem, 0 AS depth FROM seeds UNION SELECT e.dst, r.depth + 1 FROM r JOIN edges e ON e.src = r.stem JOIN nodes n ON n.stem = e.dst WHERE r.depth < 2)
SELECT stem, page_type, min(depth) AS depth FROM r JOIN nodes USING (stem) GROUP BY 1, 2""")
def _(t):
    nodes, edges = t.page_nodes(), t.link_edges()
    return gr.link_closure(gr.orphans(nodes, edges), edges, nodes, 2)


CRAWL_URL = "concat('http://site', {x} % 3, '.example.com/', CASE WHEN {x} % 11 = 0 THEN 'login/' ELSE 'p/' END, {x})"


@query("jon11_crawl_frontier", f"""WITH RECURSIVE {LINKS_SQL}, starts AS (SELECT {CRAWL_URL.format(x='stem')} AS start FROM (SELECT stem FROM nodes WHERE stem NOT IN (SELECT dst FROM edges))),
u AS (SELECT {CRAWL_URL.format(x='stem')} AS url FROM nodes),
a AS (SELECT {CRAWL_URL.format(x='src')} AS src, {CRAWL_URL.format(x='dst')} AS dst FROM edges),
r AS (SELECT start, start AS url, 0 AS depth FROM starts WHERE NOT contains(start, '/login') UNION SELECT r.start, a.dst, r.depth + 1 FROM r JOIN a ON a.src = r.url
  WHERE r.depth < 2 AND NOT contains(a.dst, '/login') AND split_part(a.dst, '/', 3) = split_part(r.start, '/', 3) AND a.dst IN (FROM u))
SELECT start, url, min(depth) AS depth FROM r GROUP BY 1, 2""")
def _(t):
    def at(c):
        return F.expr(CRAWL_URL.format(x=c))

    edges, nodes = t.link_edges(), t.page_nodes()
    anchors = edges.select(at("src").alias("src"), at("dst").alias("dst"))
    return gr.crawl_frontier(nodes.select(at("stem").alias("url")), anchors, gr.orphans(nodes, edges).select(at("stem").alias("start")), 2)


@query("jon11b_page_anchors", """WITH a AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<a[ \\n\\t]+[^>]*?href="([^"]*)"', 1)) AS href FROM pages)
SELECT DISTINCT url AS src, regexp_extract(url, '^[^/]*//[^/]*') || href AS dst FROM a""")
def _(t):
    return gr.page_anchors(t.read("pages"))


@query("agg7_incoming_links", W + "SELECT stem, page_type, count(dst) AS n FROM nodes LEFT JOIN edges ON stem = dst GROUP BY 1, 2")
def _(t):
    return gr.incoming_links(t.page_nodes(), t.link_edges())


@query("lnt1_orphans", W + "SELECT stem, page_type FROM nodes WHERE stem NOT IN (SELECT dst FROM edges)")
def _(t):
    return gr.orphans(t.page_nodes(), t.link_edges())


WIKI_EDGES = WIKI_WITH + f""", we AS (SELECT stem AS src, 'wikilink' AS kind, unnest({WIKILINKS_SQL}) AS dst FROM wiki UNION ALL SELECT stem, 'md', unnest({MDLINKS_SQL}) FROM wiki)"""


@query("agg8_kb_check", WIKI_EDGES + """SELECT 'total_md' AS metric, count(*) AS n FROM wiki UNION ALL SELECT 'pages_' || page_type, count(*) FROM wiki GROUP BY page_type
UNION ALL SELECT 'broken_links', count(*) FROM we WHERE kind = 'wikilink' AND dst NOT IN (SELECT stem FROM wiki)
UNION ALL SELECT 'orphan_pages_wikilink_only', count(*) FROM wiki WHERE stem NOT IN (SELECT dst FROM we WHERE kind = 'wikilink')
UNION ALL SELECT 'orphan_pages_including_md_links', count(*) FROM wiki WHERE stem NOT IN (SELECT dst FROM we)""")
def _(t):
    pages = t.wiki_pages()
    return gr.kb_check(pages, gr.page_edges(pages))


@query("agg8b_kb_check_samples", WIKI_EDGES + """, f AS (SELECT DISTINCT 'broken' AS sample, src AS stem, dst AS target FROM we WHERE kind = 'wikilink' AND dst NOT IN (SELECT stem FROM wiki)
UNION ALL SELECT 'orphans_wiki', stem, NULL FROM wiki WHERE stem NOT IN (SELECT dst FROM we WHERE kind = 'wikilink')
UNION ALL SELECT 'orphans_full', stem, NULL FROM wiki WHERE stem NOT IN (SELECT dst FROM we))
SELECT sample, row_number() OVER (PARTITION BY sample ORDER BY stem, target) AS n, stem, target FROM f QUALIFY n <= 15""")
def _(t):
    pages = t.wiki_pages()
    return gr.kb_check_samples(pages, gr.page_edges(pages))


@query("agg8c_draft_counts", WIKI_WITH + "SELECT page_type, count(*) AS drafts FROM wiki WHERE ord % 3 = 1 GROUP BY 1")
def _(t):
    state = F.when(F.col("ord") % 3 == 1, "draft").otherwise("done")
    return gr.draft_counts(t.wiki_pages().withColumn("text", F.concat(F.lit("---\nstatus: "), state, F.lit("\n---\n"), "text")))


@query("lnt2_missing_heading", WIKI_WITH + "SELECT stem FROM wiki WHERE page_type = 'category' AND NOT contains(text, '## 主题内问答总结')")
def _(t):
    return gr.missing_heading(t.wiki_pages())


@query("jon12_concept_backlinks", WIKI_EDGES + """SELECT stem FROM wiki WHERE page_type = 'concept' AND stem NOT IN (SELECT src FROM we WHERE dst IN (SELECT stem FROM wiki WHERE page_type = 'faq'))""")
def _(t):
    pages = t.wiki_pages()
    return gr.concept_backlinks(pages, gr.page_edges(pages))


@query("agg9_duplicate_key_groups", f"""WITH d AS (SELECT doc_id, '问答-' || regexp_extract(text, '^[^' || chr(10) || ']*') || CASE WHEN doc_id % 2 = 0 THEN '' ELSE '-' || substr(md5(text), 1, 6) END || '' AS st FROM documents),
k AS (SELECT {s.link_key("replace(" + s.sub(s.sub(s.strip('st'), chr(92)+'.md'+chr(92)+'z'), '-[0-9a-f]{6,8}'+chr(92)+'z') + ", '问答-', '')")} AS key, st FROM d)
SELECT key, count(*) AS n, array_to_string(list(st ORDER BY st)[1:20], '|') AS stems FROM k WHERE key <> '' GROUP BY 1 HAVING count(*) > 1""")
def _(t):
    stem = F.concat(F.lit("问答-"), tx.first_line(F.col("text")),
                    F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.concat(F.lit("-"), F.substring(F.md5("text"), 1, 6))))
    return gr.duplicate_key_groups(t.read("documents").select(stem.alias("stem")), tx.norm_faq_key(F.col("stem"))).withColumn("stems", F.array_join("stems", "|"))


@query("agg10_same_key_links", W + """, k AS (SELECT DISTINCT src, CAST(dst % 5 AS VARCHAR) AS key, dst FROM edges)
SELECT src, key, count(*) AS n, array_to_string(list(dst ORDER BY dst)[1:20], '|') AS stems FROM k GROUP BY 1, 2 HAVING count(*) > 1""")
def _(t):
    out = gr.same_key_links(t.link_edges(), key=(F.col("dst") % 5).cast("string"))
    return out.withColumn("stems", F.array_join(F.col("stems").cast("array<string>"), "|"))


@query("agg17_lint_report")
def _(t):
    pages = t.wiki_pages()
    edges = gr.page_edges(pages)
    index = pages.filter("page_type = 'category'").select(F.col("stem").alias("dst"))
    return gr.lint_report(pages, edges, index)


def _alias_sql(x: str) -> str:
    return s.sub(s.sub(s.sub(s.strip(x), "\\.md\\z"), "[ \\x{3000}]"), "[-_]{2,}", "-")


def _soft_sql(x: str) -> str:
    return s.sub(_alias_sql(x), f"[^{tx.WORD}\\-（）()]+")


#: resolved(target, raw, resolved) for every link target of the pages
RESOLVED_SQL = WIKI_WITH + f""", lt AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\\[\\[([^\\]|]+)(\\|[^\\]]+)?\\]\\]', 1)) AS target FROM wiki),
lk AS (SELECT target, {s.sub(s.strip("target"), chr(92) + ".md" + chr(92) + "z")} AS raw FROM lt), lm AS (SELECT *, {_alias_sql("raw")} AS nkey, {_soft_sql("raw")} AS skey FROM lk),
nm AS (SELECT DISTINCT stem, {_alias_sql("stem")} AS nkey, {_soft_sql("stem")} AS skey FROM wiki),
hit AS (SELECT target, raw, nkey, coalesce((SELECT max(stem) FROM nm WHERE nm.stem = lm.raw), (SELECT max(stem) FROM nm WHERE nm.nkey = lm.nkey), (SELECT max(stem) FROM nm WHERE nm.skey = lm.skey)) AS found FROM lm),
pre AS (SELECT target, min(stem) AS found FROM hit JOIN nm ON starts_with(nm.nkey, hit.nkey) WHERE hit.found IS NULL AND {s.hit("raw", "^(问答|文档|概念|分类)-")} GROUP BY 1 HAVING count(*) = 1),
resolved AS (SELECT target, raw, coalesce(hit.found, pre.found) AS resolved FROM hit LEFT JOIN pre USING (target))"""


@query("jon4_resolve_wikilinks", RESOLVED_SQL + " SELECT target, resolved FROM resolved")
def _(t):
    pages = t.wiki_pages()
    links = pages.select(F.explode(F.regexp_extract_all("text", F.lit("\\[\\[([^\\]|]+)(\\|[^\\]]+)?\\]\\]"), F.lit(1))).alias("target"))
    return gr.resolve_wikilinks(links, pages)


@query("jon5_resolve_page", WIKI_WITH + """, l AS (SELECT DISTINCT page_type, regexp_extract(stem, '^[^-]*-.{1,2}') || '（x' AS link FROM wiki)
SELECT l.page_type, link, min(stem) AS stem FROM l JOIN wiki ON wiki.page_type = l.page_type AND starts_with(stem, split_part(link, '（', 1)) GROUP BY 1, 2""")
def _(t):
    pages = t.wiki_pages()
    links = pages.select("page_type", F.concat(F.regexp_extract("stem", "^[^-]*-.{1,2}", 0), F.lit("（x")).alias("link"))
    return gr.resolve_page(links, pages)


# --- retrieval ---------------------------------------------------------------------------------------

KW_SQL = f"kw AS (SELECT item_id AS question_id, text AS question, {s.keywords('text', LATIN_STOP)} AS keywords FROM benchmark)"
DOCS = "d AS (SELECT doc_id AS stem, lower(lang || ' ' || source) AS title, lower(text) AS text FROM documents)"
SCORE_SQL = f"""{KW_SQL}, {DOCS}, sc AS (SELECT question_id, stem, len(keywords) AS nk,
 CAST(len(list_filter(keywords, lambda k: contains(title, k))) AS DOUBLE) AS title_score, CAST(len(list_filter(keywords, lambda k: contains(d.text, k))) AS DOUBLE) AS content_score FROM kw, d)"""


def _kw(t):
    return rt.question_keywords(t.questions(), LATIN_STOP)


def _scores(t):
    return rt.keyword_matches(_kw(t), t.read("documents"), F.concat_ws(" ", "lang", "source"), F.col("text"), "doc_id").withColumnRenamed("doc_id", "stem")


@query("txt26_title_matches_question", """WITH w AS (SELECT DISTINCT page_id, unnest(string_split_regex(lower(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)), '[ ]+')) AS w FROM pages)
SELECT DISTINCT item_id AS question_id, page_id FROM benchmark, w WHERE length(w) > 2 AND contains(lower(text), w)""")
def _(t):
    return rt.title_matches(t.questions(), t.page_titles())


@query("txt27_keyword_score", f"WITH {SCORE_SQL} SELECT question_id, stem, title_score, content_score FROM sc WHERE title_score + content_score > 0")
def _(t):
    return _scores(t).select("question_id", "stem", "title_score", "content_score")


_TYPE = "CASE stem % 3 WHEN 0 THEN 'category' WHEN 1 THEN 'concept' ELSE 'faq' END"
_CONF = """greatest(0.0::DOUBLE, least(1.0::DOUBLE, (title_score * 2.5::DOUBLE + content_score) / (nk * 3.5::DOUBLE) + 0.10::DOUBLE
 + CASE stem % 3 WHEN 0 THEN 0.20::DOUBLE WHEN 1 THEN 0.18::DOUBLE ELSE 0.05::DOUBLE END + 0.05::DOUBLE))"""


def _confident(t):
    typed = _scores(t).join(_kw(t).select("question_id", "n_keywords"), "question_id").withColumn("hit_type", F.expr(_TYPE))
    return typed.select("question_id", "stem", "hit_type", F.lit("global_scan").alias("route"), sc.hit_confidence(
        F.col("n_keywords"), F.col("title_score"), F.col("content_score"), F.lit("global_scan"), F.col("hit_type"), 0.05).alias("score"))


@query("txt28_hit_confidence", f"WITH {SCORE_SQL} SELECT question_id, stem, {_TYPE} AS hit_type, {_CONF} AS score FROM sc WHERE title_score + content_score > 0")
def _(t):
    return _confident(t).drop("route")


@query("top7_bucket_hits", f"""WITH {SCORE_SQL}, h AS (SELECT question_id, stem, {_TYPE} AS hit_type, {_CONF} AS score FROM sc WHERE title_score + content_score > 0),
o AS (SELECT *, CASE hit_type WHEN 'category' THEN 0 WHEN 'concept' THEN 1 ELSE 2 END AS tr FROM h),
g AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, tr, stem) AS page_rank FROM o),
b AS (SELECT *, row_number() OVER (PARTITION BY question_id, hit_type ORDER BY page_rank) AS rank FROM g WHERE page_rank <= 10)
SELECT question_id, stem, hit_type, score, page_rank::INT AS page_rank, rank::INT AS rank FROM b WHERE rank <= CASE hit_type WHEN 'faq' THEN 5 ELSE 2 END""")
def _(t):
    return rt.bucket_hits(_confident(t), settled=True).select("question_id", "stem", "hit_type", "score", "page_rank", "rank")


CATS_SQL = "cats AS (SELECT doc_id AS category_id, doc_id AS ord, lower(source || ' ' || text) AS blob FROM documents)"


def _cats(t):
    return t.read("documents").select(F.col("doc_id").alias("category_id"), F.col("doc_id").alias("ord"), F.concat_ws(" ", "source", "text").alias("blob"))


@query("top4_rank_categories", f"""WITH {KW_SQL}, {CATS_SQL}, r AS (SELECT question_id, category_id, ord, CAST(len(list_filter(keywords, lambda k: contains(blob, k))) AS DOUBLE) AS score FROM kw, cats),
x AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, ord) AS rank FROM r) SELECT question_id, category_id, score, rank::INT AS rank FROM x WHERE rank <= 2""")
def _(t):
    return rt.rank_categories(_kw(t), _cats(t), 2, include_question=False).select("question_id", "category_id", "score", "rank")


FAQS_SQL = "f AS (SELECT stem, lower(stem) AS title, lower(text) AS text FROM wiki WHERE page_type = 'faq')"


@query("top5_rank_faqs", WIKI_WITH + f""", {KW_SQL}, {FAQS_SQL}, pref AS (SELECT question_id, '问答-' || (question_id * 10 + 2) AS stem FROM kw),
a AS (SELECT question_id, f.stem, CAST(len(list_filter(keywords, lambda k: contains(f.text, k))) AS DOUBLE) AS cs, CAST(len(list_filter(keywords, lambda k: contains(f.title, k))) AS DOUBLE) AS ts,
  CAST(len(list_filter(keywords, lambda k: contains(replace(f.title, '问答-', '') || ' ' || f.text, k))) AS DOUBLE) AS ps FROM kw, f),
p AS (SELECT pref.question_id, pref.stem, coalesce(ps, 0.0::DOUBLE) + 2.0::DOUBLE AS score FROM pref LEFT JOIN a USING (question_id, stem)),
n AS (SELECT question_id, stem, ts AS score FROM a ANTI JOIN pref USING (question_id, stem) WHERE ts > 0), st AS (FROM p UNION ALL FROM n),
have AS (SELECT question_id, count(*) AS have FROM st GROUP BY 1),
c AS (SELECT question_id, stem, cs * 0.8::DOUBLE AS score, have, row_number() OVER (PARTITION BY question_id ORDER BY stem) AS i FROM a ANTI JOIN st USING (question_id, stem) JOIN have USING (question_id) WHERE cs > 0 AND have < 5),
al AS (FROM st UNION ALL SELECT question_id, stem, score FROM c WHERE i <= 20 - have), r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, stem) AS rank FROM al)
SELECT question_id, stem, score, rank::INT AS rank FROM r WHERE rank <= 5""")
def _(t):
    kw = _kw(t)
    preferred = kw.select("question_id", F.concat(F.lit("问答-"), F.col("question_id") * 10 + 2).alias("stem"))
    faqs = t.wiki_pages().filter("page_type = 'faq'")
    return rt.rank_faqs(kw, faqs, preferred, 5, include_question=False, text_chars=None, preferred_chars=None).select("question_id", "stem", "score", "rank")


@query("top6_rank_concepts", WIKI_WITH + f""", {KW_SQL}, r AS (SELECT question_id, stem, CAST(len(list_filter(keywords, lambda k: contains(lower(stem || ' ' || wiki.text), k))) AS DOUBLE) AS score FROM kw, wiki WHERE page_type = 'concept'),
x AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, stem) AS rank FROM r WHERE score > 0) SELECT question_id, stem, score, rank::INT AS rank FROM x WHERE rank <= 2""")
def _(t):
    concepts = t.wiki_pages().filter("page_type = 'concept'")
    return rt.rank_concepts(_kw(t), concepts, 2, text_chars=None).select("question_id", "stem", "score", "rank")


INDEX_SECTIONS = ("concat('### ', source, ' ', lang, '\n\n涵盖 ', lang, '。\n\n- 主题页：[[分类-', doc_id, ']]\n- 高频问题：\n  - ', "
                  "regexp_extract(text, '^[^ \n]*', 0), '\n  - 概念 [[概念-', doc_id + 1, ']]\n')")


def index_page(t):
    """Index with one section per category page; one row per section keeps rows small."""
    categories = t.wiki_pages().filter("page_type = 'category'").select(F.col("ord").alias("doc_id"))
    return t.read("documents").join(categories, "doc_id").select(F.expr(INDEX_SECTIONS).alias("text"))


@query("ext9_parse_index_sections", WIKI_WITH + """SELECT source || ' ' || lang AS title, '涵盖 ' || lang || '。' AS overview, '分类-' || doc_id AS category_link,
 concat(trim(regexp_extract(documents.text, '^[^ \n]*')), '|', '概念 [[概念-', doc_id + 1, ']]') AS questions FROM documents JOIN wiki w ON doc_id = ord WHERE page_type = 'category' AND regexp_extract(documents.text, '^[^ \n]*') <> ''""")
def _(t):
    src = index_page(t).filter(~F.contains("text", F.lit("- 高频问题：\n  - \n")))
    return rt.parse_index_sections(src).select("title", "overview", "category_link", F.array_join("questions", "|").alias("questions"))


INDEX_SQL = """sec AS (SELECT doc_id, lower(unnest([source || ' ' || lang, '主题页：[[分类-' || doc_id || ']]', '高频问题：', regexp_extract(documents.text, '^[^ ' || chr(10) || ']*'), '概念 [[概念-' || (doc_id + 1) || ']]'])) AS line FROM documents JOIN wiki ON doc_id = ord WHERE page_type = 'category'),
m AS (SELECT DISTINCT question_id, doc_id FROM (SELECT question_id, unnest(keywords) AS k FROM kw), sec WHERE contains(line, k)),
il AS (SELECT question_id, unnest(['分类-' || doc_id, '概念-' || (doc_id + 1)]) AS stem FROM m)"""


@query("jon8_index_route", WIKI_WITH + f""", {KW_SQL}, {INDEX_SQL} SELECT DISTINCT question_id, stem FROM il WHERE stem IN (SELECT stem FROM wiki)""")
def _(t):
    return rt.index_route(_kw(t), index_page(t), t.wiki_pages())


def retrieved(t):
    pages = t.wiki_pages()
    return rt.retrieve(t.questions(), pages, gr.typed_edges(pages), index_page(t), stop_words=LATIN_STOP)


TYPED_EDGES = """tl AS (SELECT stem AS src, unnest(regexp_extract_all(text, '\\[\\[((?:分类|问答|概念)-[^\\]]+)\\]\\]', 1)) AS raw FROM wiki),
tn AS (SELECT DISTINCT src, trim(split_part(raw, '（', 1)) AS link, CASE substr(raw, 1, 2) WHEN '分类' THEN 'category' WHEN '概念' THEN 'concept' ELSE 'faq' END AS kind FROM tl),
te AS (SELECT DISTINCT src, coalesce((SELECT min(w.stem) FROM wiki w WHERE w.page_type = kind AND w.stem = link), (SELECT min(w.stem) FROM wiki w WHERE w.page_type = kind AND starts_with(w.stem, link))) AS dst FROM tn),
we2 AS (SELECT src, dst FROM te WHERE dst IS NOT NULL)"""


def _score_sql(bonus: str, boost: str) -> str:
    """The confidence of a page for a question; ``w`` is the page, ``kw`` the question."""
    return f"""CASE WHEN len(keywords) = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE,
  (len(list_filter(keywords, lambda k: contains(w.title, k))) * 2.5::DOUBLE + len(list_filter(keywords, lambda k: contains(w.low, k)))) / (len(keywords) * 3.5::DOUBLE)
  + {bonus} + CASE w.page_type WHEN 'category' THEN 0.20::DOUBLE WHEN 'concept' THEN 0.18::DOUBLE ELSE 0.05::DOUBLE END + {boost})) END"""


_LINKED = _score_sql("0.15::DOUBLE", "CASE w.page_type WHEN 'faq' THEN 0.10::DOUBLE ELSE 0.05::DOUBLE END")
_RANKED = """best AS (SELECT question_id, stem, hit_type, max(score) AS score FROM h GROUP BY 1, 2, 3),
g AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, CASE hit_type WHEN 'category' THEN 0 WHEN 'concept' THEN 1 ELSE 2 END, stem) AS page_rank FROM best),
b AS (SELECT *, row_number() OVER (PARTITION BY question_id, hit_type ORDER BY page_rank) AS rank FROM g WHERE page_rank <= 10)"""
_SCAN = """seeds AS (SELECT stem FROM wiki WHERE page_type IN ('category', 'concept')),
c1 AS (SELECT DISTINCT dst AS stem FROM we2 JOIN seeds ON src = stem), c2 AS (SELECT DISTINCT dst AS stem FROM we2 JOIN c1 ON src = stem), cl AS (FROM seeds UNION FROM c1 UNION FROM c2),
w AS (SELECT stem, page_type, lower(regexp_replace(stem, '^(问答|概念|分类)-', '')) AS title, lower(text) AS low FROM wiki)"""
RETR_SQL = WIKI_WITH + f""", {KW_SQL}, {TYPED_EDGES}, {_SCAN},
h AS (SELECT question_id, stem, page_type AS hit_type, {_LINKED} AS score FROM kw, w WHERE stem IN (FROM cl)), {_RANKED}
SELECT question_id, stem, hit_type, score, rank::INT AS rank FROM b WHERE rank <= CASE hit_type WHEN 'faq' THEN 5 ELSE 2 END"""


@query("ext12_retrieve_global_scan", RETR_SQL)
def _(t):
    pages = t.wiki_pages()
    # an index without any matching section sends every question down the scan route
    none = index_page(t).select(F.lit("### \u0001\n- \u0001\n").alias("text"))
    return rt.retrieve(t.questions(), pages, gr.typed_edges(pages), none, stop_words=LATIN_STOP).select("question_id", "stem", "hit_type", "score", "rank")


# The index route: questions with a matching section follow their own links, all others scan.
FULL_SQL = WIKI_WITH + f""", {KW_SQL}, {TYPED_EDGES}, {_SCAN}, {INDEX_SQL},
q0 AS (SELECT DISTINCT question_id, stem FROM il WHERE stem IN (SELECT stem FROM wiki)),
q1 AS (SELECT DISTINCT question_id, dst AS stem FROM q0 JOIN we2 ON src = stem), q2 AS (SELECT DISTINCT question_id, dst AS stem FROM q1 JOIN we2 ON src = stem), own AS (FROM q0 UNION FROM q1 UNION FROM q2),
h AS (SELECT question_id, stem, page_type AS hit_type, {_score_sql("0.25::DOUBLE", "0.0::DOUBLE")} AS score FROM q0 JOIN w USING (stem) JOIN kw USING (question_id)
UNION ALL SELECT question_id, stem, page_type, {_LINKED} FROM own JOIN w USING (stem) JOIN kw USING (question_id) WHERE page_type IN ('category', 'concept', 'faq')
UNION ALL SELECT question_id, stem, page_type, {_LINKED} FROM kw, w WHERE stem IN (FROM cl) AND question_id NOT IN (SELECT question_id FROM q0)), {_RANKED}
SELECT question_id, stem, hit_type, score, rank::INT AS rank, CASE WHEN question_id IN (SELECT question_id FROM q0) THEN 'index_match' ELSE 'global_scan' END AS note
FROM b WHERE rank <= CASE hit_type WHEN 'faq' THEN 5 ELSE 2 END"""


@query("ext12b_retrieve", FULL_SQL)
def _(t):
    return retrieved(t).select("question_id", "stem", "hit_type", "score", "rank", "note")


@query("ext13_prompt_context")
def _(t):
    return rt.prompt_context(t.questions(), rt.excerpts(retrieved(t), t.wiki_pages()), stop_words=LATIN_STOP)


@query("udf1_fallback_selector", WIKI_WITH + """SELECT item_id AS question_id, rel_path, 0 AS ord FROM benchmark JOIN wiki ON wiki.ord = item_id""")
def _(t):
    pages = t.wiki_pages()
    # a selector that answers with its own page and one that does not exist
    named = t.questions().join(pages.select(F.col("ord").alias("question_id"), "rel_path"), "question_id")
    answers = named.select("question_id", F.concat(F.lit("```json\n[\"/"), "rel_path", F.lit("\", \"faqs/none.md\"]\n```")).alias("answer"))
    return rt.parse_selection(answers, pages).select("question_id", "rel_path", "ord")


@query("agg19_retrieval_audit", """SELECT source AS turn, TRUE AS tool_called, array_to_string(list_distinct_sorted, '|') AS wiki_sources, 'index_match' AS retrieval_notes FROM (
 SELECT source, list(lang ORDER BY o) AS list_distinct_sorted FROM (SELECT source, lang, min(doc_id) AS o FROM documents GROUP BY 1, 2) GROUP BY 1)""")
def _(t):
    hits = t.read("documents").select(F.col("source").alias("turn"), F.col("doc_id").alias("call"), F.lit(0).alias("ord"), F.col("lang").alias("rel_path"), F.lit("index_match").alias("note"))
    return rt.retrieval_audit(hits, ["turn"]).withColumn("wiki_sources", F.array_join("wiki_sources", "|")).withColumn("retrieval_notes", F.array_join("retrieval_notes", "|"))


