"""Question-and-answer and document queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkweave.functions import text as tx
from talkweave.functions import urls as ux
from talkweave.functions.html import html_to_text
from talkweave.operators import docs as dc
from talkweave.operators import faq as fq
from talkweave.operators import rulematch as rm
from talkweave.operators.ordering import id_bucket
from talkweave.plans import sqltext as s
from talkweave.plans.message_queries import CLEAN_SQL, LATIN, SUBST_SQL, cleaned
from talkweave.plans.registry import query
from talkweave.plans.text_queries import EXT8_URL, PAGE_TITLE_SQL, _url_category_sql, label_sql, path_label_sql
from talkweave.session import cut_lineage
from talkweave.sources.adapters import DOCS_SQL, FAQ_SQL

CATS = [
    ("german", "Deutsch", [r"[ .,]der[ .,]", r"[ .,]und[ .,]", r"ung[ .,]"]),
    ("french", "Français", [r"eau", r"tion[ .,]", r"é"]),
    ("spanish", "Español", [r"ción", r"[ .,]para[ .,]"]),
    ("english", "English", [r"[ .,]the[ .,]", r"[ .,]of[ .,]", r"ing[ .,]"]),
    ("general", "General", []),
]
CAT_RULES = [(c, p) for c, _, p in CATS if p]
CONCEPT_RULES = [("con-a", [r"[ .,]with[ .,]"]), ("con-b", [r"[ .,]les[ .,]", r"[ .,]des[ .,]"]), ("con-c", [r"ción"])]
KEYWORDS = [("k-the", ["the "]), ("k-eau", ["eau", "euxm"]), ("k-cion", ["ción"]), ("k-sch", ["sch"])]
FAQ_RULES = LATIN.__class__(**{**LATIN.__dict__, "categories": CATS})


def hits_sql(x: str, patterns: list[str]) -> str:
    return "(" + " + ".join(f"({s.hit(f'lower({x})', s.any_of([p]))})::INT" for p in patterns) + ")"


def best_sql(x: str, dictionary) -> str:
    scores = ", ".join(f"{{'n': {hits_sql(x, p)}, 'o': {-i}, 'id': {s.q(c)}}}" for i, (c, p) in enumerate(dictionary))
    return f"coalesce(list_sort(list_filter([{scores}], lambda z: z.n > 0), 'DESC')[1].id, 'general')"


@query("jon3_match_rules", "WITH r AS (" + " UNION ALL ".join(
    f"SELECT doc_id, {i}::INT AS rule_ord, {s.q(c)} AS rule_id, {hits_sql('text', p)} AS n_hits FROM documents" for i, (c, p) in enumerate(CAT_RULES))
    + ") SELECT * FROM r WHERE n_hits > 0")
def _(t):
    return rm.match_rules(t.read("documents").select("doc_id", "text"), F.col("text"), CAT_RULES).drop("text")


@query("top8_best_category", f"SELECT doc_id, {best_sql('text', CAT_RULES)} AS category_id FROM documents")
def _(t):
    return t.read("documents").select("doc_id", rm.best_category(F.col("text"), CAT_RULES).alias("category_id"))


_STEP = s.hit("content", "([ .,]to[ .,]|[ .,]de[ .,])")
_RS = s.sub("ask", "[？?]+\\z")
FAQ_EXT_SQL = f"""{CLEAN_SQL}, sub AS (SELECT * FROM cleaned WHERE {SUBST_SQL}),
asks AS (SELECT session_id, list(content ORDER BY created_at, msg_id) AS l FROM sub WHERE role = '访客' GROUP BY 1),
ag AS (SELECT *, length(content) >= 300 AS strong FROM sub WHERE role = '客服'),
lst AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY msg_id DESC) AS rn, bool_or(strong) OVER (PARTITION BY session_id) AS has FROM ag),
pick AS (SELECT session_id, content, min(msg_id) AS o FROM lst WHERE strong OR (NOT has AND rn <= 2) GROUP BY 1, 2),
ans AS (SELECT session_id, string_agg(content, chr(10) || chr(10) ORDER BY o) AS answer FROM pick GROUP BY 1),
stp AS (SELECT session_id, list(content ORDER BY msg_id) AS st FROM sub WHERE role = '客服' AND {_STEP} GROUP BY 1),
ext AS (SELECT session_id, {_RS.replace('ask', 'l[1]')} || '？' AS question, l[2:4] AS variants, answer, length(answer) AS answer_chars,
  {best_sql("(l[1] || ' ' || answer)", CAT_RULES)} AS category_id, coalesce({s.distinct_in_order('st')}[1:10], CAST([] AS VARCHAR[])) AS steps
  FROM asks JOIN ans USING (session_id) LEFT JOIN stp USING (session_id) WHERE length(answer) >= 10)"""


def extracted(t):
    return fq.extract_faq(cleaned(t), FAQ_RULES)


@query("ext1_extract_faq", f"WITH {FAQ_EXT_SQL} SELECT session_id, question, array_to_string(variants, '|') AS variants, md5(answer) AS answer, answer_chars, category_id, md5(array_to_string(steps, '|')) AS steps FROM ext")
def _(t):
    return extracted(t).select("session_id", "question", F.array_join("question_variants", "|").alias("variants"), F.md5("answer").alias("answer"),
                               F.col("answer_chars").cast("bigint").alias("answer_chars"), "category_id", F.md5(F.array_join("steps", "|")).alias("steps"))


SECTION = """concat('### [网页] ', source, '\n\n来源: https://docs.example/', doc_id, '\n\n', text, '\n\n### [图片 OCR] https://img.example/', doc_id, '.png\n\n', lang, '\n')"""


@query("ext2_parse_link_blocks", f"""WITH d AS (SELECT doc_id, source, {s.strip('text')} AS x, list_filter(list_transform(string_split(text, chr(10)), lambda y: {s.strip('y')}), lambda y: y <> '' AND NOT starts_with(y, '#') AND NOT starts_with(y, '来源:')) AS l FROM documents),
e AS (SELECT *, array_to_string(l, chr(10)) AS body FROM d)
SELECT doc_id, 'https://docs.example/' || doc_id AS url, source AS title, md5(body) AS body, '网页' AS kind FROM e
WHERE length(body) >= 20 AND len(list_filter(l, lambda y: NOT starts_with(y, '>') AND {s.hit('y', '[A-Za-z]{4,}')})) > 0""")
def _(t):
    blocks = fq.parse_link_blocks(F.expr(SECTION))
    return t.read("documents").select("doc_id", F.explode(blocks).alias("b")).select(
        "doc_id", "b.url", "b.title", F.md5("b.body").alias("body"), "b.kind")


_BLOCK = f"""d AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda y: {s.strip('y')}), lambda y: y <> '' AND NOT starts_with(y, '#') AND NOT starts_with(y, '来源:')) AS l FROM documents),
e AS (SELECT doc_id, CASE WHEN length(array_to_string(l, chr(10))) >= 20 AND len(list_filter(l, lambda y: NOT starts_with(y, '>') AND {s.hit('y', '[A-Za-z]{4,}')})) > 0 THEN l ELSE CAST([] AS VARCHAR[]) END AS l FROM d)"""
_BLOCK_STEP = s.hit("y", r"(?i)([ .,]to[ .,]|[ .,]de[ .,]|[ .,]die[ .,])")
_TIDY = f"list_transform(list_filter(list_transform(f, lambda y: {s.one_space(s.strip('y'))}), lambda y: length(y) >= 6), lambda y: CASE WHEN length(y) > 160 THEN substr(y, 1, 157) || '…' ELSE y END)"


@query("ext3_steps_from_blocks", f"""WITH {_BLOCK}, x AS (SELECT doc_id, {s.distinct_in_order(f"list_filter(rl, lambda y: length(y) >= 6 AND {_BLOCK_STEP})")}[1:12] AS f FROM (SELECT doc_id, l AS rl FROM e)),
n AS (SELECT doc_id, {s.distinct_in_order(_TIDY)} AS g FROM x) SELECT doc_id, array_to_string(g[1:10], '|') AS steps FROM n""")
def _(t):
    blocks = fq.parse_link_blocks(F.expr(SECTION))
    steps = fq.steps_from_blocks(blocks, pattern=r"([ .,]to[ .,]|[ .,]de[ .,]|[ .,]die[ .,])")
    return t.read("documents").select("doc_id", F.array_join(fq.normalize_steps(steps), "|").alias("steps"))


@query("ext4_synthesize_answer", f"""WITH {_BLOCK}, x AS (SELECT doc_id, 'https://a.example/' || doc_id AS a, substr(list_filter(l, lambda y: length(y) BETWEEN 20 AND 200)[1], 1, 180) AS tip,
  list_filter(l, lambda y: length(y) BETWEEN 25 AND 160)[1:2] AS extra FROM e),
c AS (SELECT *, CASE WHEN tip IS NOT NULL THEN tip || chr(10) || chr(10) || '参考：' || a ELSE a END AS told FROM x)
SELECT doc_id, CASE WHEN length(told) < 80 AND len(extra) > 0 THEN {s.strip("told || chr(10) || chr(10) || array_to_string(extra, chr(10))")} ELSE told END AS answer FROM c""")
def _(t):
    return t.read("documents").select("doc_id", fq.synthesize_answer(
        F.concat(F.lit("https://a.example/"), "doc_id"), fq.parse_link_blocks(F.expr(SECTION))).alias("answer"))


def _summary_sql() -> str:
    first = s.strip("regexp_extract(answer, '^[^' || chr(10) || ']*')")
    return (f"concat('会话 ', substr(session_id::VARCHAR, 1, 8), '…：访客问「', substr({s.sub('question', '[？?]+' + chr(92) + 'z')}, 1, 50), '」；', "
            f"coalesce(nullif(substr({first}, 1, 100), ''), '客服已给出指引。'))")


_STEPN = s.distinct_in_order(
    f"list_transform(list_filter(list_transform(steps, lambda x: {s.one_space(s.strip('x'))}), lambda x: length(x) >= 6), lambda x: CASE WHEN length(x) > 160 THEN substr(x, 1, 157) || '…' ELSE x END)")


@query("ext5_enrich_extractions", f"""WITH {FAQ_EXT_SQL} SELECT session_id, question, CASE category_id {' '.join(f"WHEN {s.q(c)} THEN {s.q(n)}" for c, n, _ in CATS)} END AS category_title,
 md5(array_to_string({_STEPN}[1:10], '|')) AS steps, {_summary_sql()} AS summary FROM ext""")
def _(t):
    return fq.enrich_extractions(extracted(t), FAQ_RULES).select(
        "session_id", "question", "category_title", F.md5(F.array_join("steps", "|")).alias("steps"), "summary")


@query("jon13_related_wikilinks", f"""WITH {FAQ_EXT_SQL} SELECT session_id, array_to_string(list_filter([CASE category_id WHEN 'french' THEN '分类-fr' WHEN 'english' THEN '分类-en' END,
 {', '.join(f"CASE WHEN {hits_sql('(question || answer)', p)} > 0 THEN {s.q('概念-' + c)} END" for c, p in CONCEPT_RULES)}], lambda x: x IS NOT NULL), '|') AS links FROM ext""")
def _(t):
    links = fq.related_wikilinks(F.concat("question", "answer"), F.col("category_id"), {"french": "分类-fr", "english": "分类-en"},
                                 [("概念-" + c, p) for c, p in CONCEPT_RULES])
    return extracted(t).select("session_id", F.array_join(links, "|").alias("links"))


def merged_sql(key: str, source: str, extra: str = "") -> str:
    """Entries merged per key: longest answer wins, lists are unions in row order."""
    return f"""src AS (SELECT *, {key} AS gk FROM {source} {extra}),
best AS (SELECT gk, arg_max({{'question': question, 'category_id': category_id, 'answer': answer}}, {{'n': length(answer), 'o': -ord}}) AS b, CAST(sum(source_count) AS BIGINT) AS source_count, min(ord) AS ord FROM src GROUP BY 1),
vv AS (SELECT gk, v, min(ord * 100 + i) AS o FROM (SELECT gk, ord, unnest([question] || variants) AS v, generate_subscripts([question] || variants, 1) AS i FROM src) WHERE v <> '' GROUP BY 1, 2),
vl AS (SELECT gk, list(v ORDER BY o)[1:12] AS variants FROM vv JOIN best USING (gk) WHERE v <> b.question GROUP BY 1),
ss AS (SELECT gk, v, min(ord * 100 + i) AS o FROM (SELECT gk, ord, unnest(steps) AS v, generate_subscripts(steps, 1) AS i FROM src) WHERE v <> '' GROUP BY 1, 2),
sl AS (SELECT gk, list(v ORDER BY o)[1:10] AS steps FROM ss GROUP BY 1),
merged AS (SELECT gk, b.question AS question, b.category_id AS category_id, b.answer AS answer, source_count, ord,
  coalesce(variants, CAST([] AS VARCHAR[])) AS variants, coalesce(steps, CAST([] AS VARCHAR[])) AS steps FROM best LEFT JOIN vl USING (gk) LEFT JOIN sl USING (gk))"""


def _merged_out(df, key):
    return df.select(F.col(key).alias("gk"), "question", "category_id", F.md5("answer").alias("answer"), "source_count", "ord",
                     F.array_join("variants", "|").alias("variants"), F.array_join("steps", "|").alias("steps"))


_MOUT = "SELECT gk, question, category_id, md5(answer) AS answer, source_count, ord, array_to_string(variants, '|') AS variants, array_to_string(steps, '|') AS steps FROM merged"


@query("mrg3_merge_link_blocks", """WITH d AS (SELECT doc_id AS ord, lang, source AS url, source AS title, text AS body FROM documents)
SELECT lang, url, min(ord) AS first_ord, md5(arg_max(body, {'n': length(body), 'o': -ord})) AS body FROM d GROUP BY 1, 2""")
def _(t):
    rows = t.read("documents").select(F.col("doc_id").alias("ord"), "lang", F.col("source").alias("url"), F.col("source").alias("title"),
                                      F.col("text").alias("body"), F.lit("网页").alias("kind"))
    return fq.merge_link_blocks(rows, ["lang"]).select("lang", "url", "first_ord", F.md5("body").alias("body"))


@query("mrg4b_merge_link_blocks_of_groups", f"""WITH {FAQ_SQL}, f AS (SELECT faq.*, documents.source, row_number() OVER (PARTITION BY category_id, documents.source ORDER BY length(answer) DESC, ord) AS rn,
  min(ord) OVER (PARTITION BY category_id, documents.source) AS first_ord FROM faq JOIN documents ON doc_id = ord),
b AS (SELECT category_id, 'https://docs.example/' || source AS url, answer AS body, first_ord FROM f WHERE rn = 1)
SELECT category_id, count(*) AS n, md5(string_agg(url, '|' ORDER BY first_ord)) AS urls, md5(string_agg(body, '|' ORDER BY first_ord)) AS bodies,
  array_to_string(list(url ORDER BY first_ord)[1:10], '|') AS links FROM b GROUP BY 1""")
def _(t):
    url = F.concat(F.lit("https://docs.example/"), F.get("variants", F.lit(0)))
    block = F.struct(url.alias("url"), url.alias("title"), F.col("answer").alias("body"), F.lit("网页").alias("kind"))
    merged = fq.merge_faq_groups(t.faq_items().withColumn("link_blocks", F.array(block)).withColumn("gk", F.col("category_id")), "gk")
    told = lambda name: F.md5(F.array_join(F.transform("link_blocks", lambda b: b[name]), "|"))
    return merged.select("category_id", F.size("link_blocks").cast("bigint").alias("n"), told("url").alias("urls"), told("body").alias("bodies"), F.array_join("links", "|").alias("links"))


@query("mrg4_merge_faq_group", f"WITH {FAQ_SQL}, {merged_sql(s.question_key('question'), 'faq')} {_MOUT}")
def _(t):
    items = t.faq_items().withColumn("g", tx.normalize_question(F.col("question")))
    return _merged_out(fq.merge_faq_groups(items, "g"), "g")


@query("mrg5_collect_raw_faqs", f"""WITH {FAQ_SQL}, f2 AS (SELECT ord, {s.strip('question')} AS question, {s.strip('answer')} AS answer, category_id, variants, list_filter(steps, lambda x: length(x) >= 5) AS steps, source_count FROM faq),
{merged_sql(s.question_key('question'), 'f2', "WHERE question <> '' AND length(answer) >= 12")} {_MOUT}""")
def _(t):
    return _merged_out(fq.collect_raw_faqs(t.faq_items()), "faq_key")


CHAT_FAQ_SQL = f"""{FAQ_EXT_SQL}, cf AS (SELECT session_id AS ord, question, answer, category_id, variants, list_filter(steps, lambda x: length(x) >= 5) AS steps, 1 AS source_count FROM ext),
{merged_sql(s.question_key('question'), 'cf', "WHERE length(" + s.strip('answer') + ") >= 12")}"""


def chat_faqs(t):
    # the extraction feeds several steps, so it is written once and read back
    return fq.collect_raw_faqs(cut_lineage(fq.faqs_from_extractions(extracted(t))))


@query("agg5_faq_by_category", f"""WITH {CHAT_FAQ_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY category_id ORDER BY source_count DESC, ord) AS rn FROM merged)
SELECT category_id, count(*) AS n, count(*) FILTER (len(steps) > 0) AS with_steps, string_agg(CASE WHEN rn <= 5 THEN question END, '|' ORDER BY rn) AS top_questions FROM r GROUP BY 1""")
def _(t):
    return fq.faq_by_category(chat_faqs(t)).withColumn("top_questions", F.array_join("top_questions", "|"))


@query("top3_top_faqs", f"""WITH {CHAT_FAQ_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY category_id ORDER BY source_count DESC, ord) AS rank FROM merged)
SELECT category_id, rank::INT AS rank, question FROM r WHERE rank <= 3""")
def _(t):
    return fq.top_faqs(chat_faqs(t), 3).select("category_id", "rank", "question")


_CM = " UNION ALL ".join(f"SELECT {s.q(c)} AS concept_id, * FROM merged WHERE {hits_sql('(question || answer)', p)} > 0" for c, p in CONCEPT_RULES)


@query("ext7_extract_concepts", f"""WITH {CHAT_FAQ_SQL}, m AS ({_CM.replace('(question || answer)', "(question || answer || array_to_string(variants, ' '))")}),
p AS (SELECT concept_id, substr(regexp_extract(answer, '^[^' || chr(10) || ']*'), 1, 120) AS point, min(ord) AS o FROM m GROUP BY 1, 2),
pl AS (SELECT concept_id, array_to_string(list(point ORDER BY o) FILTER (point <> '')[1:8], '|') AS points FROM p GROUP BY 1)
SELECT concept_id, array_to_string(list_sort(list(DISTINCT category_id)), ',') AS category_ids, count(*) AS n_faqs, any_value(points) AS points FROM m JOIN pl USING (concept_id) GROUP BY 1""")
def _(t):
    return fq.extract_concepts(chat_faqs(t), CONCEPT_RULES).select(
        "concept_id", F.array_join("category_ids", ",").alias("category_ids"), "n_faqs", F.array_join("points", "|").alias("points"))


# --- documents ----------------------------------------------------------------------------------

@query("flt6_usable_docs", f"WITH {DOCS_SQL} SELECT doc_id FROM docs WHERE title <> '' AND length(content) >= 400")
def _(t):
    return dc.usable_docs(t.docs(), 400).select("doc_id")


@query("flt6b_skipped_docs", f"WITH {DOCS_SQL} SELECT count(*) FILTER (title <> '' AND length(content) >= 400) AS kept, count(*) FILTER (NOT (title <> '' AND length(content) >= 400)) AS skipped FROM docs")
def _(t):
    return dc.skipped_docs(t.docs(), 400)


@query("top10_position_numbering", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS doc_index FROM documents")
def _(t):
    return dc.position_numbering(t.read("documents").select("doc_id"), "doc_id", id_bucket("doc_id", 100))


@query("snk5_taxonomy_request", f"""WITH {DOCS_SQL}, f AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS i, {s.strip(s.one_space(s.sub('content', '[#*`' + chr(92) + '[' + chr(92) + ']()' + chr(92) + '-_]', ' ')))} AS x FROM docs)
SELECT i AS doc_index, concat(i, '. [', source_site, '] ', title, chr(10), '   ', substr(CASE WHEN length(x) > 300 THEN substr(x, 1, 300) || '...' ELSE x END, 1, 220), chr(10), '   source_url: ', source_url) AS line FROM f WHERE i < 200""")
def _(t):
    return dc.taxonomy_request(t.docs().withColumn("summary", tx.doc_summary(F.col("content"))), "doc_id")


ASSIGN_SQL = """cats AS (SELECT * FROM (VALUES (0, 'alpha'), (1, 'general'), (2, 'beta')) v(ord, id)),
byurl AS (SELECT source_url, CASE doc_id % 4 WHEN 0 THEN 'alpha' WHEN 1 THEN 'zzz' END AS c FROM docs),
idx AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS doc_index FROM docs)"""


def _assignments(t, docs):
    n = F.col("doc_id")
    by_url = docs.select(F.col("doc_id").alias("ord"), "source_url", F.lit(None).cast("bigint").alias("doc_index"),
                         F.when(n % 4 == 0, "alpha").when(n % 4 == 1, "zzz").alias("category_id"))
    by_index = docs.select(F.col("doc_id").alias("ord"), F.lit(None).cast("string").alias("source_url"), "doc_index",
                           F.when(n % 4 == 2, "beta").alias("category_id"))
    return by_url.unionByName(by_index).filter("category_id IS NOT NULL")


def _indexed_docs(t):
    return dc.position_numbering(t.docs(), "doc_id", id_bucket("doc_id"))


@query("jon1_assign_categories", f"""WITH {DOCS_SQL} SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'alpha' WHEN 2 THEN 'beta' ELSE 'general' END AS category_id FROM docs""")
def _(t):
    docs = _indexed_docs(t)
    ids = docs.groupBy().agg(F.min("doc_id").alias("x")).select(
        F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(c).alias("id")) for i, c in enumerate(("alpha", "general", "beta"))])).alias("c")).select("c.*")
    return dc.assign_categories(docs, _assignments(t, docs), ids).select("doc_id", "category_id")


@query("jon2_apply_doc_enrichments", f"""WITH {DOCS_SQL}, n AS (SELECT *, '文档-' || doc_id AS nm FROM docs)
SELECT a.doc_id, CASE WHEN a.doc_id % 2 = 0 THEN 'sum ' || a.doc_id ELSE 'old' END AS summary,
  concat_ws('|', b.nm, c.nm) AS related FROM n a LEFT JOIN n b ON b.doc_id = a.doc_id + 20 LEFT JOIN n c ON c.doc_id = a.doc_id - 20 AND c.doc_id <> a.doc_id + 20""")
def _(t):
    n = F.col("doc_id")
    docs = t.docs().withColumn("file_name", F.concat(F.lit("文档-"), n)).withColumn("summary", F.lit("old"))
    # sources repeat every twenty documents, so these are URLs of neighbours from the same source
    near = F.array(F.concat(F.lit("doc://"), "source_site", F.lit("/"), n + 20), F.concat(F.lit("doc://"), "source_site", F.lit("/"), n - 20))
    enr = docs.select(n.alias("ord"), "source_url", F.when(n % 2 == 0, F.concat(F.lit("sum "), n)).otherwise("").alias("summary"), near.alias("related_doc_urls"))
    return dc.apply_doc_enrichments(docs, enr).select("doc_id", "summary", F.array_join("related_doc_names", "|").alias("related"))


@query("jon14_concept_docs", f"""WITH {DOCS_SQL}, d AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS ix FROM docs),
h AS ({' UNION ALL '.join(f"SELECT {s.q(c)} AS id, * FROM d WHERE {' OR '.join(f'contains(lower(title || content), {s.q(w)})' for w in ws)}" for c, ws in KEYWORDS)}),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ix) AS rn FROM h), c AS (SELECT * FROM r WHERE rn <= 30)
SELECT id, array_to_string(list_sort(list(DISTINCT lang)), ',') AS category_ids, string_agg('文档-' || doc_id, ',' ORDER BY rn) FILTER (rn <= 20) AS doc_names FROM c GROUP BY 1""")
def _(t):
    docs = dc.doc_concepts(_indexed_docs(t), KEYWORDS, None)
    docs = docs.withColumn("category_id", F.col("lang")).withColumn("file_name", F.concat(F.lit("文档-"), "doc_id"))
    concepts = dc.taxonomy_rollup(docs)["concepts"].select(F.col("concept_id").alias("id"), F.col("doc_indices").alias("related_doc_indices"))
    return dc.concept_docs(concepts, docs).select("id", F.array_join("category_ids", ",").alias("category_ids"), F.array_join("doc_names", ",").alias("doc_names"))


@query("agg11_taxonomy_rollup", f"""WITH {DOCS_SQL}, d AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS ix FROM docs),
h AS ({' UNION ALL '.join(f"SELECT {s.q(c)} AS id, * FROM d WHERE {' OR '.join(f'contains(lower(title || content), {s.q(w)})' for w in ws)}" for c, ws in KEYWORDS)}),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ix) AS rn FROM h)
SELECT 'category' AS kind, lang AS name, count(*) AS n, CAST(count(DISTINCT source_site) AS VARCHAR) AS detail FROM docs GROUP BY 2
UNION ALL SELECT 'concept', id, count(*), string_agg(ix, ',' ORDER BY rn) FROM r WHERE rn <= 30 GROUP BY 2""")
def _(t):
    docs = dc.doc_concepts(_indexed_docs(t), KEYWORDS, None).withColumn("category_id", F.col("lang"))
    r = dc.taxonomy_rollup(docs)
    cats = r["categories"].select(F.lit("category").alias("kind"), F.col("category_id").alias("name"), F.col("n_docs").alias("n"), F.col("n_sites").cast("string").alias("detail"))
    cons = r["concepts"].select(F.lit("concept").alias("kind"), F.col("concept_id").alias("name"), F.size("doc_indices").cast("bigint").alias("n"),
                                F.array_join(F.col("doc_indices").cast("array<string>"), ",").alias("detail"))
    return cats.unionByName(cons)


@query("agg11b_doc_concepts", f"""WITH {DOCS_SQL} SELECT doc_id, array_to_string(list_filter([{', '.join(f"CASE WHEN {' OR '.join(f'contains(lower(title || content), {s.q(w)})' for w in ws)} THEN {s.q(c)} END" for c, ws in KEYWORDS)}], lambda x: x IS NOT NULL)[1:5], ',') AS concepts FROM docs""")
def _(t):
    return dc.doc_concepts(t.docs(), KEYWORDS, None).select("doc_id", F.array_join(F.slice("concept_ids", 1, 5), ",").alias("concepts"))


@query("agg12_site_taxonomy", "SELECT lower(source) AS id, source || ' 文档集' AS title, count(*) AS n_docs FROM documents GROUP BY 1, 2")
def _(t):
    return dc.site_taxonomy(t.docs())[0].select("id", "title", "n_docs")


@query("top9_longest_docs", """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY length(text) DESC, doc_id) AS rank FROM documents)
SELECT lang AS category_id, rank::INT AS rank, doc_id FROM r WHERE rank <= 5""")
def _(t):
    return dc.longest_docs(t.docs().withColumn("category_id", F.col("lang"))).select("category_id", "rank", "doc_id")


@query("mrg1_dedupe_by_url_largest", """WITH p AS (SELECT page_id, regexp_extract(url, '^[^/]*//[^/]*') AS site, length(html) AS n FROM pages)
SELECT site, arg_max(page_id, {'n': n, 'o': -page_id}) AS page_id FROM p GROUP BY 1""")
def _(t):
    rows = t.read("pages").withColumn("site", F.regexp_extract("url", "^[^/]*//[^/]*", 0))
    return dc.dedupe_by_url_largest(rows, "site", F.length("html"), "page_id").select("site", "page_id")


@query("mrg2_dedupe_keep_first", f"WITH {DOCS_SQL} SELECT title, min(doc_id) AS doc_id FROM docs GROUP BY 1")
def _(t):
    return dc.dedupe_keep_first(t.docs(), F.col("title"), "doc_id").select("title", "doc_id")


@query("mrg9_upsert_docs", """WITH o AS (SELECT * FROM documents WHERE lang <> 'fr'), n AS (SELECT doc_id, text || ' v2' AS text FROM documents WHERE lang <> 'en')
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, md5(coalesce(n.text, o.text)) AS content, CASE WHEN o.doc_id IS NULL THEN 'new-' || n.doc_id ELSE 'old-' || o.doc_id END AS file_name,
 CASE WHEN o.doc_id IS NULL THEN 'insert' WHEN n.doc_id IS NULL THEN 'keep' ELSE 'update' END AS action FROM o FULL JOIN n ON o.doc_id = n.doc_id""")
def _(t):
    docs = t.docs()
    old = docs.filter("lang <> 'fr'").withColumn("file_name", F.concat(F.lit("old-"), "doc_id"))
    new = docs.filter("lang <> 'en'").withColumn("content", F.concat("content", F.lit(" v2"))).withColumn("file_name", F.concat(F.lit("new-"), "doc_id"))
    return dc.upsert_docs(old, new).select("doc_id", F.md5("content").alias("content"), "file_name", "action")


@query("mrg10_merge_concepts", f"""WITH d AS (SELECT source, list(lang || doc_id ORDER BY doc_id) AS p, list_sort(list(DISTINCT lang)) AS c FROM (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 12) GROUP BY 1)
SELECT source AS concept_id, 'old-' || source AS file_name, array_to_string(CASE WHEN len(p) >= 5 THEN p[1:8] ELSE p END, '|') AS points, array_to_string(c, ',') AS category_ids FROM d""")
def _(t):
    from talkweave.operators.ordering import top_rows

    rows = top_rows(t.read("documents"), ["source"], [F.col("doc_id")], 12)
    item = F.struct("rank", F.concat("lang", "doc_id").alias("p"))

    def side(name, keep):
        packed = F.transform(F.array_sort(F.collect_list(F.when(keep, item))), lambda x: x["p"])
        return rows.groupBy(F.col("source").alias("concept_id")).agg(packed.alias("points"), F.collect_set(F.when(keep, F.col("lang"))).alias("category_ids")).select(
            "concept_id", F.lit("t").alias("title"), F.lit("d").alias("definition"), F.concat(F.lit(name), "concept_id").alias("file_name"), "points", "category_ids")

    old, new = side("old-", F.col("rank") <= 5), side("new-", F.col("rank") >= 3)
    return dc.merge_concepts(old, new).select("concept_id", "file_name", F.array_join("points", "|").alias("points"), F.array_join("category_ids", ",").alias("category_ids"))


_BASE = s.plain_filename("('问答-' || regexp_extract(text, '^[^' || chr(10) || ' ]*'))")


@query("mrg11_unique_names", f"""WITH b AS (SELECT doc_id, {_BASE} AS base, substr(text, 1, 4) AS seed FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY doc_id) AS rn, base || '-' || substr(md5(seed), 1, 6) AS cand FROM b),
c AS (SELECT *, row_number() OVER (PARTITION BY cand, rn > 1 ORDER BY doc_id) AS cn FROM r)
SELECT doc_id, CASE WHEN rn = 1 THEN base WHEN cn = 1 THEN cand ELSE cand || cn END AS file_name FROM c""")
def _(t):
    base = tx.sanitize_filename_text(F.concat(F.lit("问答-"), F.regexp_extract("text", "^[^\\n ]*", 0)))
    return dc.unique_names(t.read("documents"), base, F.substring("text", 1, 4), "doc_id").select("doc_id", "file_name")


def web_pages(t):
    return t.read("pages").select("page_id", "url", "html")


@query("src10_read_pages", "SELECT page_id, url, length(html) AS n FROM pages")
def _(t):
    return web_pages(t).select("page_id", "url", F.length("html").cast("bigint").alias("n"))


@query("txt34_page_main_text")
def _(t):
    return dc.usable_pages(dc.parse_pages(web_pages(t))).select("url", "title", F.md5("body").alias("body"), F.length("body").alias("n"), "h2")


_PT = s.clean_title(f"concat({PAGE_TITLE_SQL}, ' - ', page_id)")
_HINT = label_sql("regexp_extract(" + s.sub(s.uri("url", 3), "/+\\z") + ", '[^/]*$')")


@query("txt35_page_core_name", f"""WITH p AS (SELECT page_id, url, {_PT} AS t, CASE WHEN page_id % 3 = 0 THEN 'Intro' || page_id ELSE '' END AS h, {_HINT} AS hint, {path_label_sql('url')} AS label FROM pages),
b AS (SELECT page_id, CASE WHEN h <> '' AND NOT contains(t, h) THEN CASE WHEN t <> '' THEN t || '-' || h ELSE h END WHEN hint <> '' AND hint <> t AND hint <> 'html' AND t <> '' THEN t || '-' || hint WHEN t <> '' THEN t ELSE label END AS base FROM p)
SELECT page_id, {s.sanitize_filename('base')} AS name FROM b""")
def _(t):
    title = F.concat("title", F.lit(" - "), "page_id")
    h2 = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("Intro"), "page_id")).otherwise("")
    return t.page_titles().select("page_id", ux.page_core_name(title, h2, F.col("url")).alias("name"))


@query("ext8b_url_taxonomy", f"WITH v AS (SELECT page_id, {EXT8_URL} AS u FROM pages) SELECT {_url_category_sql()} AS category_id, count(*) AS n FROM v GROUP BY 1")
def _(t):
    return t.read("pages").groupBy(ux.url_category(F.expr(EXT8_URL)).alias("category_id")).agg(F.count(F.lit(1)).alias("n"))


@query("src4_web_docs")
def _(t):
    from talkweave.sources.readers import parse_web_docs

    doc = F.concat(F.lit("---\nsource_type: website\nsource_url: "), "url", F.lit("\ntitle: "), "title", F.lit("\nfilename_core: page-"), "page_id",
                   F.lit("\n---\n\n# "), "title", F.lit("\n\n"), html_to_text(F.col("html")))
    files = t.page_titles().select(F.concat(F.lit("file:/raw/site/"), "page_id", F.lit(".md")).alias("file_path"), F.lit(1).alias("file_size"), doc.alias("text"))
    return parse_web_docs(files).select("source_url", "title", "core_name", "source_site", F.md5("content").alias("content"))


