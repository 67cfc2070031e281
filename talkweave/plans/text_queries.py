"""Text, URL and key functions over whole tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkweave import rules
from talkweave.functions import links as lk
from talkweave.functions import scoring as sc
from talkweave.functions import text as tx
from talkweave.functions import urls as ux
from talkweave.functions.html import html_to_text
from talkweave.plans import sqltext as s
from talkweave.plans.registry import query
from talkweave.sources.adapters import CHAT_SQL, WIKI_SQL

# Rule sets for text in European languages; the defaults of the functions are Chinese.
NOISE = [r"^(no|non|nein|yes|oui|ja|si)\b", r"^[^ ]+$"]
POLITE = [r"\b(danke|merci|gracias|thanks)\b", r"^.{0,12}\.?$"]
LATIN_STOP = ["the", "and", "of", "to", "in", "that"]
WIKI_WITH = f"WITH {WIKI_SQL} "


@query("txt1_repair_mojibake", """
SELECT doc_id, md5(text) AS repaired, length(text) AS n FROM documents
WHERE text <> ''
""")
def _(t):
    # Round trip: damage every text with CJK added, repair it, and drop the marker again.
    marked = F.concat(F.lit("高斯"), F.col("text"))
    damaged = F.decode(F.encode(marked, "UTF-8"), "ISO-8859-1")
    fixed = F.regexp_replace(tx.repair_mojibake(damaged), "^高斯", "")
    return t.read("documents").filter(F.col("text") != "").select(
        "doc_id", F.md5(fixed).alias("repaired"), F.length(fixed).cast("bigint").alias("n"))


@query("txt2_normalize_text", f"SELECT doc_id, md5({s.normalize_text('text')}) AS h, length({s.normalize_text('text')}) AS n FROM documents")
def _(t):
    n = tx.normalize_text(F.col("text"))
    return t.read("documents").select("doc_id", F.md5(n).alias("h"), F.length(n).cast("bigint").alias("n"))


PAGE_TITLE_SQL = "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"


@query("txt3_clean_page_title", f"SELECT page_id, {s.clean_title(f'concat({PAGE_TITLE_SQL}, chr(32), chr(124), url)')} AS title FROM pages")
def _(t):
    return t.page_titles().select("page_id", tx.clean_page_title(F.concat("title", F.lit(" |"), "url")).alias("title"))


@query("txt4_sanitize_filename", f"""
SELECT doc_id, {s.sanitize_filename('text')} AS hyphen_form, md5({s.plain_filename('text')}) AS plain_form FROM documents""")
def _(t):
    return t.read("documents").select(
        "doc_id", tx.sanitize_filename(F.col("text")).alias("hyphen_form"),
        F.md5(tx.sanitize_filename_text(F.col("text"))).alias("plain_form"))


URL_TEXT_SQL = "concat('see ', url, ', then ', url, '.')"


def _url_text():
    return F.concat(F.lit("see "), "url", F.lit(", then "), "url", F.lit("."))


URL_MESSAGE_RE = f"(?i)https?://[^{tx.BLANK}\\]<>)\"'{tx.CJK}，。；、]+"
URL_QUESTION_RE = f"(?i)https?://[^{tx.BLANK}\\]\\)\"'<>，。；、]+"
_cut = "list_transform({x}, lambda u: regexp_replace(u, {p}, ''))"
URLS_SQL = (f"list_filter({_cut.format(x=s.find_all('{x}', URL_MESSAGE_RE), p=s.q('[.,;:)】」]+' + chr(92) + 'z'))}, "
            "lambda u: starts_with(u, 'http'))")


def urls_sql(x: str) -> str:
    return URLS_SQL.replace("{x}", x)


@query("txt5_extract_urls", f"SELECT page_id, array_to_string({urls_sql(URL_TEXT_SQL)}, ' ') AS urls FROM pages")
def _(t):
    return t.read("pages").select("page_id", F.array_join(ux.extract_urls(_url_text()), " ").alias("urls"))


@query("txt6_extract_urls_distinct", "SELECT page_id, array_to_string(" + s.distinct_in_order(
    _cut.format(x=s.find_all(URL_TEXT_SQL, URL_QUESTION_RE), p=s.q("[.,;:!?）)\\]}]+\\z"))) + ", ' ') AS urls FROM pages")
def _(t):
    return t.read("pages").select("page_id", F.array_join(ux.extract_urls_distinct(_url_text()), " ").alias("urls"))


@query("txt7_session_urls", f"""
WITH d AS (SELECT page_id, concat('https://files.example/', page_id) AS f, {urls_sql(URL_TEXT_SQL)} AS u FROM pages)
SELECT page_id, array_to_string([f] || (CASE WHEN u[1] IS NULL THEN CAST([] AS VARCHAR[]) ELSE [u[1]] END), ' ') AS urls FROM d""")
def _(t):
    doc = F.concat(F.lit("---\nsession_id: \"a\"\nfile_urls:\n  - \"https://files.example/"), "page_id",
                   F.lit("\"\n---\n\n"), _url_text())
    return t.read("pages").select("page_id", F.array_join(ux.session_urls(doc), " ").alias("urls"))


_IMG = "(" + ", ".join(s.q(e) for e in rules.IMAGE_EXTENSIONS) + ")"
_EXT = f"regexp_extract(lower({s.uri('u', 3)}), '(\\.[a-z0-9]+)$', 1)"
_KIND = " OR ".join([f"ends_with(lower({s.uri('u', 3)}), {s.q(e)})" for e in rules.IMAGE_SUFFIXES]
                    + [f"contains({s.host('u')}, {s.q(h)})" for h in rules.IMAGE_HOST_HINTS])


@query("txt8_url_kind", f"""
WITH v AS (SELECT page_id, unnest([url, concat(split_part(split_part(url, '?', 1), '#', 1), '.PNG'), concat('https://img', page_id, '.net/a.html')]) AS u FROM pages)
SELECT page_id, u AS url, {_EXT} AS ext, {_EXT} IN {_IMG} AS is_image, CASE WHEN {_KIND} THEN 'image' ELSE 'page' END AS kind FROM v""")
def _(t):
    bare = F.regexp_replace("url", "[?#].*", "")
    variants = F.array("url", F.concat(bare, F.lit(".PNG")), F.concat(F.lit("https://img"), "page_id", F.lit(".net/a.html")))
    u = F.col("url")
    return t.read("pages").select("page_id", F.explode(variants).alias("url")).select(
        "page_id", "url", ux.url_extension(u).alias("ext"), ux.is_image_url(u).alias("is_image"), ux.url_kind(u).alias("kind"))


@query("txt9_is_safe_url", """
WITH v AS (SELECT page_id, unnest([url, concat('http://10.', page_id % 256, '.3.4/x'), concat('http://', 160 + page_id % 20, '.16.0.9:80/'),
   concat('http://172.', page_id % 40, '.1.1/'), 'ftp://example.com/a', 'http://localhost:8080/', 'https://box.local/']) AS u,
   generate_subscripts([1,2,3,4,5,6,7], 1) AS i FROM pages)
SELECT page_id, u AS url, CASE i WHEN 1 THEN TRUE WHEN 3 THEN page_id % 20 <> 12 WHEN 4 THEN page_id % 40 NOT BETWEEN 16 AND 31 ELSE FALSE END AS safe FROM v""")
def _(t):
    n = F.col("page_id")
    variants = F.array(
        "url", F.concat(F.lit("http://10."), n % 256, F.lit(".3.4/x")), F.concat(F.lit("http://"), 160 + n % 20, F.lit(".16.0.9:80/")),
        F.concat(F.lit("http://172."), n % 40, F.lit(".1.1/")), F.lit("ftp://example.com/a"), F.lit("http://localhost:8080/"),
        F.lit("https://box.local/"))
    return t.read("pages").select("page_id", F.explode(variants).alias("url")).withColumn("safe", ux.is_safe_url(F.col("url")))


_LAST = f"regexp_extract({s.sub(s.sub('url', '(?s)' + chr(92) + '?.*'), '/+' + chr(92) + 'z')}, '[^/]*$')"


@query("txt10_url_slug", f"""
SELECT page_id, concat(coalesce(nullif(lower({s.sub(s.sub(_LAST, f'[^{tx.WORD}' + chr(92) + '-]+', '-'), '^-+|-+' + chr(92) + 'z')}), ''), 'url'),
  '-', substr(md5(url), 1, 10)) AS slug FROM pages""")
def _(t):
    return t.read("pages").select("page_id", ux.url_slug(F.col("url")).alias("slug"))


def label_sql(x: str) -> str:
    seg = s.sub(x, "(?i)\\.html?\\z")
    cases = " ".join(f"WHEN {s.q(k)} THEN {s.q(v)}" for k, v in rules.PATH_LABELS.items())
    return f"CASE lower({seg}) {cases} ELSE replace({s.sub(seg, '([a-z])([A-Z])', chr(92) + '1-' + chr(92) + '2')}, '_', '-') END"


def path_label_sql(x: str) -> str:
    skip = "[" + ", ".join(s.q(p) for p in rules.PATH_BOILERPLATE) + "]"
    parts = f"list_filter(string_split({s.uri(x, 3)}, '/'), lambda p: p <> '' AND NOT list_contains({skip}, lower(p)))"
    return (f"(SELECT CASE WHEN len(pp) = 0 THEN '首页' ELSE array_to_string(list_transform(pp[greatest(len(pp)-1,1):], lambda g: {label_sql('g')}), '-') END "
            f"FROM (SELECT {parts} AS pp))")


@query("txt11_url_path_label", f"SELECT page_id, {path_label_sql('url')} AS label FROM pages")
def _(t):
    return t.read("pages").select("page_id", ux.url_path_label(F.col("url")).alias("label"))


_BAD = " OR ".join([f"ends_with(lower({s.uri('u', 3)}), {s.q(e)})" for e in rules.CRAWL_SKIP_EXTENSIONS]
                   + [f"contains(lower(u), {s.q(x)})" for x in rules.CRAWL_SKIP_SEGMENTS] + [f"{s.uri('u', 4)} <> ''"])


@query("txt12_crawlable_url", f"""
WITH v AS (SELECT page_id, url, unnest([url, concat(split_part(url, '?', 1), '/login'), concat('http://other.example', page_id % 3, '/a'), concat(split_part(split_part(url, '?', 1), '#', 1), '.pdf')]) AS u FROM pages)
SELECT page_id, u AS link, NOT ({_BAD}) AND {s.uri('u', 2)} = {s.uri('url', 2)} AND starts_with(u, 'http') AND starts_with({s.uri('u', 3)}, '/en') AS keep FROM v""")
def _(t):
    bare = F.regexp_replace("url", "(?s)\\?.*", "")
    variants = F.array("url", F.concat(bare, F.lit("/login")), F.concat(F.lit("http://other.example"), F.col("page_id") % 3, F.lit("/a")),
                       F.concat(F.regexp_replace(bare, "#.*", ""), F.lit(".pdf")))
    return t.read("pages").select("page_id", "url", F.explode(variants).alias("link")).select(
        "page_id", "link", ux.crawlable_url(F.col("link"), F.col("url"), prefix="/en").alias("keep"))


@query("txt13_is_noise", f"WITH {CHAT_SQL} SELECT session_id, msg_id, {s.is_noise('content', NOISE, 40)} AS noise FROM chat")
def _(t):
    return t.chat_messages().select("session_id", "msg_id", tx.is_noise(F.col("content"), NOISE, 40).alias("noise"))


@query("txt14_is_politeness_only", f"WITH {CHAT_SQL} SELECT session_id, msg_id, {s.is_polite('content', POLITE)} AS polite FROM chat")
def _(t):
    return t.chat_messages().select("session_id", "msg_id", tx.is_politeness_only(F.col("content"), POLITE).alias("polite"))


@query("txt15_substantive_score", f"""WITH {CHAT_SQL} SELECT session_id, msg_id,
 CASE WHEN len({urls_sql('content')}) > 0 THEN 2 WHEN role = '访客' AND {s.cjk_count('content')} >= 5 THEN 1
 WHEN role = '客服' AND {s.cjk_count('content')} >= 6 THEN 1 WHEN length(content) >= 200 THEN 1 ELSE 0 END AS score FROM chat""")
def _(t):
    return t.chat_messages().select("session_id", "msg_id", tx.substantive_score(
        tx.role_label(F.col("sender_type")), F.col("content"), min_chars=200).alias("score"))


_OCR = "(?i)" + "|".join(f"(?:{p})" for p in rules.OCR_LOW_VALUE_PATTERNS)
_LINES = f"list_transform(regexp_split_to_array(text, {s.q(tx.LINE_BREAK)}), lambda x: {s.strip('x')})"
_KEPT = (f"list_filter({_LINES}, lambda x: x <> '' AND NOT starts_with(x, '_fetched_at:') AND NOT starts_with(x, '## 图片文字识别') "
         "AND NOT starts_with(x, '_未识别') AND NOT starts_with(x, '>'))")


@query("txt16_is_meaningful_text", f"""
WITH d AS (SELECT doc_id, {_KEPT} AS kept FROM documents), e AS (SELECT doc_id, kept, array_to_string(kept, chr(10)) AS body FROM d)
SELECT doc_id, length(body) >= 300 AND NOT {s.hit('body', _OCR)} AND len(list_filter(kept, lambda x: ({s.cjk_count('x')} >= 4 OR {s.hit('x', '[A-Za-z]{4,}')}
  OR (length(x) >= 12 AND {s.hit('x', f'[{tx.CJK}A-Za-z0-9]')})) AND NOT {s.is_noise('x', NOISE, 2)} AND NOT {s.is_polite('x', POLITE)})) > 0 AS meaningful FROM e""")
def _(t):
    return t.read("documents").select("doc_id", tx.is_meaningful_text(F.col("text"), 300, NOISE, POLITE).alias("meaningful"))


@query("txt17_is_meaningful_ocr_text", f"""
SELECT doc_id, length({s.strip("array_to_string(list_filter(" + _LINES + ", lambda x: x <> '' AND NOT " + s.hit('x', _OCR.replace('(?i)', '')) + "), chr(10))")}) >= 500 AS meaningful FROM documents""")
def _(t):
    return t.read("documents").select("doc_id", tx.is_meaningful_ocr_text(F.col("text"), 500).alias("meaningful"))


_SEEN = s.strip("text")
_TOLD = s.strip("array_to_string(list_filter(" + _LINES.replace("text", _SEEN) + ", lambda x: x <> '' AND NOT " + s.hit("x", _OCR.replace("(?i)", "")) + "), chr(10))")


@query("txt17b_labelled_ocr_text", f"""SELECT doc_id, md5(CASE WHEN {_SEEN} = '' THEN '（本地 OCR 未识别到有效文字；截图中的箭头/框选标注需结合客户文字说明理解）'
 WHEN length({_TOLD}) >= 15 THEN {_SEEN} || chr(10) || chr(10) || '说明：以上为本地 OCR 提取的文字；若图中有客户标注（箭头、框选等），请结合客户描述理解。'
 ELSE '（本地 OCR 仅识别到少量文字）' || chr(10) || {_SEEN} || chr(10) || chr(10) || '说明：本地 OCR 无法解析标注含义；若图中有圈选/箭头，请以客户文字为准。' END) AS labelled FROM documents""")
def _(t):
    return t.read("documents").select("doc_id", F.md5(tx.labelled_ocr_text(F.col("text"))).alias("labelled"))


@query("txt18_normalize_question", f"WITH {CHAT_SQL} SELECT session_id, msg_id, md5({s.question_key('content')}) AS key FROM chat")
def _(t):
    return t.chat_messages().select("session_id", "msg_id", F.md5(tx.normalize_question(F.col("content"))).alias("key"))


_CORE = s.plain_filename(s.sub(s.sub(s.sub(s.strip("content"), "[？?！!。.]+\\z"),
        f"(?i)^(你好|您好|请问|麻烦|想问|老师|应用支持工程师|人工客服)[，,、{tx.BLANK}]*"), f"^[@＠][^{tx.BLANK}]+[，,、{tx.BLANK}]*"))


@query("txt19_faq_core_title", f"""WITH {CHAT_SQL}, c AS (SELECT session_id, msg_id, {_CORE} AS x FROM chat)
SELECT session_id, msg_id, coalesce(nullif(CASE WHEN length(x) > 42 THEN {s.sub('substr(x, 1, 42)', '[，、的了吗呢]+' + chr(92) + 'z')} ELSE x END, ''), '未命名问题') AS title FROM c""")
def _(t):
    return t.chat_messages().select("session_id", "msg_id", tx.faq_core_title(F.col("content")).alias("title"))


_STEM = "concat('问答-', regexp_extract(text, '^[^' || chr(10) || ']*'), '-', substr(md5(text), 1, 6), '.md')"


@query("txt20_norm_keys", f"""SELECT doc_id, {s.link_key(_STEM)} AS link_key, {s.link_key("replace(" + s.sub(s.sub(s.strip(_STEM), chr(92)+'.md'+chr(92)+'z'), '-[0-9a-f]{6,8}'+chr(92)+'z') + ", '问答-', '')")} AS faq_key FROM documents""")
def _(t):
    stem = F.concat(F.lit("问答-"), tx.first_line(F.col("text")), F.lit("-"), F.substring(F.md5("text"), 1, 6), F.lit(".md"))
    return t.read("documents").select("doc_id", tx.norm_link_key(stem).alias("link_key"), tx.norm_faq_key(stem).alias("faq_key"))


_ALIAS = s.sub(s.sub(s.sub(s.strip("st"), "\\.md\\z"), "[ \\x{3000}]"), "[-_]{2,}", "-")


@query("txt21_alias_keys", f"""WITH d AS (SELECT doc_id, concat('问答-', regexp_extract(text, '^[^' || chr(10) || ']*'), '--（', source, '）.md') AS st FROM documents)
SELECT doc_id, {_ALIAS} AS alias, {s.sub(_ALIAS, f'[^{tx.WORD}' + chr(92) + '-（）()]+')} AS soft FROM d""")
def _(t):
    stem = F.concat(F.lit("问答-"), tx.first_line(F.col("text")), F.lit("--（"), "source", F.lit("）.md"))
    return t.read("documents").select("doc_id", tx.alias_key(stem).alias("alias"), tx.soft_alias_key(stem).alias("soft"))


@query("txt22_session_slugs", f"""WITH {CHAT_SQL} SELECT session_id, msg_id,
 substr(lower({s.sub(s.sub("replace(content, '.', '-')", f'[^{tx.WORD}' + chr(92) + '-]+', '-'), '^-+|-+' + chr(92) + 'z')}), 1, 72) AS slug,
 substr({s.sub('content', f'[^{tx.WORD}' + chr(92) + '-]', '-')}, 1, 64) AS safe_id,
 md5({s.plain_filename(s.sub(s.sub('content', '[（(]([^）)]+)[）)]', '-' + chr(92) + '1'), f'[/{tx.BLANK}]+', '-'))}) AS category FROM chat""")
def _(t):
    c = F.col("content")
    return t.chat_messages().select("session_id", "msg_id", tx.session_slug(c).alias("slug"), tx.safe_session_id(c).alias("safe_id"),
                                    F.md5(tx.category_slug(c)).alias("category"))


@query("txt23_truncate_text", f"""WITH d AS (SELECT doc_id, {s.strip(s.one_space('text'))} AS x FROM documents)
SELECT doc_id, CASE WHEN length(x) <= 48 THEN x ELSE substr(x, 1, 47) || '…' END AS short FROM d""")
def _(t):
    return t.read("documents").select("doc_id", tx.truncate_text(F.col("text")).alias("short"))


@query("txt24_doc_summary", f"""
WITH d AS (SELECT doc_id, source, {s.strip(s.one_space(s.sub('text', '[#*`' + chr(92) + '[' + chr(92) + ']()' + chr(92) + '-_]', ' ')))} AS x,
  list_filter(list_transform(string_split(text, chr(10)), lambda y: {s.strip('y')}), lambda y: length(y) >= 20 AND NOT starts_with(y, '#'))[1] AS f FROM documents)
SELECT doc_id, CASE WHEN length(x) > 300 THEN substr(x, 1, 300) || '...' ELSE x END AS summary,
  concat(source, '：', coalesce(CASE WHEN length(f) > 120 THEN substr(f, 1, 120) || '…' ELSE f END, '平台帮助文档，介绍相关功能与操作步骤。')) AS by_line FROM d""")
def _(t):
    return t.read("documents").select("doc_id", tx.doc_summary(F.col("text")).alias("summary"),
                                      tx.first_line_summary(F.col("source"), F.col("text")).alias("by_line"))


@query("txt25_extract_keywords", f"SELECT item_id, array_to_string({s.keywords('text', LATIN_STOP)}, '|') AS keywords FROM benchmark")
def _(t):
    return t.read("benchmark").select("item_id", F.array_join(sc.extract_keywords(F.col("text"), LATIN_STOP), "|").alias("keywords"))


@query("txt29_strip_code_blocks", WIKI_WITH + f"SELECT stem, md5({s.sub('text', '(?s)```.*?```')}) AS h FROM wiki")
def _(t):
    return t.wiki_pages().select("stem", F.md5(tx.strip_code_blocks(F.col("text"))).alias("h"))


WIKILINKS_SQL = (f"list_filter(list_transform({s.find_all(s.sub('text', '(?s)```.*?```'), lk.WIKILINK, 1)}, lambda x: {s.sub(s.strip('x'), chr(92) + '.md' + chr(92) + 'z')}), "
                 f"lambda x: x <> '' AND NOT starts_with(x, '.agent-queue/') AND NOT {s.hit('x', chr(92) + '$' + chr(92) + '{|' + chr(34) + '|/opt/|https?://')})")
TYPED_SQL = s.distinct_in_order(f"list_transform({s.find_all('text', lk.TYPED_WIKILINK, 1)}, lambda x: {s.strip(s.sub('x', '(?s)（.*'))})")


@query("txt30_wikilinks", WIKI_WITH + f"SELECT stem, array_to_string({WIKILINKS_SQL}, ' ') AS links, array_to_string({TYPED_SQL}, ' ') AS typed FROM wiki")
def _(t):
    return t.wiki_pages().select("stem", F.array_join(lk.wikilinks(F.col("text")), " ").alias("links"),
                                 F.array_join(lk.typed_wikilinks(F.col("text")), " ").alias("typed"))


MDLINKS_SQL = (f"list_transform(list_filter({s.find_all(s.sub('text', '(?s)```.*?```'), lk.MD_LINK, 1)}, lambda x: {s.hit('x', '^(faqs|concepts|categories)/.*')}), "
               f"lambda x: {s.sub(s.sub(s.sub('x', '#.*'), '^.*/'), chr(92) + '.md' + chr(92) + 'z')})")


@query("txt31_md_rel_links", WIKI_WITH + f"SELECT stem, array_to_string({MDLINKS_SQL}, ' ') AS links FROM wiki")
def _(t):
    return t.wiki_pages().select("stem", F.array_join(lk.md_rel_links(F.col("text")), " ").alias("links"))


@query("txt32_md_section", WIKI_WITH + f"""SELECT stem,
  md5({s.strip("regexp_extract(text || chr(10) || '## ', '(?s)## 标准回答' || chr(92) || 's*' || chr(92) || 'n+(.*?)' || chr(92) || 'n##' || chr(92) || 's', 1)")}) AS answer,
  {s.strip("regexp_extract(text || chr(10) || '## ', '(?s)## 操作步骤' || chr(92) || 's*' || chr(92) || 'n+(.*?)' || chr(92) || 'n##' || chr(92) || 's', 1)")} AS steps FROM wiki""")
def _(t):
    return t.wiki_pages().select("stem", F.md5(tx.standard_answer(F.col("text"))).alias("answer"),
                                 tx.md_section(F.col("text"), "## 操作步骤").alias("steps"))


_HTML_GAPS = "(?is)<!--.*?-->|<[!?][^>]*>|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<noscript[^>]*>.*?</noscript>|</?[a-z][^>]*>"


def visible_text_sql(column: str) -> str:
    shown = "x"
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        shown = f"regexp_replace({shown}, '&{name};?', '{char}', 'g')"
    return f"array_to_string(list_filter(list_transform(string_split_regex({column}, '{_HTML_GAPS}'), lambda x: {s.strip(shown)}), lambda x: x <> ''), chr(10))"


@query("txt33_html_to_text", f"WITH v AS (SELECT page_id, {visible_text_sql('html')} AS t FROM pages) SELECT page_id, md5(t) AS h, length(t) AS n FROM v")
def _(t):
    text = html_to_text(F.col("html"))
    return t.read("pages").select("page_id", F.md5(text).alias("h"), F.length(text).alias("n"))


@query("txt36_punct_segments", f"""WITH {CHAT_SQL}, p AS (SELECT session_id, msg_id, list_filter(list_transform(
  {s.find_all('content', '[^' + ''.join(chr(92) + c if c in '[]()' else c for c in rules.SEGMENT_BOUNDARIES) + ']*[' + ''.join(chr(92) + c if c in '[]()' else c for c in rules.SEGMENT_BOUNDARIES) + ']|[^' + ''.join(chr(92) + c if c in '[]()' else c for c in rules.SEGMENT_BOUNDARIES) + ']{1,120}')},
  lambda x: {s.strip('x')}), lambda x: x <> '') AS l FROM chat)
SELECT session_id, msg_id, len(l) AS n, md5(array_to_string(l, '|')) AS h FROM p""")
def _(t):
    seg = tx.punct_segments(F.col("content"))
    return t.chat_messages().select("session_id", "msg_id", F.size(seg).cast("bigint").alias("n"), F.md5(F.array_join(seg, "|")).alias("h"))


@query("txt37_sentences_by_stop", f"""WITH p AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, '.'), lambda x: {s.strip('x')}), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, CASE WHEN {s.strip('text')} = '' THEN 1 ELSE len(l) END AS n, md5(CASE WHEN {s.strip('text')} = '' THEN '收到你的问题。' ELSE array_to_string(l, '|') END) AS h FROM p""")
def _(t):
    parts = tx.sentences_by_stop(F.col("text"), ".")
    return t.read("documents").select("doc_id", F.size(parts).cast("bigint").alias("n"), F.md5(F.array_join(parts, "|")).alias("h"))


@query("txt38_parse_time_bound", """
SELECT event_id, epoch_us(CASE WHEN event_id % 2 = 0 THEN date_trunc('day', ts) ELSE date_trunc('second', ts) END) AS low,
       epoch_us(CASE WHEN event_id % 2 = 0 THEN date_trunc('day', ts) + INTERVAL 86399 SECOND ELSE date_trunc('second', ts) END) AS high FROM events""")
def _(t):
    day = F.date_format("ts", "yyyy-MM-dd")
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 3 == 0, "Z").otherwise(""))
    bound = F.when(F.col("event_id") % 2 == 0, day).otherwise(iso)
    return t.read("events").select("event_id", F.unix_micros(tx.parse_time_bound(bound)).alias("low"),
                                   F.unix_micros(tx.parse_time_bound(bound, end_of_day=True)).alias("high"))


@query("txt39_role_label", f"WITH {CHAT_SQL} SELECT session_id, msg_id, role FROM chat")
def _(t):
    return t.chat_messages().select("session_id", "msg_id", tx.role_label(F.col("sender_type")).alias("role"))


def _url_category_sql() -> str:
    u = "lower(u)"
    cases = []
    for area, fragments, category in rules.URL_CATEGORY_RULES:
        test = f"contains({u}, {s.q(area)})"
        if fragments:
            test += " AND (" + " OR ".join("(" + " AND ".join(f"contains({u}, {s.q(x)})" for x in f) + ")" for f in fragments) + ")"
        cases.append(f"WHEN {test} THEN {s.q(category)}")
    return f"CASE {' '.join(cases)} ELSE {s.q(rules.URL_CATEGORY_DEFAULT)} END"


EXT8_URL = """concat('https://www.example.com', CASE page_id % 4 WHEN 0 THEN '/ac/openapi/doc/2.0' ELSE '/help/docs/mainsite' END,
  CASE page_id % 7 WHEN 0 THEN '/moduleapi/llm' WHEN 1 THEN '/notebook/' WHEN 2 THEN '/job/' WHEN 3 THEN '/openclaw/' WHEN 4 THEN '/software-examples/use/cae' WHEN 5 THEN '/software-examples/vasp' ELSE '/noun-a' END, url)"""


@query("ext8_url_category", f"WITH v AS (SELECT page_id, {EXT8_URL} AS u FROM pages) SELECT page_id, {_url_category_sql()} AS category_id FROM v")
def _(t):
    return t.read("pages").select("page_id", ux.url_category(F.expr(EXT8_URL)).alias("category_id"))


