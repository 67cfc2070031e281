"""Shape general tables (conversations, events, pages, documents) into operator inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from talkweave.functions import text as tx
from talkweave.functions import urls as ux
from talkweave.session import configure


class Tables:
    """Lazy access to the Parquet tables of one folder, with the operator shapes on top."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = configure(spark)
        self.folder = folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # --- conversations ----------------------------------------------------------
    def chat_messages(self) -> DataFrame:
        start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
        return self.read("conversations").select(
            F.col("conv_id").alias("session_id"),
            F.col("turn").alias("msg_id"),
            F.when(F.col("role") == "user", 2).when(F.col("role") == "assistant", 1).otherwise(3).alias("sender_type"),
            F.col("text").alias("content"),
            (start + F.make_dt_interval(hours=F.col("conv_id").cast("int"), mins=F.col("turn").cast("int"))).alias("created_at"),
            F.lit(None).cast("string").alias("file_url"),
            F.lit(None).cast("string").alias("sensitive_word"),
        )

    # --- events -----------------------------------------------------------------
    def event_k(self) -> DataFrame:
        return self.read("events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))

    def audit_turns(self) -> DataFrame:
        kind, k = F.col("event_type"), F.col("k")
        none = F.array().cast("array<string>")
        return self.event_k().select(
            F.col("event_id").alias("id"),
            F.concat(F.lit("tr"), "event_id").alias("trace_id"),
            F.concat(F.lit("s"), "user_id").alias("session_id"),
            F.concat(F.lit("t"), "event_id").alias("turn_id"),
            F.when(k % 2 == 0, "text").otherwise("voice").alias("input_mode"),
            F.concat(F.lit("q"), k).alias("user_text"),
            F.concat(F.lit("a"), k).alias("assistant_text"),
            F.when(kind == "view", F.array(F.concat(F.lit("faqs/"), k))).otherwise(none).alias("wiki_sources"),
            F.when(k < 50, F.array(F.lit("index_match"))).otherwise(F.array(F.lit("global_scan"))).alias("retrieval_notes"),
            kind.isin("view", "purchase").alias("tool_called"),
            F.concat(F.lit("s"), "user_id").alias("agent_thread_id"),
            F.floor(F.col("value") * 10).cast("int").alias("latency_ms_e2e"),
            F.when(kind == "signup", 0).otherwise(F.floor(F.col("value") * 3).cast("int")).alias("llm_first_token_ms"),
            F.when(kind == "error", "error").when(kind == "signup", "cancelled").otherwise("ok").alias("status"),
            F.when(kind == "error", "ORCHESTRATOR_FAILED").alias("error_code"),
            F.col("ts").cast("timestamp").alias("created_at"),
        )

    def voice_events(self) -> DataFrame:
        """Turn events; ``seq`` is the payload counter, ``event_id`` the arrival order."""
        kind = F.col("event_type")
        return self.event_k().select(
            "event_id",
            F.concat(F.lit("s"), "user_id").alias("session_id"),
            F.concat(F.lit("t"), F.floor(F.col("k") / 4)).alias("turn_id"),
            F.col("k").alias("seq"),
            F.when(kind == "click", "turn_commit_request").when(kind == "error", "cancel").when(kind == "view", "llm_delta")
            .when(kind == "purchase", "audio_complete").otherwise("vad_event").alias("type"),
            F.concat(F.lit("w"), "k", F.when(F.col("k") % 5 == 0, "，").otherwise("")).alias("text"),
            F.col("ts").cast("timestamp").alias("event_time"),
            F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"),
        )

    # --- pages ------------------------------------------------------------------
    def page_links(self) -> DataFrame:
        """One row per ``href`` in document order: (page_id, url, pos, href)."""
        hrefs = F.regexp_extract_all("html", F.lit("href=\"([^\"]*)\""), F.lit(1))
        return self.read("pages").select("page_id", "url", F.posexplode(hrefs).alias("pos", "href"))

    def link_edges(self) -> DataFrame:
        """Edges by link hash: neighbours, a few hub pages, and targets that do not exist."""
        h = F.conv(F.substring(F.md5("href"), 1, 4), 16, 10).cast("bigint")
        dst = (
            F.when(h % 5 == 0, -1 - h % 7)
            .when(h % 4 == 0, h % 3)
            .otherwise(F.col("page_id") + h % 41 - 16)
        )
        return self.page_links().select(
            F.col("page_id").alias("src"), dst.alias("dst"), F.lit("md").alias("kind"), F.col("pos").cast("bigint").alias("pos"))

    def page_nodes(self) -> DataFrame:
        kind = F.when(F.col("page_id") % 3 == 0, "category").when(F.col("page_id") % 3 == 1, "concept").otherwise("faq")
        return self.read("pages").select(F.col("page_id").alias("stem"), kind.alias("page_type"))

    def page_titles(self) -> DataFrame:
        return self.read("pages").select(
            "page_id", "url", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), "html")

    # --- documents --------------------------------------------------------------
    def docs(self) -> DataFrame:
        return self.read("documents").select(
            "doc_id",
            tx.first_line(F.col("text")).alias("title"),
            F.col("text").alias("content"),
            F.concat(F.lit("doc://"), "source", F.lit("/"), "doc_id").alias("source_url"),
            F.col("source").alias("source_site"),
            F.col("lang"),
        )

    def faq_items(self) -> DataFrame:
        none = F.array().cast("array<string>")
        return self.read("documents").select(
            F.col("doc_id").alias("ord"),
            F.substring(tx.first_line(F.col("text")), 1, 200).alias("question"),
            F.col("text").alias("answer"),
            F.col("lang").alias("category_id"),
            F.array(F.col("source")).alias("variants"),
            F.transform(F.slice(F.split("text", "\n"), 2, 2), lambda s: F.substring(s, 1, 60)).alias("steps"),
            none.alias("links"),
            F.array("source", "lang").alias("tags"),
            none.alias("related_wikilinks"),
            F.lit(1).cast("bigint").alias("source_count"),
            F.lit("").alias("file_name"),
        )

    def questions(self) -> DataFrame:
        return self.read("benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))

    def wiki_pages(self) -> DataFrame:
        """Documents laid out as knowledge pages with links, for the page operators."""
        return self.read("documents").select(*wiki_columns())


def _h() -> str:
    return "cast(conv(substr(md5(cast(doc_id as string)),1,4),16,10) as bigint)"


WIKI_TYPE = "CASE WHEN doc_id % 10 = 0 THEN 'category' WHEN doc_id % 10 = 1 THEN 'concept' ELSE 'faq' END"


def wiki_stem(n: str) -> str:
    """Stem of page number ``n``; the prefix follows the page type."""
    return (f"concat(CASE WHEN ({n}) % 10 = 0 THEN '分类-' WHEN ({n}) % 10 = 1 THEN '概念-' ELSE '问答-' END, "
            f"CAST({n} AS {{STR}}))")


WIKI_TEXT = (
    "concat('---\ntype: ', {type}, '\ncategory: \"[[分类-', CAST(doc_id - doc_id % 10 AS {STR}), ']]\"\n"
    "source_count: ', CAST(1 + doc_id % 4 AS {STR}), '\n---\n\n# ', lang, ' ', source, ' ', CAST(doc_id AS {STR}), '\n\n',"
    " '## 客户问法\n\n- ', source, '\n- ', lang, '\n\n## 标准回答\n\n', text,"
    " '\n\n## 操作步骤\n1. ', source, '\n2. ', lang, '\n\n## 相关\n- [[', {near}, ']]\n- [[', {hub}, '|hub]]\n- [[ ', {spaced},"
    " ' ]]\n- [x](faqs/', {near}, '.md#a)\n', CASE WHEN {h} % 3 = 0 THEN '```\n[[代码-1]]\n```\n' ELSE '' END,"
    " CASE WHEN doc_id % 10 = 0 AND {h} % 2 = 0 THEN '## 主题内问答总结\n' ELSE '' END)"
)


def wiki_text_sql(h: str, string_type: str) -> str:
    near = wiki_stem(f"doc_id + {h} % 9 - 4")
    hub = wiki_stem(f"{h} % 10")
    spaced = wiki_stem(f"doc_id + {h} % 5 - 2")
    text = WIKI_TEXT.format(type=WIKI_TYPE, near=near, hub=hub, spaced=spaced, h=h, STR="{STR}")
    return text.replace("{STR}", string_type)


def wiki_columns() -> list[Column]:
    stem = wiki_stem("doc_id").replace("{STR}", "string")
    folder = "CASE WHEN doc_id % 10 = 0 THEN 'categories/' WHEN doc_id % 10 = 1 THEN 'concepts/' ELSE 'faqs/' END"
    return [
        F.col("doc_id").alias("ord"),
        F.expr(f"concat({folder}, {stem}, '.md')").alias("rel_path"),
        F.expr(stem).alias("stem"),
        F.expr(WIKI_TYPE).alias("page_type"),
        F.expr(wiki_text_sql(_h(), "string")).alias("text"),
    ]


# --- the same shapes as SQL for cross-checking ------------------------------------
CHAT_SQL = """chat AS (
  SELECT conv_id AS session_id, turn AS msg_id,
         CASE role WHEN 'user' THEN 2 WHEN 'assistant' THEN 1 ELSE 3 END AS sender_type,
         CASE role WHEN 'user' THEN '访客' WHEN 'assistant' THEN '客服' ELSE '系统' END AS role,
         text AS content,
         TIMESTAMP '2024-01-01' + to_hours(conv_id) + to_minutes(turn) AS created_at
  FROM conversations)"""
AUDIT_SQL = """ek AS (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events),
audit AS (
  SELECT event_id AS id, concat('tr', event_id) AS trace_id, concat('s', user_id) AS session_id,
         concat('t', event_id) AS turn_id, CASE WHEN k % 2 = 0 THEN 'text' ELSE 'voice' END AS input_mode,
         concat('q', k) AS user_text, concat('a', k) AS assistant_text,
         CASE WHEN event_type = 'view' THEN [concat('faqs/', k)] ELSE CAST([] AS VARCHAR[]) END AS wiki_sources,
         CASE WHEN k < 50 THEN ['index_match'] ELSE ['global_scan'] END AS retrieval_notes,
         event_type IN ('view', 'purchase') AS tool_called,
         CAST(floor(value * 10) AS INTEGER) AS latency_ms_e2e,
         CASE WHEN event_type = 'signup' THEN 0 ELSE CAST(floor(value * 3) AS INTEGER) END AS llm_first_token_ms,
         CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'cancelled' ELSE 'ok' END AS status,
         CASE event_type WHEN 'error' THEN 'ORCHESTRATOR_FAILED' END AS error_code,
         ts AS created_at
  FROM ek)"""
VOICE_SQL = """ek AS (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events),
voice AS (
  SELECT event_id, concat('s', user_id) AS session_id, concat('t', k // 4) AS turn_id, k AS seq,
         CASE event_type WHEN 'click' THEN 'turn_commit_request' WHEN 'error' THEN 'cancel' WHEN 'view' THEN 'llm_delta'
              WHEN 'purchase' THEN 'audio_complete' ELSE 'vad_event' END AS type,
         concat('w', k, CASE WHEN k % 5 = 0 THEN '，' ELSE '' END) AS text, ts AS event_time, epoch_us(ts) // 1000 AS timestamp_ms
  FROM ek)"""
LINKS_SQL = """hrefs AS (
  SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href,
         generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) - 1 AS pos FROM pages),
hh AS (SELECT *, ('0x' || substr(md5(href), 1, 4))::BIGINT AS h FROM hrefs),
edges AS (
  SELECT page_id AS src, CASE WHEN h % 5 = 0 THEN -1 - h % 7 WHEN h % 4 = 0 THEN h % 3 ELSE page_id + h % 41 - 16 END AS dst,
         'md' AS kind, pos FROM hh),
nodes AS (
  SELECT page_id AS stem, CASE page_id % 3 WHEN 0 THEN 'category' WHEN 1 THEN 'concept' ELSE 'faq' END AS page_type FROM pages)"""
DOCS_SQL = """docs AS (
  SELECT doc_id, regexp_extract(text, '^[^\\n]*') AS title, text AS content,
         concat('doc://', source, '/', doc_id) AS source_url, source AS source_site, lang FROM documents)"""
FAQ_SQL = """faq AS (
  SELECT doc_id AS ord, substr(regexp_extract(text, '^[^\\n]*'), 1, 200) AS question, text AS answer, lang AS category_id,
         [source] AS variants, list_transform(string_split(text, chr(10))[2:3], lambda s: substr(s, 1, 60)) AS steps,
         [source, lang] AS tags, 1 AS source_count FROM documents)"""
_DH = "(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 4))::BIGINT)"
WIKI_SQL = (
    "wiki AS (SELECT doc_id AS ord, concat(CASE WHEN doc_id % 10 = 0 THEN 'categories/' WHEN doc_id % 10 = 1 THEN 'concepts/' "
    f"ELSE 'faqs/' END, {wiki_stem('doc_id')}, '.md') AS rel_path, {wiki_stem('doc_id')} AS stem, {WIKI_TYPE} AS page_type, "
).replace("{STR}", "VARCHAR") + wiki_text_sql(_DH, "VARCHAR") + " AS text FROM documents)"
