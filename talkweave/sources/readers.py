"""Readers: files and tables to the operators' input shapes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from talkweave import rules
from talkweave.functions import links as lk
from talkweave.functions import text as tx
from talkweave.functions import urls as ux

TURN_SCHEMA = (
    "id bigint, trace_id string, session_id string, turn_id string, input_mode string, user_text string, assistant_text string, "
    "wiki_sources array<string>, retrieval_notes array<string>, tool_called boolean, agent_thread_id string, latency_ms_e2e int, "
    "llm_first_token_ms int, status string, error_code string, created_at timestamp"
)


# --- chat exports ---------------------------------------------------------------------

def checked_chat_rows(raw: DataFrame) -> DataFrame:
    """Rows of an export whose fields are text, typed, with a ``problem`` for those that cannot be used.

    ``NO_SESSION``: blank id; ``BAD_TIME``, ``BAD_SENDER``: a value that is no time or whole number;
    ``NO_CONTENT``: null content. The text of a bad field stays in ``bad_value``. Nothing is nulled silently: good
    rows are ``problem IS NULL``, the others go to whoever mends the export.
    """
    df = _renamed_chat(raw)
    when, sender = F.col("created_at").try_cast("timestamp"), F.col("sender_type").try_cast("int")
    no_session = F.coalesce(tx.strip(F.col("session_id").cast("string")), F.lit("")) == ""
    bad_time, bad_sender = when.isNull(), sender.isNull() & F.col("sender_type").isNotNull()
    problem = (F.when(no_session, "NO_SESSION").when(bad_time, "BAD_TIME").when(bad_sender, "BAD_SENDER").when(F.col("content").isNull(), "NO_CONTENT"))
    bad = F.when(no_session, F.col("session_id").cast("string")).when(bad_time, F.col("created_at").cast("string")).when(bad_sender, F.col("sender_type").cast("string"))
    return df.withColumns({"problem": problem, "bad_value": bad, "created_at": when, "sender_type": sender})


def normalize_chat_columns(df: DataFrame) -> DataFrame:
    """Rename known export headers; an alias counts only where the canonical header is absent."""
    return _renamed_chat(df).withColumn("sender_type", F.col("sender_type").cast("int"))


def _renamed_chat(df: DataFrame) -> DataFrame:
    canonical = {v: k for k, v in rules.CHAT_COLUMNS.items()}
    names = {c: canonical[c] for c in df.columns if c in canonical}
    for alias, target in rules.CHAT_ALIASES.items():
        if alias in df.columns and target not in names.values():
            names[alias] = target
    if "sender_type" not in names.values():
        prefixed = [c for c in df.columns if c.startswith(rules.CHAT_COLUMNS["sender_type"])]
        if prefixed:
            names[prefixed[0]] = "sender_type"
    df = df.withColumnsRenamed({k: v for k, v in names.items() if k != v})
    missing = [c for c in ("session_id", "content", "created_at") if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; got {df.columns}")
    for name, kind in (("sender_type", "int"), ("file_url", "string"), ("sensitive_word", "string")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    if "msg_id" not in df.columns:
        df = df.withColumn("msg_id", F.xxhash64("session_id", "created_at", "content"))
    return df.select("session_id", "msg_id", "sender_type", "content", "created_at", "file_url", "sensitive_word")


def read_chat_messages(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    if fmt == "csv":
        options = {"header": "true", "multiLine": "true", "escape": '"', **options}
    return normalize_chat_columns(spark.read.format(fmt).options(**options).load(path))


# --- Markdown documents -----------------------------------------------------------------

def read_markdown(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """One row per file: path and whole text."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("text"),
                        F.col("_metadata.file_size").alias("file_size"))


def file_stem(path: Column) -> Column:
    return ux.unquote(F.regexp_replace(F.regexp_extract(path, "[^/]*\\z", 0), "\\.[^.]*\\z", ""))


def front_matter(c: Column) -> Column:
    """Front matter as a map: text before the first colon names the value, quotes dropped."""
    block = F.regexp_extract(c, "(?s)\\A---(.*?)---", 1)
    pairs = F.filter(tx.lines(block), lambda s: F.contains(s, F.lit(":")))
    entries = F.transform(
        pairs,
        lambda s: F.struct(
            tx.strip(F.regexp_extract(s, "^([^:]*):", 1)).alias("key"),
            F.regexp_replace(tx.strip(F.regexp_extract(s, "^[^:]*:(.*)", 1)), "^\"+|\"+\\z", "").alias("value"),
        ),
    )
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.aggregate(
        entries, empty,
        lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.create_map(e["key"], e["value"])))


def body_after_front_matter(c: Column) -> Column:
    return F.regexp_replace(c, "(?s)\\A---.*?---", "")


TRANSCRIPT_LINE = "^- \\[([^\\]]+)\\] \\*\\*([^*]+)\\*\\*: (.+)$"


def parse_session_docs(files: DataFrame) -> DataFrame:
    """Session documents: metadata map, transcript array and link section.

    Lines between the dialogue heading and the next second-level heading are the
    transcript; everything after the link heading is the link section.
    """
    body = body_after_front_matter(F.col("text"))
    dialog = F.regexp_extract(body, f"(?ms)^\\s*{rules.DIALOG_HEADING}\\s*?$\\n(.*?)(?=^## |\\z)", 1)
    section = F.regexp_extract(body, f"(?ms)^\\s*{rules.LINK_HEADING}\\s*?$\\n?(.*)\\z", 1)
    rows = F.filter(F.transform(tx.lines(dialog), tx.strip), lambda s: s.rlike(TRANSCRIPT_LINE))
    packed = F.transform(
        rows,
        lambda s, i: F.struct(
            (i + 1).alias("pos"),
            F.regexp_extract(s, TRANSCRIPT_LINE, 2).alias("role"),
            tx.strip(F.regexp_extract(s, TRANSCRIPT_LINE, 3)).alias("content"),
            F.regexp_extract(s, TRANSCRIPT_LINE, 1).alias("ts"),
        ),
    )
    meta = front_matter(F.col("text"))
    named = F.regexp_replace(file_stem(F.col("file_path")), "^session_", "")
    return files.select(
        "file_path",
        F.coalesce(F.try_element_at(meta, F.lit("session_id")), named).alias("session_id"),
        meta.alias("meta"),
        packed.alias("transcript"),
        tx.strip(section).alias("link_section"),
    )


def read_session_docs(spark: SparkSession, path: str) -> DataFrame:
    return parse_session_docs(read_markdown(spark, path, "session_*.md"))


def session_messages(docs: DataFrame) -> DataFrame:
    """Session documents back in message form for the message operators."""
    return docs.select("session_id", F.explode("transcript").alias("m")).select(
        "session_id", F.col("m.pos").alias("msg_id"), F.col("m.role").alias("role"), F.col("m.content").alias("content"),
        F.to_timestamp("m.ts").alias("created_at"), F.lit(None).cast("string").alias("file_url"))


def parse_wiki_pages(files: DataFrame, root: str) -> DataFrame:
    """Wiki pages with relative path, stem, page type and heading title."""
    base = re.sub("^file:/+", "/", root.rstrip("/")) + "/"
    full = F.regexp_replace(ux.unquote(F.col("file_path")), "^file:/+", "/")
    rel = F.replace(full, F.lit(base), F.lit(""))
    stem = F.regexp_replace(F.regexp_extract(rel, "[^/]*\\z", 0), "\\.md\\z", "")
    return files.select(
        rel.alias("rel_path"), F.regexp_replace(rel, "\\.md\\z", "").alias("page_id"), stem.alias("stem"),
        lk.page_type(rel).alias("page_type"), lk.heading_title(F.col("text"), stem).alias("title"), "text")


def read_wiki_pages(spark: SparkSession, root: str) -> DataFrame:
    return parse_wiki_pages(read_markdown(spark, root), root)


def parse_web_docs(files: DataFrame) -> DataFrame:
    """Crawled pages: repaired text, front-matter fields, title fallback to the first heading."""
    fixed = tx.repair_mojibake(F.col("text"))
    meta, body = front_matter(fixed), tx.strip(body_after_front_matter(fixed))

    def field(name: str) -> Column:
        return tx.normalize_text(F.try_element_at(meta, F.lit(name)))

    listed = tx.clean_page_title(field("title"))
    heading = tx.clean_page_title(F.regexp_extract(body, "(?m)^#\\s+(.+)$", 1))
    stem = file_stem(F.col("file_path"))
    site = ux.unquote(F.regexp_extract("file_path", "([^/]*)/[^/]*\\z", 1))
    return files.select(
        "file_path", "file_size",
        F.when(listed != "", listed).otherwise(heading).alias("title"),
        tx.normalize_text(body).alias("content"),
        field("source_url").alias("source_url"),
        field("fetched_at").alias("fetched_at"),
        F.coalesce(F.nullif(field("filename_core"), F.lit("")), stem).alias("core_name"),
        site.alias("source_site"),
    )


def read_web_docs(spark: SparkSession, path: str) -> DataFrame:
    return parse_web_docs(read_markdown(spark, path))


# --- JSON documents ------------------------------------------------------------------------

EXTRACTION_SCHEMA = (
    "skip boolean, summary string, category_id string, category_title string, category string, question string, "
    "question_variants array<string>, answer string, steps array<string>, tags array<string>, related_wikilinks array<string>"
)


def drop_code_fence(c: Column) -> Column:
    return F.regexp_replace(tx.strip(c), "(?im)^```(?:json)?\\s*|\\s*```$", "")


def parse_extractions(files: DataFrame, categories: list | None = None) -> DataFrame:
    """Extraction JSON per session; unreadable and skipped files are left out.

    The category falls back from id to title to the dictionary match of the text.
    """
    from talkweave.operators.rulematch import best_category, category_rules

    categories = rules.CATEGORIES if categories is None else categories
    raw = drop_code_fence(F.col("text"))
    parsed = files.select(file_stem(F.col("file_path")).alias("session_id"), F.from_json(raw, EXTRACTION_SCHEMA).alias("e"))
    parsed = parsed.select("session_id", "e.*").filter(~F.coalesce("skip", F.lit(False)))
    # a malformed file parses to a row of NULLs
    parsed = parsed.filter(F.coalesce("question", "answer", "summary", "category_id").isNotNull())
    by_title = F.lit(None).cast("string")
    for cid, title, _ in categories:
        by_title = F.when(F.col("category_title") == title, cid).otherwise(by_title)
    known = F.when(F.col("category").isin([c[0] for c in categories]), F.col("category"))
    inferred = best_category(F.concat(F.coalesce("question", F.lit("")), F.coalesce("answer", F.lit(""))), category_rules(categories))
    return parsed.withColumn("category_id", F.coalesce(F.nullif("category_id", F.lit("")), by_title, known, inferred)).drop("category")


def read_extractions(spark: SparkSession, path: str, categories: list | None = None) -> DataFrame:
    return parse_extractions(read_markdown(spark, path, "*.json"), categories)


def attach_sessions(extractions: DataFrame, sessions: DataFrame) -> DataFrame:
    """Join extractions to sessions on the id that file names carry."""
    keyed = sessions.withColumn("_sid", tx.extraction_session_id(F.concat(F.lit("session_"), "session_id"))).drop("session_id")
    return extractions.join(keyed, extractions["session_id"] == keyed["_sid"]).drop("_sid")


TAXONOMY_SCHEMA = (
    "source string, categories array<struct<id:string,title:string,overview:string>>, "
    "concepts array<struct<id:string,title:string,definition:string,related_doc_indices:array<double>>>, "
    "assignments array<struct<source_url:string,doc_index:string,category_id:string>>, "
    "doc_enrichments array<struct<source_url:string,summary:string,related_concept_ids:array<string>,"
    "related_doc_urls:array<string>,related_urls:array<string>>>"
)


def parse_taxonomy(raw: DataFrame) -> dict[str, DataFrame]:
    """Four tables of a taxonomy document; ids sanitised, blank ids dropped."""
    def items(name: str) -> DataFrame:
        return raw.select(F.posexplode(name).alias("ord", "i")).select("ord", "i.*")

    cats = items("categories").withColumn("id", tx.taxonomy_id(F.coalesce("id", F.lit("")))).filter("id <> ''")
    title = tx.strip(F.coalesce("title", "id"))
    cats = cats.select("ord", "id", title.alias("title"), F.coalesce(F.nullif(tx.strip(F.coalesce("overview", F.lit(""))), F.lit("")), title).alias("overview"))
    fallback = raw.limit(1).select(F.lit(0).alias("ord"), F.lit("general").alias("id"), F.lit("通用文档").alias("title"),
                                   F.lit("未单独归类的文档。").alias("overview"))
    has_any = cats.agg(F.count(F.lit(1)))
    cats = cats.unionByName(fallback.filter(has_any.scalar() == 0))
    concepts = items("concepts").withColumn("id", tx.taxonomy_id(F.coalesce("id", F.lit("")))).filter("id <> ''").select(
        "ord", "id", tx.strip(F.coalesce("title", "id")).alias("title"), tx.strip(F.coalesce("definition", F.lit(""))).alias("definition"),
        F.transform(F.coalesce("related_doc_indices", F.array().cast("array<double>")), lambda x: x.cast("bigint")).alias("related_doc_indices"))
    assigned = items("assignments").withColumn("category_id", tx.strip(F.coalesce("category_id", F.lit("")))).filter("category_id <> ''").select(
        "ord", F.nullif(tx.strip("source_url"), F.lit("")).alias("source_url"), F.col("doc_index").try_cast("bigint").alias("doc_index"), "category_id")
    enriched = items("doc_enrichments").select(
        "ord", tx.strip(F.coalesce("source_url", F.lit(""))).alias("source_url"), tx.strip(F.coalesce("summary", F.lit(""))).alias("summary"),
        "related_concept_ids", F.coalesce("related_doc_urls", "related_urls", F.array().cast("array<string>")).alias("related_doc_urls"),
    ).filter("source_url <> ''")
    return {"categories": cats, "concepts": concepts, "assignments": assigned, "doc_enrichments": enriched}


def read_taxonomy(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    files = read_markdown(spark, path, "*.json")
    return parse_taxonomy(files.select(F.from_json(drop_code_fence(F.col("text")), TAXONOMY_SCHEMA).alias("j")).select("j.*"))


GRAPH_SCHEMA = "edges array<struct<`from`:string,`to`:string,confidence:double>>"


def parse_graph_edges(raw: DataFrame) -> DataFrame:
    return raw.select(F.explode("edges").alias("e")).select(
        F.col("e.from").alias("src"), F.col("e.to").alias("dst"), F.coalesce("e.confidence", F.lit(0.0)).alias("confidence"))


def read_graph_edges(spark: SparkSession, path: str) -> DataFrame:
    return parse_graph_edges(spark.read.schema(GRAPH_SCHEMA).json(path, multiLine=True))


# --- tables -----------------------------------------------------------------------------------

def with_audit_defaults(turns: DataFrame) -> DataFrame:
    """Fill the column that older turn tables lack."""
    if "llm_first_token_ms" not in turns.columns:
        turns = turns.withColumn("llm_first_token_ms", F.lit(0))
    return turns.withColumn("llm_first_token_ms", F.coalesce("llm_first_token_ms", F.lit(0)))


def read_audit_turns(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Turn table from files, or from a database with ``fmt='jdbc'`` and its options."""
    reader = spark.read.format(fmt).options(**options)
    return with_audit_defaults(reader.load() if fmt == "jdbc" else reader.load(path))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("page_id", "url", "html")
