"""Chat messages: cleaning, session predicates, transcripts and session summaries.

Messages stay in long form. Per-session answers come from partial aggregates and
bounded top-k steps, so one very long session never has to fit in one task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from talkweave import rules
from talkweave.functions import text as tx
from talkweave.functions import urls as ux
from talkweave.operators.ordering import collect_in_order, in_parts, running, top_rows, with_ordinal

KEY = ["session_id"]


@dataclass(frozen=True)
class MessageRules:
    """What counts as noise, politeness and substance for one language."""

    noise: list[str] | None = None
    polite: list[str] | None = None
    noise_min_chars: int = 2
    visitor_cjk: int = 5
    agent_cjk: int = 6
    score_min_chars: int = 10
    message_min_chars: int = 4
    answer_cjk: int = 8
    answer_pattern: str | None = None
    step_pattern: str = rules.STEP_WORDS_SESSION
    message_step_pattern: str = rules.STEP_WORDS_MESSAGE
    question_block: str = rules.ORDER_NOTICE
    block_list: str = rules.BLOCK_LIST
    categories: list = field(default_factory=lambda: rules.CATEGORIES)
    tags: list = field(default_factory=lambda: rules.TAGS)

    # The tests take content as ``clean_messages`` leaves it: without blanks at its ends.
    def is_noise(self, c: Column) -> Column:
        return tx.is_noise(c, self.noise, self.noise_min_chars, stripped=True)

    def is_polite(self, c: Column) -> Column:
        return tx.is_politeness_only(c, self.polite, stripped=True)

    def is_substantive(self, c: Column) -> Column:
        return ~self.is_noise(c) & ~self.is_polite(c) & (F.length(c) >= self.message_min_chars)


CHINESE = MessageRules()


def _order() -> list[Column]:
    return [F.col("created_at"), F.col("msg_id")]


def _slot() -> Column:
    """Hour slot: never decreases along (created_at, msg_id)."""
    return F.date_trunc("hour", F.col("created_at"))


def clean_messages(messages: DataFrame, r: MessageRules = CHINESE) -> DataFrame:
    """Agent and visitor messages with content that is neither noise nor flagged."""
    content = tx.strip(F.coalesce("content", F.lit("")))
    flagged = tx.strip(F.coalesce("sensitive_word", F.lit(""))) != ""
    # bound once, or the optimizer would repeat it in every test
    usable = tx.let(content, lambda s: (s != "") & ~r.is_noise(s))
    return (
        messages.filter(F.col("sender_type").isin(rules.AGENT_TYPE, rules.VISITOR_TYPE) & ~flagged & usable)
        .withColumn("content", content)
        .withColumn("role", tx.role_label(F.col("sender_type")))
    )


def min_messages(messages: DataFrame, n: int = 2) -> DataFrame:
    """Messages of sessions whose raw message count reaches ``n``."""
    big = messages.groupBy(*KEY).count().filter(F.col("count") >= n).select(*KEY)
    return messages.join(big, KEY, "left_semi")


def session_value_scores(cleaned: DataFrame, r: MessageRules = CHINESE, first_line_only: bool = False) -> DataFrame:
    """Per session: total substance and whether an agent message carries any.

    ``first_line_only`` counts messages with a line break as worthless, which is what
    a line-based transcript does.
    """
    c = F.col("content")
    usable = ~r.is_noise(c) & ~r.is_polite(c)
    if first_line_only:
        usable = usable & ~c.rlike("[\\n\\r]")
    score = F.when(usable, tx.substantive_score(F.col("role"), c, r.visitor_cjk, r.agent_cjk, r.score_min_chars)).otherwise(0)
    return cleaned.groupBy(*KEY).agg(
        F.sum(score).alias("score"),
        F.coalesce(F.bool_or((F.col("role") == rules.AGENT) & (score > 0)), F.lit(False)).alias("agent_answered"),
    )


def meaningful_sessions(cleaned: DataFrame, r: MessageRules = CHINESE, first_line_only: bool = False) -> DataFrame:
    """Cleaned messages of the sessions in which an agent gave a real answer."""
    keep = session_value_scores(cleaned, r, first_line_only).filter("agent_answered AND score >= 1").select(*KEY)
    return cleaned.join(keep, KEY, "left_semi")


def substantive_messages(cleaned: DataFrame, role: str, r: MessageRules = CHINESE) -> DataFrame:
    return cleaned.filter((F.col("role") == role) & r.is_substantive(F.col("content")))


def skip_sessions(cleaned: DataFrame, r: MessageRules = CHINESE, min_chars: int = 12) -> DataFrame:
    """Per session whether extraction should skip it, with the archived rules beside."""
    c, role = F.col("content"), F.col("role")
    agent, visitor = role == rules.AGENT, role == rules.VISITOR
    line = F.length(role) + 2 + F.length(c)
    g = cleaned.groupBy(*KEY).agg(
        (F.sum(line) + F.count(F.lit(1)) - 1).alias("chars"),
        F.count_if(agent).alias("agents"),
        F.count_if(visitor).alias("visitors"),
        F.bool_or(c.rlike(r.block_list)).alias("blocked"),
        F.bool_or(c.rlike(rules.ARCHIVE_BLOCK_LIST)).alias("blocked_archive"),
        F.bool_or(agent & c.rlike(rules.ARCHIVE_POINTER)).alias("pointer"),
        F.bool_and(~visitor | c.rlike(rules.ARCHIVE_DECLINE)).alias("declined"),
    )
    one_side = (F.col("agents") == 0) | (F.col("visitors") == 0)
    pointer_only = (F.col("agents") == 1) & F.col("pointer") & (F.col("visitors") <= 2) & F.col("declined")
    return g.select(
        *KEY, "chars", "agents", "visitors",
        ((F.col("chars") < min_chars) | one_side | F.col("blocked")).alias("skip"),
        ((F.col("chars") < 15) | one_side | F.col("blocked_archive") | pointer_only).alias("skip_archive"),
    )


def transcript(cleaned: DataFrame) -> DataFrame:
    """Messages with their 1-based place in the session."""
    return with_ordinal(cleaned, KEY, _order(), _slot(), "pos")


def session_headers(messages: DataFrame, cleaned: DataFrame) -> DataFrame:
    """One row per kept session: raw message count and time range over all its messages."""
    raw = messages.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("message_count"),
        F.min("created_at").alias("time_start"),
        F.max("created_at").alias("time_end"),
    )
    kept = cleaned.groupBy(*KEY).agg(F.count(F.lit(1)).alias("kept_count"))
    return raw.join(kept, KEY)


def session_links(cleaned: DataFrame) -> DataFrame:
    """Distinct links of a session in order of first sight: text links, then the file link of a message."""
    listed = F.concat(
        ux.extract_urls(F.col("content")),
        F.when(tx.strip(F.coalesce("file_url", F.lit(""))).startswith("http"), F.array(tx.strip(F.col("file_url"))))
        .otherwise(F.array().cast("array<string>")),
    )
    found = cleaned.select(*KEY, "created_at", "msg_id", F.posexplode(listed).alias("i", "url"))
    return found.groupBy(*KEY, "url").agg(F.min(F.struct("created_at", "msg_id", "i")).alias("first_seen"))


def build_sessions(messages: DataFrame, r: MessageRules = CHINESE, n_min: int = 2, first_line_only: bool = False) -> DataFrame:
    """Session headers for exports: long enough, cleaned and meaningful."""
    cleaned = meaningful_sessions(clean_messages(min_messages(messages, n_min), r), r, first_line_only)
    return session_headers(messages, cleaned)


def transcript_parts(cleaned: DataFrame, rows_per_part: int = 4096) -> DataFrame:
    """Transcripts as arrays, one row per ``rows_per_part`` messages."""
    parts = in_parts(transcript(cleaned), KEY, "pos", rows_per_part)
    packed = F.sort_array(F.collect_list(F.struct("pos", "role", "content", "created_at")))
    return parts.groupBy(*KEY, "part").agg(packed.alias("messages"))


def session_text(cleaned: DataFrame, max_chars: int = 12000, preview: int = 400,
                 link_sections: DataFrame | None = None) -> DataFrame:
    """``role: text`` lines up to ``max_chars``, link section appended, and a preview.

    Only lines that start before the cap are gathered, so the row stays bounded.
    """
    line = F.concat("role", F.lit(": "), "content")
    counted = running(
        cleaned.withColumn("_line", line), KEY, _order(), _slot(), {"_end": ("sum", F.length("_line") + 1), "pos": ("count", None)})
    start = F.col("_end") - F.length("_line") - 1
    body = collect_in_order(counted.filter(start < max_chars).withColumn("_line", F.substring("_line", 1, max_chars)), KEY, "pos", "_line", "_lines")
    body = body.withColumn("_text", F.array_join("_lines", "\n"))
    if link_sections is not None:
        body = body.join(link_sections, KEY, "left")
        extra = F.concat(F.lit("\n\n[链接与附件内容]\n"), F.substring("link_section", 1, 6000))
        body = body.withColumn("_text", F.concat("_text", F.when(F.coalesce("link_section", F.lit("")) != "", extra).otherwise("")))
    return body.select(*KEY, F.substring("_text", 1, max_chars).alias("text"), F.substring("_text", 1, preview).alias("preview"))


# --- session summaries --------------------------------------------------------------

def first_and_last(cleaned: DataFrame, r: MessageRules = CHINESE) -> DataFrame:
    """First visitor question and the last two agent replies, from one scan and one ranking."""
    c, agent = F.col("content"), F.col("role") == rules.AGENT
    at = F.unix_micros(F.col("created_at").cast("timestamp"))
    rows = cleaned.filter(r.is_substantive(c)).select(
        *KEY, "content", agent.alias("_agent"), F.when(agent, -at).otherwise(at).alias("_a"),
        F.when(agent, -F.col("msg_id")).otherwise(F.col("msg_id")).alias("_b"))
    top = top_rows(rows, [*KEY, "_agent"], [F.col("_a"), F.col("_b")], 2, "_n")
    replies = F.sort_array(F.collect_list(F.when(F.col("_agent"), F.struct(-F.col("_n"), "content"))))
    return top.groupBy(*KEY).agg(
        F.max(F.when(~F.col("_agent") & (F.col("_n") == 1), c)).alias("ask"),
        F.transform(replies, lambda x: x["content"]).alias("replies"))


def _tag_list(found: list, cap: int = 6) -> Column:
    tags = F.array_compact(F.array(*[F.when(F.col(f"_t{i}"), F.lit(tag)) for i, (tag, _) in enumerate(found)]))
    return F.slice(tags, 1, cap)


def value_band(message_count: Column, agent_count: Column, link_chars: Column) -> Column:
    return (
        F.when(link_chars > 200, "high")
        .when((message_count >= 15) | (agent_count >= 4), "high")
        .when((message_count >= 6) | (agent_count >= 2), "medium")
        .otherwise("low")
    )


def session_summary(messages: DataFrame, cleaned: DataFrame, r: MessageRules = CHINESE,
                    link_sections: DataFrame | None = None) -> DataFrame:
    """Title, summary, value band, tags, key points and procedure points of each session."""
    c = F.col("content")
    raw = messages.groupBy(*KEY).agg(F.count(F.lit(1)).alias("message_count"))
    found = [(tag, F.bool_or(F.lower("content").rlike(tx.any_of(patterns)))) for tag, patterns in r.tags]
    flags = cleaned.groupBy(*KEY).agg(
        F.count_if((F.col("role") == rules.AGENT) & r.is_substantive(c)).alias("agent_count"),
        *[test.alias(f"_t{i}") for i, (_, test) in enumerate(found)])
    picks = first_and_last(cleaned, r)
    out = flags.withColumn("tags", _tag_list(found)).join(raw, KEY).join(picks, KEY, "left")
    if link_sections is None:
        out = out.withColumn("link_section", F.lit(""))
    else:
        out = out.join(link_sections, KEY, "left").withColumn("link_section", F.coalesce("link_section", F.lit("")))
    base = F.coalesce(tx.truncate_text(F.col("ask"), 36), F.lit("客服会话"))
    first_tag = F.get("tags", F.lit(0))
    asked = F.concat(F.lit("访客诉求："), tx.truncate_text(F.col("ask"), 80))
    handled = F.when(F.size("replies") > 0, F.concat(F.lit("客服处理："), tx.truncate_text(F.array_join("replies", "；"), 120)))
    linked = F.when(F.contains("link_section", F.lit("http")), F.lit("会话含内联文档/教程链接，详见下方摘录或原始会话附件区。"))
    summary = F.array_join(F.array_compact(F.array(asked, handled, linked)), " ")
    out = out.select(
        *KEY, "message_count", F.coalesce("agent_count", F.lit(0)).alias("agent_count"), "tags",
        F.when(first_tag.isNotNull(), F.concat(base, F.lit("（"), first_tag, F.lit("）"))).otherwise(base).alias("title"),
        F.coalesce(F.nullif(summary, F.lit("")), F.lit("会话含客服与访客实质交流。")).alias("summary"),
        value_band(F.col("message_count"), F.coalesce("agent_count", F.lit(0)), F.length("link_section")).alias("value"),
    )
    return out.join(key_points(cleaned, r), KEY, "left").join(procedure_points(cleaned, r), KEY, "left")


def key_points(cleaned: DataFrame, r: MessageRules = CHINESE, cap: int = 8) -> DataFrame:
    """Visitor points, then agent points, distinct by their first 40 characters."""
    said = cleaned.filter(r.is_substantive(F.col("content"))).select(
        *KEY, "created_at", "msg_id", (F.col("role") == rules.AGENT).alias("side"),
        F.concat("role", F.lit("："), tx.truncate_text(F.col("content"), 100)).alias("point"))
    return _distinct_points(said, 40, cap, "key_points")


def procedure_points(cleaned: DataFrame, r: MessageRules = CHINESE, cap: int = 6) -> DataFrame:
    """Agent messages that describe steps or give links, distinct by their first 30 characters."""
    c = F.col("content")
    steps = substantive_messages(cleaned, rules.AGENT, r).filter(c.rlike(f"(?iu){r.step_pattern}") | (F.size(ux.extract_urls(c)) > 0))
    rows = steps.select(*KEY, "created_at", "msg_id", F.lit(True).alias("side"), tx.truncate_text(c, 120).alias("point"))
    return _distinct_points(rows, 30, cap, "procedure_points")


def _distinct_points(rows: DataFrame, key_chars: int, cap: int, name: str) -> DataFrame:
    seen = rows.groupBy(*KEY, F.substring("point", 1, key_chars).alias("_k")).agg(
        F.min(F.struct("side", "created_at", "msg_id", "point")).alias("_f"))
    top = top_rows(seen, KEY, [F.col("_f")], cap, "_n").withColumn("point", F.col("_f.point"))
    return collect_in_order(top, KEY, "_n", "point", name)


def tag_value_overview(summaries: DataFrame, top: int = 12) -> DataFrame:
    """Sessions per value band, and the most frequent tags."""
    bands = summaries.groupBy(F.lit("value").alias("kind"), F.col("value").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    tags = summaries.select(F.explode("tags").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    best = tags.orderBy(F.desc("n"), "name").limit(top).select(F.lit("tag").alias("kind"), "name", "n")
    return bands.unionByName(best)


def pending_extractions(sessions: DataFrame, done: DataFrame, limit: int = 0) -> DataFrame:
    """Sessions in name order (optional limit first) that have no extraction yet."""
    picked = sessions.orderBy("session_id").limit(limit) if limit > 0 else sessions
    return picked.join(done.select(*KEY), KEY, "left_anti").withColumn("preview", F.substring("preview", 1, 200))


def extraction_stats(sessions: DataFrame, extractions: DataFrame) -> DataFrame:
    """Total, written, skipped and failed sessions of one extraction run."""
    joined = sessions.select(*KEY).join(extractions.select(*KEY, "skip", F.lit(True).alias("_has")), KEY, "left")
    return joined.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("_has") & ~F.col("skip")).alias("written"),
        F.count_if(F.col("_has") & F.col("skip")).alias("skipped"),
        F.count_if(F.col("_has").isNull()).alias("errors"),
    )


