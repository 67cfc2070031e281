"""Turn decisions over an event table: the batch form of the streaming operators.

Events carry session_id, turn_id, event_id (arrival order), type, event_time, seq, text.
Decisions come from first-event aggregates joined back, not from per-key loops, so one
busy session or turn spreads over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from talkweave import rules
from talkweave.operators.audit import metric_histogram
from talkweave.operators.ordering import id_bucket, running

TURN = ["session_id", "turn_id"]
ARRIVAL = ["event_time", "event_id"]


def _arrival() -> Column:
    return F.struct(*ARRIVAL)


def _slot() -> Column:
    return F.date_trunc("hour", F.col("event_time"))


def generation_id(turn: Column) -> Column:
    return F.concat(F.lit("g_"), turn)


def commit_once(events: DataFrame) -> DataFrame:
    """Every commit request with its outcome: the first of a turn is committed, later ones rejected."""
    commits = events.filter("type = 'turn_commit_request'")
    first = commits.groupBy(*TURN).agg(F.min(_arrival()).alias("_first"))
    joined = commits.join(first, TURN)
    won = _arrival() == F.col("_first")
    return joined.select(
        *TURN, "event_id", "event_time", F.when(won, "turn_committed").otherwise("turn_rejected").alias("outcome"),
        F.when(won, generation_id(F.col("turn_id"))).alias("generation_id"), F.when(~won, "ALREADY_COMMITTED").alias("error_code"))


def turn_bounds(events: DataFrame) -> DataFrame:
    """Per turn: first commit, and the first cancel after it (the one that takes effect).

    Where events have a ``generation_id``, a cancel that names another generation has no effect.
    """
    if "generation_id" in events.columns:
        events = events.filter((F.col("type") != "cancel") | F.col("generation_id").isNull() | (F.col("generation_id") == generation_id(F.col("turn_id"))))
    commits = events.filter("type = 'turn_commit_request'").groupBy(*TURN).agg(F.min(_arrival()).alias("commit"))
    cancels = events.filter("type = 'cancel'").select(*TURN, _arrival().alias("_c")).join(commits, TURN).filter(F.col("_c") > F.col("commit"))
    first = cancels.groupBy(*TURN).agg(F.min("_c").alias("cancel"))
    return commits.join(first, TURN, "left")


def match_cancels(events: DataFrame, claimed: Column | None = None) -> DataFrame:
    """Every cancel with its acknowledgement: true for the first one while the generation is active.

    ``claimed`` is the generation a cancel names; by default it names the turn's own.
    """
    own = generation_id(F.col("turn_id"))
    named = events.withColumn("_named", own if claimed is None else claimed)
    cols = [*TURN, *ARRIVAL, "type", "_named"]
    cancels = named.filter("type = 'cancel'").select(*cols)
    effective = cancels.filter(F.col("_named") == own)
    bounds = turn_bounds(named.filter("type = 'turn_commit_request'").select(*cols).unionByName(effective))
    return cancels.join(bounds, TURN, "left").select(
        *TURN, "event_id", "event_time", F.col("_named").alias("generation_id"),
        F.coalesce((F.col("_named") == own) & (_arrival() == F.col("cancel")), F.lit(False)).alias("cancelled"))


def suppress_cancelled(events: DataFrame) -> DataFrame:
    """Deltas of an active generation: after the turn's commit and before its cancel."""
    deltas = events.filter("type = 'llm_delta'")
    kept = deltas.join(turn_bounds(events), TURN).filter(
        (_arrival() > F.col("commit")) & (F.col("cancel").isNull() | (_arrival() < F.col("cancel"))))
    return kept.drop("commit", "cancel")


def state_changes(events: DataFrame) -> DataFrame:
    """Events that change a session's state, with the new state."""
    bounds = turn_bounds(events)
    at = _arrival()
    joined = events.join(bounds, TURN, "left")
    alive = (at > F.col("commit")) & (F.col("cancel").isNull() | (at < F.col("cancel")))
    new = (
        F.when((F.col("type") == "turn_commit_request") & (at == F.col("commit")), "thinking")
        .when((F.col("type") == "cancel") & (at == F.col("cancel")), "interrupted")
        .when((F.col("type") == "llm_delta") & alive, "speaking")
        .when((F.col("type") == "audio_complete") & alive, "listening"))
    return joined.withColumn("new_state", new).drop("commit", "cancel")


def session_state(events: DataFrame) -> DataFrame:
    """State of the session after each event; sessions start listening."""
    changes = state_changes(events).withColumn("_s", F.when(F.col("new_state").isNotNull(), F.struct("event_time", "event_id", "new_state")))
    out = running(changes, ["session_id"], [F.col(c) for c in ARRIVAL], _slot(), {"_last": ("max", F.col("_s"))})
    return out.select("session_id", "event_id", "type", F.coalesce("_last.new_state", F.lit("listening")).alias("state"))


def final_states(events: DataFrame) -> DataFrame:
    """Current state of each session."""
    last = state_changes(events).groupBy("session_id").agg(F.max(F.when(F.col("new_state").isNotNull(), F.struct("event_time", "event_id", "new_state"))).alias("_l"))
    return last.select("session_id", F.coalesce("_l.new_state", F.lit("listening")).alias("state"))


def seq_gaps(events: DataFrame) -> DataFrame:
    """Per event of a turn: duplicate, out-of-order or after-a-gap sequence number."""
    before = running(events, TURN, [F.col(c) for c in ARRIVAL], _slot(), {"_max": ("max", F.col("seq"))}, inclusive=False)
    first = events.groupBy(*TURN, "seq").agg(F.min(_arrival()).alias("_f"))
    joined = before.join(first, [*TURN, "seq"])
    flag = (
        F.when(_arrival() != F.col("_f"), "duplicate").when(F.col("seq") < F.col("_max"), "out_of_order")
        .when(F.col("seq") > F.coalesce("_max", F.lit(-1)) + 1, F.when(F.col("_max").isNull(), "ok").otherwise("gap")).otherwise("ok"))
    return joined.select(*TURN, "event_id", "seq", flag.alias("flag"))


def assemble_turn_text(events: DataFrame, rows_per_part: int = 4096) -> DataFrame:
    """Assistant text of each committed turn with latencies and status; partial text is kept on cancel.

    Turns with more deltas than a part holds continue in further parts.
    """
    bounds = turn_bounds(events)
    kept = suppress_cancelled(events)
    placed = running(kept, TURN, [F.col("seq"), F.col("event_id")], id_bucket("seq"), {"pos": ("count", None)})
    parts = placed.withColumn("part", F.floor((F.col("pos") - 1) / rows_per_part))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "")
    body = parts.groupBy(*TURN, "part").agg(text.alias("assistant_text"))
    first = kept.groupBy(*TURN).agg(F.min("event_time").alias("_first"))
    done = events.filter("type = 'audio_complete'").join(bounds, TURN).filter(
        (_arrival() > F.col("commit")) & (F.col("cancel").isNull() | (_arrival() < F.col("cancel")))).groupBy(*TURN).agg(F.min("event_time").alias("_done"))
    meta = bounds.join(first, TURN, "left").join(done, TURN, "left")

    def ms(c: str) -> Column:
        return F.unix_millis(c) - F.unix_millis("commit.event_time")

    out = meta.join(body, TURN, "left")
    end = F.coalesce(F.col("_done"), F.col("cancel.event_time"))
    out = out.withColumn("_end", end)
    status = F.when(F.col("_done").isNotNull(), "ok").when(F.col("cancel").isNotNull(), "cancelled").otherwise("open")
    return out.select(*TURN, F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("assistant_text", F.lit("")).alias("assistant_text"),
                      F.coalesce(ms("_first"), F.lit(0)).alias("llm_first_token_ms"), ms("_end").alias("latency_ms_e2e"), status.alias("status"))


def stream_segments(deltas: DataFrame, max_run: int = 120, boundaries: str = rules.SEGMENT_BOUNDARIES) -> DataFrame:
    """Speakable segments of each turn from its deltas, with increasing chunk index.

    Deltas are cut at boundary marks; a running count of marks says which segment a
    piece belongs to, so a turn's text is never gathered whole. A run without a mark is cut
    at ``max_run`` characters as soon as a delta brings it there, so what is cut before the delta
    with the mark is a multiple of ``max_run``.
    """
    group = "".join("\\" + ch if ch in "[]()" else ch for ch in boundaries)
    pieces = deltas.select(*TURN, "seq", "event_id", F.posexplode(F.regexp_extract_all("text", F.lit(f"[^{group}]*[{group}]|[^{group}]+"), F.lit(0))).alias("i", "piece"))
    order = [F.col("seq"), F.col("event_id"), F.col("i")]
    ends = F.col("piece").rlike(f"[{group}]\\z").cast("int")
    counted = running(pieces, TURN, order, id_bucket("seq"), {"segment": ("sum", ends)}, inclusive=False)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "event_id", "i", "piece"))), lambda x: x["piece"]), "")
    whole = counted.groupBy(*TURN, "segment").agg(joined.alias("text"), F.sum(F.when(ends == 1, 0).otherwise(F.length("piece"))).cast("int").alias("_before"))
    at = F.floor(F.col("_before") / max_run).cast("int") * max_run
    runs = F.regexp_extract_all(F.substring(F.col("text"), F.lit(1), at), F.lit(f"(?s).{{{max_run}}}"), F.lit(0))
    cut = F.concat(runs, F.array(F.substring(F.col("text"), at + 1, F.length("text"))))
    from talkweave.functions.text import strip

    out = whole.select(*TURN, "segment", F.posexplode(cut).alias("cut", "piece")).withColumn("text", strip(F.col("piece"))).filter("text <> ''")
    slot = F.floor(F.col("segment") / 65536)
    return running(out, TURN, [F.col("segment"), F.col("cut")], slot, {"chunk_index": ("count", None)}).select(
        *TURN, (F.col("chunk_index") - 1).alias("chunk_index"), "text")


def speech_segments(frames: DataFrame, threshold: float = 0.018, silence: str = "650 milliseconds") -> DataFrame:
    """Speech segments from levelled frames (session_id, event_time, level).

    A voiced frame opens or extends a segment; silence of the given length closes it.
    Works on streams too, where a watermark closes segments.
    """
    voiced = frames.filter(F.col("level") >= threshold)
    return voiced.groupBy("session_id", F.session_window("event_time", silence).alias("w")).agg(F.count(F.lit(1)).alias("frames")).select(
        "session_id", F.col("w.start").alias("speech_start"), F.col("w.end").alias("speech_end"), "frames")


def asr_latest(events: DataFrame) -> DataFrame:
    """Latest recognised text per turn; a final text beats every partial one."""
    return events.groupBy(*TURN).agg(
        F.max_by("text", F.struct((F.col("type") == "asr_final").alias("f"), F.col("seq"), F.col("event_id"))).alias("text"),
        F.bool_or(F.col("type") == "asr_final").alias("is_final"), F.count(F.lit(1)).alias("updates"))


def asr_stamped(events: DataFrame, opens: Column, results: Column) -> DataFrame:
    """Recognised texts with the turn their session opened last, at or before them; before any, their own.

    An as-of join as one pass: openings and results stand in one order, and the last opening is carried
    over time slots, so that a long session spreads over all tasks.
    """
    opened = F.when(opens, F.struct(*ARRIVAL, F.col("turn_id").alias("turn")))
    marked = events.filter(opens | results).withColumn("_o", opened).withColumn("_result", results)
    carried = running(marked, ["session_id"], [F.col(c) for c in ARRIVAL], _slot(), {"_last": ("max", F.col("_o"))})
    return carried.filter("_result").withColumn("turn_id", F.coalesce("_last.turn", "turn_id")).drop("_o", "_last", "_result")


def turn_metrics(events: DataFrame, width: str = "1 minute", slide: str | None = None) -> DataFrame:
    """Commits, turns committed, duplicate commits and their rate, cancels, completions and errors per time window.

    Counted exactly, per turn first.
    """
    kind = F.col("type")
    per_turn = events.groupBy(F.window("event_time", width, slide or width).alias("w"), *TURN).agg(
        F.count_if(kind == "turn_commit_request").alias("commits"), F.count_if(kind == "cancel").alias("cancels"),
        F.count_if(kind == "audio_complete").alias("completed"), F.count_if(kind == "error").alias("errors"), F.count(F.lit(1)).alias("events"))
    sums = per_turn.groupBy("w").agg(*[F.sum(c).alias(c) for c in ("commits", "cancels", "completed", "errors", "events")], F.count_if(F.col("commits") > 0).alias("turns"))
    twice = F.col("commits") - F.col("turns")
    return sums.select(F.col("w.start").alias("window_start"), "commits", "turns", twice.alias("duplicates"),
                       F.when(F.col("commits") > 0, twice / F.col("commits")).otherwise(0.0).alias("duplicate_rate"), "cancels", "completed", "errors", "events")


def latency_windows(turns: DataFrame, width: str = "1 minute") -> DataFrame:
    """Latency histogram per window and input mode."""
    label = F.concat_ws("|", F.date_format(F.window("created_at", width)["start"], "yyyy-MM-dd HH:mm"), "input_mode")
    return metric_histogram(turns.withColumn("_label", label), F.col("latency_ms_e2e"), rules.TURN_DURATION_BUCKETS, F.col("_label"))


def active_connections(events: DataFrame, opens: Column, closes: Column) -> DataFrame:
    """Gauge after each open or close, in arrival order over all sessions."""
    change = F.when(opens, 1).when(closes, -1)
    marked = events.withColumn("change", change).filter("change IS NOT NULL").withColumn("_all", F.lit(0))
    return running(marked, ["_all"], [F.col(c) for c in ARRIVAL], _slot(), {"active": ("sum", F.col("change"))}).select("event_id", "event_time", "active")


def thread_history(turns: DataFrame, greeting: str) -> DataFrame:
    """Messages of each session in order, one row each; the greeting comes first where it is missing.

    Cancelled turns keep the text that was emitted.
    """
    rows = turns.select("session_id", F.col("id").alias("turn"), F.posexplode(F.array(
        F.struct(F.lit("user").alias("role"), F.col("user_text").alias("text")),
        F.struct(F.lit("assistant").alias("role"), F.trim("assistant_text").alias("text")))).alias("side", "m")).select(
        "session_id", "turn", "side", F.col("m.role").alias("role"), F.col("m.text").alias("text")).filter("text <> ''")
    greeted = rows.filter((F.col("role") == "assistant") & (F.trim("text") == greeting)).select("session_id").distinct()
    missing = rows.select("session_id").distinct().join(greeted, "session_id", "left_anti").select(
        "session_id", F.lit(-1).cast("bigint").alias("turn"), F.lit(1).alias("side"), F.lit("assistant").alias("role"), F.lit(greeting).alias("text"))
    return missing.unionByName(rows)


def turns_from_events(events: DataFrame, users: DataFrame) -> DataFrame:
    """Turns for :func:`thread_history` straight from events: a cancelled turn has the text that was emitted before
    its cancel, and none if nothing was.

    ``users``: session_id, turn_id, id, user_text. Turns without a commit are left out.
    """
    parts = assemble_turn_text(events)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "assistant_text"))), lambda x: x["assistant_text"]), "")
    whole = parts.groupBy(*TURN).agg(text.alias("assistant_text"), F.max("status").alias("status"))
    return users.join(whole, TURN).select("session_id", "id", "user_text", "assistant_text", "status")


def audit_rows(turns: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One audit row per finished turn, however often it was delivered; known turns are left out."""
    first = turns.groupBy(*TURN).agg(F.min("id").alias("id"))
    rows = turns.join(first, [*TURN, "id"], "left_semi")
    return rows if existing is None else rows.join(existing.select(*TURN), TURN, "left_anti")
