"""Event streams: parsing, validation and windowed measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from talkweave.functions import text as tx

EVENT_SCHEMA = (
    "type string, session_id string, turn_id string, seq bigint, trace_id string, timestamp_ms bigint, reason string, input_mode string, "
    "audio_base64 string, codec string, sample_rate_hz int, channels int, chunk_ms int, generation_id string, event string, text string"
)
INBOUND = ["turn_commit_request", "audio_chunk", "cancel", "vad_event"]


def parse_voice_events(raw: DataFrame, column: str = "value") -> DataFrame:
    """Typed events from JSON text with defaults filled and a reason for every invalid one."""
    e = raw.withColumn("_e", F.from_json(column, EVENT_SCHEMA)).select(F.col(column).alias("raw"), "_e.*")
    kind = F.col("type")

    def lacks(c: str) -> Column:
        return F.col(c).isNull()

    base = lacks("session_id") | lacks("turn_id") | lacks("trace_id") | F.coalesce(F.col("seq") < 0, F.lit(True)) | F.coalesce(F.col("timestamp_ms") < 0, F.lit(True))
    invalid = (
        base
        | ((kind == "turn_commit_request") & (lacks("reason") | ~F.coalesce("input_mode", F.lit("voice")).isin("voice", "text")))
        | ((kind == "cancel") & lacks("generation_id"))
        | ((kind == "audio_chunk") & lacks("audio_base64"))
        | ((kind == "vad_event") & ~F.coalesce("event", F.lit("")).isin("speech_start", "speech_end")))
    problem = (
        F.when(~F.coalesce(kind, F.lit("")).isin(INBOUND), "INVALID_EVENT")
        .when(invalid, "PROCESSING_FAILED")
        .when((kind == "turn_commit_request") & (tx.strip(F.col("reason")) == ""), "EMPTY_USER_TEXT"))
    audio = kind == "audio_chunk"
    return e.withColumns({
        "problem": problem,
        "input_mode": F.when(kind == "turn_commit_request", F.coalesce("input_mode", F.lit("voice"))),
        "codec": F.when(audio, F.coalesce("codec", F.lit("pcm_s16le"))),
        "sample_rate_hz": F.when(audio, F.coalesce("sample_rate_hz", F.lit(16000))),
        "channels": F.when(audio, F.coalesce("channels", F.lit(1))),
        "chunk_ms": F.when(audio, F.coalesce("chunk_ms", F.lit(100))),
        "reason": F.when(kind == "cancel", F.coalesce("reason", F.lit("barge_in"))).otherwise(F.col("reason")),
        "audio": F.try_to_binary("audio_base64", F.lit("base64")),
        "event_time": F.timestamp_millis("timestamp_ms"),
    })


def valid_events(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("problem").isNull()).drop("problem", "raw")


def quarantine(parsed: DataFrame) -> DataFrame:
    """Invalid events with their whole body, which may have any fields; null where the text is no JSON."""
    return parsed.filter(F.col("problem").isNotNull()).select("raw", "problem", "session_id", "turn_id", F.try_parse_json("raw").alias("body"))


def body_fields(df: DataFrame, fields: dict[str, tuple[str, str]], body: str = "body") -> DataFrame:
    """Add typed fields of open bodies: name to (path, type); null where a body lacks the path or has another type."""
    return df.withColumns({name: F.try_variant_get(F.col(body), path, kind) for name, (path, kind) in fields.items()})


def read_voice_events(spark: SparkSession, path: str) -> DataFrame:
    """Stream of parsed events from a folder of JSON lines."""
    return parse_voice_events(spark.readStream.text(path))


def accepted_commits(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """First commit of each turn on a stream; state ends with the watermark."""
    commits = events.filter("type = 'turn_commit_request'")
    return commits.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["session_id", "turn_id"])


def suppress_cancelled_stream(deltas: DataFrame, cancels: DataFrame, horizon: str, delay: str = "1 minute") -> DataFrame:
    """Deltas whose generation was not cancelled before them.

    ``deltas``: generation_id, event_time, ...; ``cancels``: effective cancels with
    generation_id, cancel_time. Emitted when the watermark rules out an earlier cancel.
    ``horizon`` is the longest time between a cancel and a delta it must still hold back.
    """
    d = deltas.withWatermark("event_time", delay).alias("d")
    c = cancels.withWatermark("cancel_time", delay).alias("c")
    same = F.expr(f"d.generation_id = c.generation_id AND c.cancel_time <= d.event_time AND c.cancel_time >= d.event_time - INTERVAL {horizon}")
    return d.join(c, same, "left_outer").filter("c.generation_id IS NULL").select("d.*")


def stream_turn_text(deltas: DataFrame, gap: str, delay: str = "1 minute") -> DataFrame:
    """Assembled text of a turn once no delta can follow (session window on the turn;
    a pause longer than ``gap`` ends it)."""
    rows = F.sort_array(F.collect_list(F.struct("seq", "text")))
    return deltas.withWatermark("event_time", delay).groupBy("session_id", "turn_id", F.session_window("event_time", gap).alias("w")).agg(
        F.array_join(F.transform(rows, lambda x: x["text"]), "").alias("assistant_text"), F.min("event_time").alias("first_delta_at"), F.count(F.lit(1)).alias("deltas"))
