"""Turn and stream decisions over the events table (batch form)."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkweave import rules
from talkweave.functions.sound import rms
from talkweave.operators import sketches as sk
from talkweave.operators import turns as tn
from talkweave.operators.audit import barge_in_delays
from talkweave.plans.registry import query
from talkweave.sources.adapters import AUDIT_SQL, VOICE_SQL
from talkweave.streaming.events import body_fields, parse_voice_events, quarantine

# (event_time, event_id) as one ordered value
AT = "(epoch_us(event_time)::HUGEINT * 1000000000 + event_id)"
BOUNDS = f"""{VOICE_SQL}, v AS (SELECT *, {AT} AS arr FROM voice),
co AS (SELECT session_id, turn_id, min(arr) AS c FROM v WHERE type = 'turn_commit_request' GROUP BY 1, 2),
ca AS (SELECT v.session_id, v.turn_id, min(arr) AS x FROM v JOIN co USING (session_id, turn_id) WHERE type = 'cancel' AND arr > c GROUP BY 1, 2),
b AS (SELECT co.*, x FROM co LEFT JOIN ca USING (session_id, turn_id)),
j AS (SELECT v.*, c, x, coalesce(arr > c AND (x IS NULL OR arr < x), FALSE) AS alive FROM v LEFT JOIN b USING (session_id, turn_id))"""
W = f"WITH {BOUNDS} "


@query("str1_commit_once", W + """SELECT session_id, turn_id, event_id, CASE WHEN arr = c THEN 'turn_committed' ELSE 'turn_rejected' END AS outcome,
 CASE WHEN arr = c THEN 'g_' || turn_id END AS generation_id, CASE WHEN arr <> c THEN 'ALREADY_COMMITTED' END AS error_code FROM j WHERE type = 'turn_commit_request'""")
def _(t):
    return tn.commit_once(t.voice_events()).drop("event_time")


@query("str2_match_cancels", W + "SELECT session_id, turn_id, event_id, 'g_' || turn_id AS generation_id, coalesce(arr = x, FALSE) AS cancelled FROM j WHERE type = 'cancel'")
def _(t):
    return tn.match_cancels(t.voice_events()).drop("event_time")


@query("str3_suppress_cancelled", W + "SELECT session_id, turn_id, event_id, text FROM j WHERE type = 'llm_delta' AND alive")
def _(t):
    return tn.suppress_cancelled(t.voice_events()).select("session_id", "turn_id", "event_id", "text")


STATE = """, s AS (SELECT *, CASE WHEN type = 'turn_commit_request' AND arr = c THEN 'thinking' WHEN type = 'cancel' AND arr = x THEN 'interrupted'
 WHEN type = 'llm_delta' AND alive THEN 'speaking' WHEN type = 'audio_complete' AND alive THEN 'listening' END AS ns FROM j) """


@query("str4_session_state", W + STATE + """SELECT session_id, event_id, type, coalesce(last_value(ns IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY arr ROWS UNBOUNDED PRECEDING), 'listening') AS state FROM s""")
def _(t):
    return tn.session_state(t.voice_events())


@query("str4b_final_states", W + STATE + "SELECT session_id, coalesce(arg_max(ns, arr) FILTER (ns IS NOT NULL), 'listening') AS state FROM s GROUP BY 1")
def _(t):
    return tn.final_states(t.voice_events())


@query("str5_seq_gaps", W + """, m AS (SELECT *, max(seq) OVER (PARTITION BY session_id, turn_id ORDER BY arr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mx, row_number() OVER (PARTITION BY session_id, turn_id, seq ORDER BY arr) AS rn FROM v)
SELECT session_id, turn_id, event_id, seq, CASE WHEN rn > 1 THEN 'duplicate' WHEN seq < mx THEN 'out_of_order' WHEN mx IS NOT NULL AND seq > mx + 1 THEN 'gap' ELSE 'ok' END AS flag FROM m""")
def _(t):
    return tn.seq_gaps(t.voice_events())


TURN_TEXT = W + """, d AS (SELECT session_id, turn_id, string_agg(text, '' ORDER BY seq, event_id) AS assistant_text, min(event_time) AS f FROM j WHERE type = 'llm_delta' AND alive GROUP BY 1, 2),
dn AS (SELECT session_id, turn_id, min(event_time) AS e FROM j WHERE type = 'audio_complete' AND alive GROUP BY 1, 2),
ct AS (SELECT session_id, turn_id, max(CASE WHEN arr = c THEN event_time END) AS ct, max(CASE WHEN arr = x THEN event_time END) AS xt FROM j GROUP BY 1, 2)
SELECT b.session_id, b.turn_id, 0::BIGINT AS part, coalesce(assistant_text, '') AS assistant_text, coalesce((epoch_us(f) // 1000) - (epoch_us(ct) // 1000), 0) AS llm_first_token_ms, (epoch_us(coalesce(e, xt)) // 1000) - (epoch_us(ct) // 1000) AS latency_ms_e2e,
 CASE WHEN e IS NOT NULL THEN 'ok' WHEN xt IS NOT NULL THEN 'cancelled' ELSE 'open' END AS status
FROM b LEFT JOIN d USING (session_id, turn_id) LEFT JOIN dn USING (session_id, turn_id) LEFT JOIN ct USING (session_id, turn_id)"""


@query("str6_assemble_turn_text", TURN_TEXT)
def _(t):
    return tn.assemble_turn_text(t.voice_events())


@query("str7_stream_segments", f"""WITH {VOICE_SQL}, d AS (SELECT session_id, turn_id, string_agg(text, '' ORDER BY seq, event_id) AS x FROM voice WHERE type = 'llm_delta' GROUP BY 1, 2),
p AS (SELECT session_id, turn_id, unnest(regexp_extract_all(x, '[^，]*，|[^，]{{1,120}}')) AS text, generate_subscripts(regexp_extract_all(x, '[^，]*，|[^，]{{1,120}}'), 1) - 1 AS chunk_index FROM d)
SELECT session_id, turn_id, chunk_index, text FROM p""")
def _(t):
    return tn.stream_segments(t.voice_events().filter("type = 'llm_delta'"))


@query("str8_speech_segments", f"""WITH {VOICE_SQL}, f AS (SELECT session_id, ts AS event_time FROM events JOIN voice USING (event_id) WHERE value >= 30),
g AS (SELECT *, CASE WHEN event_time >= lag(event_time) OVER (PARTITION BY session_id ORDER BY event_time) + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS brk FROM f),
i AS (SELECT *, sum(brk) OVER (PARTITION BY session_id ORDER BY event_time ROWS UNBOUNDED PRECEDING) AS grp FROM g)
SELECT session_id, epoch_us(min(event_time)) AS speech_start, epoch_us(max(event_time) + INTERVAL 2 HOUR) AS speech_end, count(*) AS frames FROM i GROUP BY session_id, grp""")
def _(t):
    level = F.col("value") / 1000.0
    frames = t.voice_events().join(t.read("events").select("event_id", level.alias("level")), "event_id")
    out = tn.speech_segments(frames, 0.03, "2 hours")
    return out.withColumn("speech_start", F.unix_micros("speech_start")).withColumn("speech_end", F.unix_micros("speech_end"))


@query("str8b_frame_levels", "SELECT event_id, round(least(floor(value * 60), 32767) / 32768.0::DOUBLE, 6) AS level FROM events")
def _(t):
    # the value of an event, repeated as 16-bit samples, stands for a frame of sound
    n = F.least(F.floor(F.col("value") * 60), F.lit(32767)).cast("int")
    low, high = F.lpad(F.hex(F.pmod(n, F.lit(256))), 2, "0"), F.lpad(F.hex(F.floor(n / 256).cast("int")), 2, "0")
    pcm = F.unhex(F.repeat(F.concat(low, high), F.lit(160)))
    return t.read("events").select("event_id", F.round(rms(pcm), 6).alias("level"))


@query("str9_asr_latest", f"""WITH {VOICE_SQL} SELECT session_id, turn_id, arg_max(text, (CASE WHEN type = 'audio_complete' THEN 1 ELSE 0 END)::HUGEINT * 1000000000000 + seq::HUGEINT * 10000000 + event_id) AS text,
 bool_or(type = 'audio_complete') AS is_final, count(*) AS updates FROM voice WHERE type IN ('llm_delta', 'audio_complete') GROUP BY 1, 2""")
def _(t):
    kind = F.when(F.col("type") == "audio_complete", "asr_final").otherwise("asr_partial")
    return tn.asr_latest(t.voice_events().filter("type IN ('llm_delta', 'audio_complete')").withColumn("type", kind))


@query("str9b_latest_turn", f"""WITH {VOICE_SQL}, l AS (SELECT *, last_value(CASE WHEN type = 'vad_event' THEN turn_id END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY event_time, event_id ROWS UNBOUNDED PRECEDING) AS opened FROM voice)
SELECT session_id, event_id, text, coalesce(opened, turn_id) AS turn_id FROM l WHERE type IN ('llm_delta', 'audio_complete')""")
def _(t):
    kind = F.col("type")
    return tn.asr_stamped(t.voice_events(), kind == "vad_event", kind.isin("llm_delta", "audio_complete")).select("session_id", "event_id", "text", "turn_id")


@query("str10_turn_metrics", f"""WITH {VOICE_SQL} SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, event_time)) AS window_start, count(*) FILTER (type = 'turn_commit_request') AS commits,
 count(DISTINCT session_id || '|' || turn_id) FILTER (type = 'turn_commit_request') AS turns,
 count(*) FILTER (type = 'turn_commit_request') - count(DISTINCT session_id || '|' || turn_id) FILTER (type = 'turn_commit_request') AS duplicates,
 CASE WHEN count(*) FILTER (type = 'turn_commit_request') > 0 THEN (count(*) FILTER (type = 'turn_commit_request') - count(DISTINCT session_id || '|' || turn_id) FILTER (type = 'turn_commit_request'))::DOUBLE
   / count(*) FILTER (type = 'turn_commit_request') ELSE 0.0::DOUBLE END AS duplicate_rate,
 count(*) FILTER (type = 'cancel') AS cancels, count(*) FILTER (type = 'audio_complete') AS completed, count(*) FILTER (type = 'error') AS errors, count(*) AS events FROM voice GROUP BY 1""")
def _(t):
    return tn.turn_metrics(t.voice_events(), "6 hours").withColumn("window_start", F.unix_micros("window_start"))


@query("str10b_latency_windows", f"""WITH {AUDIT_SQL}, x AS (SELECT strftime(date_trunc('day', created_at), '%Y-%m-%d %H:%M') || '|' || input_mode AS label, latency_ms_e2e AS v FROM audit)
""" + " UNION ALL ".join(f"SELECT label, {float(b)!r}::DOUBLE AS le, count(*) FILTER (v <= {b * 1000.0!r}) AS cumulative, count(*) AS n, CAST(sum(v) AS BIGINT) AS sum_ms FROM x GROUP BY 1" for b in rules.TURN_DURATION_BUCKETS)
       + " UNION ALL SELECT label, 'inf'::DOUBLE, count(*), count(*), CAST(sum(v) AS BIGINT) FROM x GROUP BY 1")
def _(t):
    return tn.latency_windows(t.audit_turns(), "1 day")


GROWTH = "((1 + 0.01::DOUBLE) / (1 - 0.01::DOUBLE))"


def sketch_sql(rows: str, keys: str) -> str:
    """Quantiles of log buckets over ``rows`` (keys, v) as SQL."""
    est = ", ".join(f"round(CASE WHEN min(bucket) FILTER (upto > floor({p}::DOUBLE * (total - 1))) = -2147483648 THEN 0.0 ELSE "
                    f"pow({GROWTH}, min(bucket) FILTER (upto > floor({p}::DOUBLE * (total - 1)))) * (2 / ({GROWTH} + 1)) END, 6) AS p{round(p * 100)}" for p in (0.5, 0.95, 0.99))
    return f"""r AS ({rows}), s AS (SELECT {keys}, CASE WHEN v > 0 THEN ceil(ln(v) / ln({GROWTH})) ELSE -2147483648 END AS bucket, count(*) AS n FROM r WHERE v IS NOT NULL GROUP BY ALL),
 c AS (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {keys}) AS total FROM s)
SELECT {keys}, max(total)::BIGINT AS n, {est} FROM c GROUP BY {keys}"""


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if c[0] == "p" and c[1:].isdigit() else c for c in df.columns])


@query("agg15d_latency_sketch", f"WITH {AUDIT_SQL}, " + sketch_sql("SELECT input_mode, latency_ms_e2e::DOUBLE AS v FROM audit", "input_mode"))
def _(t):
    return _rounded(sk.sketch_quantiles(sk.log_sketch(t.audit_turns(), ["input_mode"], "latency_ms_e2e"), ["input_mode"], [0.5, 0.95, 0.99]))


@query("str10d_sliding_latency", f"WITH {AUDIT_SQL}, " + sketch_sql(
    "SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, created_at) + INTERVAL 6 HOUR * (1 + k)) AS window_end, latency_ms_e2e::DOUBLE AS v FROM audit, range(4) AS i(k)", "window_end"))
def _(t):
    found = sk.sketch_quantiles(sk.sliding_sketches(t.audit_turns(), "created_at", "latency_ms_e2e", "6 hours", 4), ["window_end"], [0.5, 0.95, 0.99])
    return _rounded(found).withColumn("window_end", F.unix_micros("window_end"))


@query("agg15e_barge_in_delays", W + """, d AS (SELECT session_id, turn_id, max(arr) AS last, arg_max(event_time, arr) AS said FROM j WHERE type = 'llm_delta' GROUP BY 1, 2),
xs AS (SELECT session_id, turn_id, x, max(CASE WHEN arr = x THEN event_time END) AS xt FROM j WHERE x IS NOT NULL GROUP BY 1, 2, 3)
SELECT session_id, turn_id, CASE WHEN last > x THEN (epoch_us(said) // 1000) - (epoch_us(xt) // 1000) ELSE 0 END AS stop_ms FROM xs LEFT JOIN d USING (session_id, turn_id)""")
def _(t):
    return barge_in_delays(t.voice_events())


@query("str10c_active_connections", f"""WITH {VOICE_SQL} SELECT event_id, CAST(sum(CASE type WHEN 'vad_event' THEN 1 ELSE -1 END) OVER (ORDER BY event_time, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS active FROM voice WHERE type IN ('vad_event', 'cancel')""")
def _(t):
    return tn.active_connections(t.voice_events(), F.col("type") == "vad_event", F.col("type") == "cancel").select("event_id", "active")


@query("str11_thread_history", f"""WITH {AUDIT_SQL} SELECT session_id, -1::BIGINT AS turn, 1 AS side, 'assistant' AS role, 'a7' AS text FROM audit GROUP BY 1 HAVING NOT bool_or(assistant_text = 'a7')
UNION ALL SELECT session_id, id, 0, 'user', user_text FROM audit UNION ALL SELECT session_id, id, 1, 'assistant', assistant_text FROM audit""")
def _(t):
    return tn.thread_history(t.audit_turns(), "a7")


@query("str11b_history_of_events", TURN_TEXT.replace("SELECT b.session_id, b.turn_id, 0::BIGINT AS part", ", tt AS (SELECT b.session_id, b.turn_id, 0::BIGINT AS part", 1) + """),
u AS (SELECT session_id, turn_id, min(event_id) AS id, 'q' || min(event_id) AS user_text FROM voice GROUP BY 1, 2),
h AS (SELECT session_id, id, user_text, assistant_text FROM tt JOIN u USING (session_id, turn_id))
SELECT session_id, -1::BIGINT AS turn, 1 AS side, 'assistant' AS role, 'hello' AS text FROM h GROUP BY 1
UNION ALL SELECT session_id, id, 0, 'user', user_text FROM h UNION ALL SELECT session_id, id, 1, 'assistant', assistant_text FROM h WHERE assistant_text <> ''""")
def _(t):
    events = t.voice_events()
    users = events.groupBy("session_id", "turn_id").agg(F.min("event_id").alias("id")).withColumn("user_text", F.concat(F.lit("q"), "id"))
    return tn.thread_history(tn.turns_from_events(events, users), "hello")


@query("str12_audit_rows", f"WITH {VOICE_SQL} SELECT session_id, turn_id, min(event_id) AS id FROM voice WHERE type = 'audio_complete' GROUP BY 1, 2")
def _(t):
    done = t.voice_events().filter("type = 'audio_complete'").withColumnRenamed("event_id", "id")
    return tn.audit_rows(done).select("session_id", "turn_id", "id")


@query("src9_voice_events", f"""WITH {VOICE_SQL} SELECT event_id, CASE WHEN type IN ('llm_delta', 'audio_complete') THEN 'INVALID_EVENT' WHEN seq % 10 = 0 THEN 'PROCESSING_FAILED'
 WHEN type = 'turn_commit_request' AND seq % 7 = 0 THEN 'EMPTY_USER_TEXT' END AS problem, CASE type WHEN 'turn_commit_request' THEN 'voice' END AS input_mode FROM voice""")
def _(t):
    n = F.col("seq")
    body = F.to_json(F.struct(
        "type", "session_id", "turn_id", F.when(n % 10 == 0, -1).otherwise(n).alias("seq"), F.lit("tr").alias("trace_id"), "timestamp_ms",
        F.when(n % 7 == 0, "  ").otherwise(F.col("text")).alias("reason"), F.concat(F.lit("g_"), "turn_id").alias("generation_id"),
        F.lit("speech_start").alias("event"), F.col("event_id").cast("string").alias("text")))
    return parse_voice_events(t.voice_events().select(body.alias("value"))).select(F.col("text").cast("bigint").alias("event_id"), "problem", "input_mode")


@query("src9b_quarantine", f"""WITH {VOICE_SQL} SELECT event_id, 'INVALID_EVENT' AS problem, CASE WHEN seq % 9 = 0 THEN NULL ELSE type END AS kind, CASE WHEN seq % 9 <> 0 AND seq % 2 = 0 THEN seq END AS depth,
 CASE WHEN seq % 9 <> 0 THEN text END AS tag, seq % 9 <> 0 AS whole FROM voice WHERE type IN ('llm_delta', 'audio_complete', 'vad_event')""")
def _(t):
    # Events of unknown types with a nested body; of some the text is cut off, of some a field has another type.
    events = t.voice_events().filter("type IN ('llm_delta', 'audio_complete', 'vad_event')")
    n = F.col("seq")
    event = F.to_json(F.struct(F.concat(F.lit("x_"), "type").alias("type"), F.col("event_id").alias("id"), F.struct(
        F.when(n % 2 == 0, n.cast("string")).otherwise(F.lit("deep")).alias("depth"), F.array("text").alias("tags")).alias("note")))
    value = F.when(n % 9 == 0, F.concat(F.substring(event, 1, 12), F.lit("#"), "event_id")).otherwise(event)
    found = quarantine(parse_voice_events(events.select(value.alias("value"))))
    typed = body_fields(found, {"kind": ("$.type", "string"), "depth": ("$.note.depth", "bigint"), "tag": ("$.note.tags[0]", "string"), "id": ("$.id", "bigint")})
    event_id = F.coalesce("id", F.substring_index("raw", "#", -1).try_cast("bigint"))
    return typed.select(event_id.alias("event_id"), "problem", F.expr("substr(kind, 3)").alias("kind"), "depth", "tag", F.col("body").isNotNull().alias("whole"))
