"""Audit and metric queries over the events table shaped as conversation turns."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from talkweave import rules
from talkweave.operators import audit as au
from talkweave.plans.registry import query
from talkweave.sources.adapters import AUDIT_SQL, VOICE_SQL
from talkweave.sources.readers import with_audit_defaults

W = f"WITH {AUDIT_SQL} "
RANGE = au.TurnFilter(status="ok", input_mode="text", from_ts=datetime(2024, 1, 5, tzinfo=timezone.utc),
                      to_ts=datetime(2024, 1, 20, 23, 59, 59, tzinfo=timezone.utc))
RANGE_SQL = ("status = 'ok' AND input_mode = 'text' AND created_at >= TIMESTAMP '2024-01-05 00:00:00' "
             "AND created_at <= TIMESTAMP '2024-01-20 23:59:59'")
STATS_SQL = """count(*) AS total_turns, count(*) FILTER (status = 'ok') AS ok_count, count(*) FILTER (status <> 'ok') AS error_count,
 coalesce(avg(latency_ms_e2e), 0.0) AS avg_latency_ms, coalesce(avg(llm_first_token_ms), 0.0) AS avg_first_token_ms,
 count(*) FILTER (tool_called) AS tool_called_count, count(*) FILTER (tool_called AND len(wiki_sources) > 0) AS wiki_hit_count,
 count(DISTINCT session_id) AS unique_sessions"""
RATES_SQL = "tool_called_count / total_turns AS tool_called_rate, wiki_hit_count / total_turns AS wiki_hit_rate"


@query("src8_read_audit_turns", W + "SELECT id, session_id, turn_id, trace_id, input_mode, status, latency_ms_e2e, llm_first_token_ms, 'x' AS agent_thread_id FROM audit")
def _(t):
    old = t.audit_turns().drop("llm_first_token_ms").filter("1 = 0")
    both = with_audit_defaults(old.unionByName(t.audit_turns(), allowMissingColumns=True))
    return both.select("id", "session_id", "turn_id", "trace_id", "input_mode", "status", "latency_ms_e2e", "llm_first_token_ms",
                       F.lit("x").alias("agent_thread_id"))


@query("flt7_audit_filter", W + f"SELECT id, session_id FROM audit WHERE {RANGE_SQL}")
def _(t):
    return au.audit_filter(t.audit_turns(), RANGE).select("id", "session_id")


@query("flt8_turn_by_id", W + "SELECT id, session_id, status, user_text FROM audit WHERE id = 77")
def _(t):
    return au.turn_by_id(t.audit_turns(), 77).select("id", "session_id", "status", "user_text")


@query("flt9_clip_user_text", W + "SELECT id, substr(user_text, 1, 2) AS user_text FROM audit")
def _(t):
    return au.clip_user_text(t.audit_turns(), True, 2).select("id", "user_text")


@query("agg1_audit_stats", W + f"SELECT *, {RATES_SQL} FROM (SELECT {STATS_SQL} FROM audit WHERE {RANGE_SQL})")
def _(t):
    return au.audit_stats(t.audit_turns(), RANGE, digits=False)


@query("agg1b_audit_stats_rounded", W + f"""SELECT total_turns, ok_count, error_count, tool_called_count, wiki_hit_count, unique_sessions,
 round_even(avg_latency_ms, 1) AS avg_latency_ms, round_even(avg_first_token_ms, 1) AS avg_first_token_ms,
 round_even(tool_called_rate, 4) AS tool_called_rate, round_even(wiki_hit_rate, 4) AS wiki_hit_rate
FROM (SELECT *, {RATES_SQL} FROM (SELECT {STATS_SQL} FROM audit))""")
def _(t):
    return au.audit_stats(t.audit_turns())


@query("agg2_counts_by", W + "SELECT 'input_mode' AS dimension, input_mode AS value, count(*) AS n FROM audit GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM audit GROUP BY 2")
def _(t):
    return au.counts_by(t.audit_turns(), "input_mode", "status")


ROLLUP_SQL = """SELECT session_id, count(*) AS turn_count, count(*) FILTER (status = 'ok') AS ok_count, count(*) FILTER (status <> 'ok') AS error_count,
 avg(latency_ms_e2e) AS avg_latency_ms, avg(llm_first_token_ms) AS avg_first_token_ms, count(*) FILTER (tool_called) AS tool_called_count,
 epoch_us(min(created_at)) AS first_turn_at, epoch_us(max(created_at)) AS last_turn_at, arg_max(input_mode, id) AS last_input_mode, arg_max(user_text, id) AS last_user_text
 FROM audit GROUP BY 1"""


def _micros(df):
    return df.withColumn("first_turn_at", F.unix_micros("first_turn_at")).withColumn("last_turn_at", F.unix_micros("last_turn_at"))


@query("agg3_session_rollup", W + ROLLUP_SQL)
def _(t):
    return _micros(au.session_rollup(t.audit_turns(), digits=False))


@query("agg3b_page_sessions", W + f"SELECT session_id, turn_count, last_turn_at, last_input_mode, (SELECT count(DISTINCT session_id) FROM audit) AS total FROM ({ROLLUP_SQL}) ORDER BY last_turn_at DESC, session_id LIMIT 20 OFFSET 10")
def _(t):
    return _micros(au.page_sessions(t.audit_turns(), limit=20, offset=10)).select(
        "session_id", "turn_count", "last_turn_at", "last_input_mode", "total")


@query("top1_page_turns", W + "SELECT id, session_id, status, (SELECT count(*) FROM audit WHERE status = 'error') AS total FROM audit WHERE status = 'error' ORDER BY id DESC LIMIT 200 OFFSET 30")
def _(t):
    return au.page_turns(t.audit_turns(), au.TurnFilter(status="error"), limit=1000, offset=30).select("id", "session_id", "status", "total")


@query("top2_session_turns", W + "SELECT * FROM (SELECT id, turn_id, status FROM audit WHERE session_id = 's7' ORDER BY id DESC LIMIT 100) ORDER BY id")
def _(t):
    return au.session_turns(t.audit_turns(), "s7").select("id", "turn_id", "status")


@query("snk2_export_turns", W + """SELECT id, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') AS created_at, session_id, turn_id, trace_id, input_mode, status, latency_ms_e2e, llm_first_token_ms,
 tool_called, array_to_string(wiki_sources, '|') AS wiki_sources, array_to_string(retrieval_notes, '|') AS retrieval_notes, user_text, assistant_text, coalesce(error_code, '') AS error_code
 FROM audit ORDER BY id DESC LIMIT 2000""")
def _(t):
    return au.export_rows(t.audit_turns())


@query("agg13_metric_counters", W + """SELECT 'voice_turn_total' AS name, concat('status=', status, ',input_mode=', input_mode) AS labels, CAST(count(*) AS DOUBLE) AS value FROM audit GROUP BY 2
UNION ALL SELECT 'voice_agent_tool_calls_total', 'tool=wiki_search', CAST(count(*) AS DOUBLE) FROM audit WHERE tool_called
UNION ALL SELECT 'voice_wiki_retrieval_notes_total', concat('note=', note), CAST(count(*) AS DOUBLE) FROM (SELECT unnest(retrieval_notes) AS note FROM audit) GROUP BY 2""")
def _(t):
    labels = F.array_join(F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return au.metric_counters(t.audit_turns()).select("name", labels.alias("labels"), "value")


def _hist(value: str, label: str, buckets) -> str:
    rows = " UNION ALL ".join(
        f"SELECT label, {float(b)!r}::DOUBLE AS le, count(*) FILTER (v <= {b * 1000.0!r}) AS cumulative, count(*) AS n, CAST(sum(v) AS BIGINT) AS sum_ms FROM x GROUP BY 1" for b in buckets)
    return W + f", x AS (SELECT {label} AS label, {value} AS v FROM audit) {rows} UNION ALL SELECT label, 'inf'::DOUBLE, count(*), count(*), CAST(sum(v) AS BIGINT) FROM x GROUP BY 1"


@query("agg14_first_token_histogram", _hist("llm_first_token_ms", "input_mode", rules.FIRST_TOKEN_BUCKETS))
def _(t):
    return au.metric_histogram(t.audit_turns(), F.col("llm_first_token_ms"), rules.FIRST_TOKEN_BUCKETS, F.col("input_mode"))


@query("agg14b_turn_duration_histogram", _hist("latency_ms_e2e", "'e2e'", rules.TURN_DURATION_BUCKETS))
def _(t):
    return au.metric_histogram(t.audit_turns(), F.col("latency_ms_e2e"), rules.TURN_DURATION_BUCKETS, F.lit("e2e"))


@query("agg15_latency_slo", W + """SELECT input_mode, quantile_cont(CAST(latency_ms_e2e AS DOUBLE), 0.5) AS p50, quantile_cont(CAST(latency_ms_e2e AS DOUBLE), 0.95) AS p95, quantile_cont(CAST(latency_ms_e2e AS DOUBLE), 0.99) AS p99, count(*) AS n,
 p50 <= 900 AND p95 <= 1500 AND p99 <= 2500 AS met FROM audit GROUP BY 1""")
def _(t):
    return au.latency_slo(t.audit_turns())


@query("agg15b_duplicate_commit_slo", f"""WITH {VOICE_SQL}, c AS (SELECT session_id, turn_id, count(*) AS n FROM voice WHERE type = 'turn_commit_request' GROUP BY 1, 2)
SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates, CAST(sum(n) AS BIGINT) AS commits, sum(n - 1) / sum(n) AS duplicate_rate, sum(n - 1) / sum(n) < 0.001 AS met FROM c""")
def _(t):
    return au.voice_slo(t.voice_events())


@query("agg15c_barge_in_slo", W + "SELECT quantile_cont(CAST(llm_first_token_ms AS DOUBLE), 0.95) AS p95, count(*) AS n, p95 <= 300 AS met FROM audit WHERE status = 'error'")
def _(t):
    delays = au.audit_filter(t.audit_turns(), au.TurnFilter(status="error")).select(F.col("llm_first_token_ms").alias("stop_ms"))
    return au.barge_in_slo(delays)


@query("agg16_ops_summary", W + """SELECT 'not_ready' AS ready_status, 'live' AS mode, TRUE AS audit_enabled, 0.0::DOUBLE AS connections,
 CAST(count(*) FILTER (status = 'ok') AS DOUBLE) AS turns_ok, CAST(count(*) FILTER (status = 'error') AS DOUBLE) AS turns_error, CAST(count(*) FILTER (tool_called) AS DOUBLE) AS tool_calls FROM audit""")
def _(t):
    return au.ops_summary(au.metric_counters(t.audit_turns()), ["tts"])
