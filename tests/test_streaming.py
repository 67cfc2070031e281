"""Streams give the batch answers, also with repeated, late and split input."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from talkweave.operators import turns as tn
from talkweave.streaming import events as se
from talkweave.streaming import sessions as sn
from talkweave.streaming import turns as st

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "event_id bigint, session_id string, turn_id string, seq bigint, type string, text string, generation_id string, event_time timestamp"


def ev(i, turn, kind, seq=0, text="", gen=None, s="s1", at=None):
    return (i, s, turn, seq, kind, text, gen, T0 + dt.timedelta(seconds=i if at is None else at))


EVENTS = [
    ev(1, "t1", "turn_commit_request"), ev(2, "t1", "llm_delta", 0, "你好"), ev(3, "t1", "turn_commit_request"), ev(4, "t1", "cancel", gen="g_other"),
    ev(5, "t1", "llm_delta", 1, "，世界。"), ev(6, "t1", "cancel", gen="g_t1"), ev(7, "t1", "llm_delta", 2, "晚了"), ev(8, "t1", "cancel", gen="g_t1"),
    ev(9, "t2", "turn_commit_request"), ev(10, "t2", "llm_delta", 0, "好的"), ev(11, "t2", "audio_complete"), ev(12, "t3", "cancel", gen="g_t3"),
    ev(13, "t3", "turn_commit_request", s="s2"),
]


@pytest.fixture(scope="module")
def batch(spark):
    return spark.createDataFrame(EVENTS, SCHEMA)


def stream(spark, tmp_path, rows, name, build, files=2, mode="append"):
    """Feed the rows in several files and run the stream until all are read."""
    src = tmp_path / f"src-{name}"
    step = -(-len(rows) // files)
    for n in range(files):
        spark.createDataFrame(rows[n * step:(n + 1) * step], SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = (build(events).writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name).collect()


def test_batch_decisions(batch):
    commits = {r.event_id: (r.outcome, r.generation_id) for r in tn.commit_once(batch).collect()}
    assert commits[1] == ("turn_committed", "g_t1") and commits[3] == ("turn_rejected", None) and commits[13][0] == "turn_committed"
    acks = {r.event_id: r.cancelled for r in tn.match_cancels(batch, F.col("generation_id")).collect()}
    assert acks == {4: False, 6: True, 8: False, 12: False}


def test_cancel_in_the_middle(batch):
    known = batch.filter("generation_id IS NULL OR generation_id <> 'g_other'")
    assert {r.event_id for r in tn.suppress_cancelled(known).collect()} == {2, 5, 10}
    turns = {(r.session_id, r.turn_id): r for r in tn.assemble_turn_text(known).collect()}
    assert (turns["s1", "t1"].assistant_text, turns["s1", "t1"].status) == ("你好，世界。", "cancelled")
    assert (turns["s1", "t2"].assistant_text, turns["s1", "t2"].status, turns["s1", "t2"].latency_ms_e2e) == ("好的", "ok", 2000)
    states = {r.event_id: r.state for r in tn.session_state(known).collect()}
    assert [states[i] for i in (1, 2, 5, 6, 7, 9, 11)] == ["thinking", "speaking", "speaking", "interrupted", "interrupted", "thinking", "listening"]


def test_stream_decisions_equal_batch(spark, tmp_path, batch):
    got = stream(spark, tmp_path, EVENTS, "decisions", lambda e: st.turn_decisions(e, None), files=3)
    out = {r.event_id: r for r in got}
    want = {r.event_id: r.outcome for r in tn.commit_once(batch).collect()}
    assert {i: out[i].outcome for i in want} == want
    acks = {r.event_id: r.cancelled for r in tn.match_cancels(batch, F.col("generation_id")).collect()}
    assert {i: out[i].cancelled for i in acks} == acks
    assert 7 not in out  # nothing after the cancel


def test_commit_is_accepted_once(spark, tmp_path):
    rows = [ev(i, "t1", "turn_commit_request", at=i % 3) for i in range(1, 9)] + [ev(20, "t2", "turn_commit_request")]
    got = stream(spark, tmp_path, rows, "accepted", se.accepted_commits, files=3)
    assert sorted(r.turn_id for r in got) == ["t1", "t2"]


def test_segments_carry_over(spark, tmp_path):
    rows = [ev(1, "t1", "llm_delta", 0, "你好"), ev(2, "t1", "llm_delta", 1, "，世界。仅"), ev(3, "t1", "llm_delta", 2, "一段"), ev(4, "t1", "audio_complete", 3),
            ev(5, "t2", "llm_delta", 0, "a" * 130)]
    got = stream(spark, tmp_path, rows, "segments", lambda e: st.stream_segments(e, None), files=5)
    one = [r.text for r in sorted((r for r in got if r.turn_id == "t1"), key=lambda r: r.chunk_index)]
    assert one == ["你好，", "世界。", "仅一段"]
    assert [r.text for r in got if r.turn_id == "t2"] == ["a" * 120]
    deltas = spark.createDataFrame(rows, SCHEMA).filter("type = 'llm_delta'")
    same = sorted((r.chunk_index, r.text) for r in tn.stream_segments(deltas).collect() if r.turn_id == "t1")
    assert [x[1] for x in same] == one


def test_long_runs_are_cut_alike(spark, tmp_path):
    rows = [ev(i, "t1", "llm_delta", i, text) for i, text in enumerate(("a" * 70, "b" * 70, "c" * 61 + "，d", "e" * 300, "f，" + "g" * 5))]
    got = stream(spark, tmp_path, [*rows, ev(9, "t1", "audio_complete", 9)], "long", lambda e: st.stream_segments(e, None), files=6)
    batch = tn.stream_segments(spark.createDataFrame(rows, SCHEMA)).collect()
    one, two = ([r.text for r in sorted(x, key=lambda r: r.chunk_index)] for x in (got, batch))
    assert one == two and len(one[0]) == 120 and max(map(len, one)) == 120


def test_sequence_flags(spark, tmp_path, batch):
    rows = [ev(i, "t1", "llm_delta", q) for i, q in enumerate((0, 1, 1, 3, 2, 4, 2, 9, 0, 7, 8, 10))]
    got = {r.event_id: r.flag for r in stream(spark, tmp_path, rows, "flags", lambda e: st.sequence_flags(e, None), files=2)}
    flags = {r.event_id: r.flag for r in tn.seq_gaps(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == flags == {0: "ok", 1: "ok", 2: "duplicate", 3: "gap", 4: "out_of_order", 5: "ok", 6: "duplicate", 7: "gap", 8: "duplicate", 9: "out_of_order", 10: "out_of_order", 11: "ok"}


def test_late_cancel_and_text_windows(spark, tmp_path):
    rows = [ev(1, "t1", "llm_delta", 0, "a", "g1"), ev(4, "t1", "llm_delta", 1, "b", "g1"), ev(3, "t1", "cancel", gen="g1"), ev(900, "t9", "llm_delta", 0, "z", "g9"),
            ev(3000, "t10", "llm_delta", 0, "y", "g10"), ev(3001, "t10", "cancel", gen="gx"), ev(5000, "t11", "llm_delta", 0, "x", "g11"), ev(5001, "t11", "cancel", gen="gy")]

    def build(events):
        deltas = events.filter("type = 'llm_delta'")
        cancels = events.filter("type = 'cancel'").select("generation_id", F.col("event_time").alias("cancel_time"))
        return se.suppress_cancelled_stream(deltas, cancels, "1 hour")

    got = {r.event_id for r in stream(spark, tmp_path, rows, "suppressed", build, files=4)}
    assert {1, 900} <= got and 4 not in got
    texts = stream(spark, tmp_path, [r for r in rows if r[4] == "llm_delta"], "texts", lambda e: se.stream_turn_text(e, "10 minutes"), files=2)
    assert {r.turn_id: r.assistant_text for r in texts}["t1"] == "ab"


def test_speech_segments(spark):
    frames = [("s", T0 + dt.timedelta(milliseconds=m), lvl) for m, lvl in ((0, 0.1), (200, 0.05), (400, 0.001), (700, 0.02), (1700, 0.3), (1900, 0.001))]
    df = spark.createDataFrame(frames, "session_id string, event_time timestamp, level double")
    got = [(r.frames) for r in tn.speech_segments(df).orderBy("speech_start").collect()]
    assert got == [3, 1]


def test_event_validation(spark):
    ok = {"session_id": "s", "turn_id": "t", "seq": 0, "trace_id": "r", "timestamp_ms": 5}
    cases = [
        ({**ok, "type": "turn_commit_request", "reason": "hi"}, None), ({**ok, "type": "turn_commit_request"}, "PROCESSING_FAILED"),
        ({**ok, "type": "turn_commit_request", "reason": "  "}, "EMPTY_USER_TEXT"), ({**ok, "type": "cancel"}, "PROCESSING_FAILED"),
        ({**ok, "type": "cancel", "generation_id": "g"}, None), ({**ok, "type": "audio_chunk", "audio_base64": "AAA="}, None),
        ({**ok, "type": "nope"}, "INVALID_EVENT"), ({**ok, "type": "vad_event", "event": "speech_start", "seq": -1}, "PROCESSING_FAILED"),
    ]
    rows = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)], "i int, value string")
    parsed = se.parse_voice_events(rows)
    assert parsed.count() == len(cases)
    got = [r.problem for r in se.parse_voice_events(rows.orderBy("i").coalesce(1)).collect()]
    assert got == [p for _, p in cases]
    audio = se.valid_events(parsed).filter("type = 'audio_chunk'").collect()[0]
    assert (audio.codec, audio.sample_rate_hz, audio.channels, audio.chunk_ms) == ("pcm_s16le", 16000, 1, 100) and bytes(audio.audio) == b"\x00\x00"


def test_audit_sink_is_repeatable(spark, tmp_path):
    path = str(tmp_path / "audit")
    write = st.audit_sink(path)
    rows = spark.createDataFrame([(1, "s", "t1"), (2, "s", "t1"), (3, "s", "t2")], "id bigint, session_id string, turn_id string")
    write(rows, 0)
    write(rows, 0)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 3]


def test_history_and_gauge(spark):
    turns = spark.createDataFrame([("s1", 1, "q", "hi"), ("s2", 2, "q2", "")], "session_id string, id bigint, user_text string, assistant_text string")
    got = [(r.session_id, r.role, r.text) for r in tn.thread_history(turns, "hi").orderBy("session_id", "turn", "side").collect()]
    assert got == [("s1", "user", "q"), ("s1", "assistant", "hi"), ("s2", "assistant", "hi"), ("s2", "user", "q2")]


def shuffled(rows, seed):
    """Rows out of order by a few places, as a network would deliver them."""
    import random

    rng = random.Random(seed)
    return [r for _, r in sorted(((n + rng.uniform(0, 6), r) for n, r in enumerate(rows)), key=lambda x: x[0])]


END = ev(10_000, "t-end", "turn_commit_request", s="s-end")  # moves the watermark past all other rows


@pytest.fixture(scope="module")
def many():
    """Several sessions with interleaved turns: repeats, foreign cancels, cancels before and after deltas."""
    import random

    rng, rows = random.Random(11), []
    for i in range(1, 260):
        kind = rng.choice(["turn_commit_request", "llm_delta", "llm_delta", "llm_delta", "cancel", "audio_complete"])
        turn = f"t{i // 60}-{rng.randrange(3)}"
        rows.append(ev(i, turn, kind, i, f"<{i}>", rng.choice([f"g_{turn}", "g_other", None]) if kind == "cancel" else None, s=f"s{i % 3}"))
    return rows


@pytest.mark.parametrize("files", [1, 5])
def test_session_states_equal_batch(spark, tmp_path, many, files):
    got = stream(spark, tmp_path, [*shuffled(many, files), END], f"states{files}", lambda e: sn.session_states(e, "30 seconds"), files=files)
    if files == 1:  # one batch: the watermark moves once all rows are in
        assert not any(r.late for r in got)
    want = {(r.session_id, r.event_id, r.type, r.state) for r in tn.session_state(spark.createDataFrame(many, SCHEMA)).collect()}
    assert {(r.session_id, r.event_id, r.type, r.state) for r in got} == want and len(got) == len(want)


def test_late_rows_are_reported(spark, tmp_path):
    rows = [ev(1, "t1", "turn_commit_request"), ev(100, "t1", "llm_delta", 0, "a"), ev(500, "t1", "audio_complete"), ev(2, "t1", "llm_delta", 1, "late", at=2), END]
    got = {(r.event_id, r.state, r.late) for r in stream(spark, tmp_path, rows, "lates", lambda e: sn.session_states(e, "10 seconds"), files=5)}
    assert got == {(1, "thinking", False), (100, "speaking", False), (500, "listening", False), (2, None, True)}


def test_forgotten_turns_begin_anew(spark, tmp_path):
    rows = [ev(1, "t1", "turn_commit_request"), ev(2, "t1", "audio_complete"), ev(900, "t2", "cancel"), ev(1800, "t1", "turn_commit_request"), END]
    got = {r.event_id: r.state for r in stream(spark, tmp_path, rows, "keep", lambda e: sn.session_states(e, "10 seconds", keep_ms=60_000), files=5)}
    assert got == {1: "thinking", 2: "listening", 900: "listening", 1800: "thinking"}


@pytest.mark.parametrize("files", [1, 4])
def test_turn_texts_equal_batch(spark, tmp_path, many, files):
    got = stream(spark, tmp_path, [*shuffled(many, files), END], f"turntexts{files}", lambda e: sn.turn_texts(e, 600_000, "30 seconds"), files=files)
    want = {tuple(r) for r in tn.assemble_turn_text(spark.createDataFrame(many, SCHEMA)).collect()}
    assert {tuple(r)[:-1] for r in got} == want and not any(r.late for r in got)


def test_turn_texts_keep_what_was_said_before_a_cancel(spark, tmp_path):
    got = stream(spark, tmp_path, [*EVENTS, END], "cancelled", lambda e: sn.turn_texts(e, 60_000, "10 seconds"), files=3)
    by = {(r.session_id, r.turn_id): r for r in got}
    assert (by["s1", "t1"].assistant_text, by["s1", "t1"].status, by["s1", "t1"].latency_ms_e2e) == ("你好，世界。", "cancelled", 5000)
    assert (by["s1", "t2"].assistant_text, by["s1", "t2"].status) == ("好的", "ok")
    assert (by["s2", "t3"].assistant_text, by["s2", "t3"].status, by["s2", "t3"].latency_ms_e2e) == ("", "open", None)


def test_long_turns_are_passed_on_in_parts(spark, tmp_path):
    rows = [ev(1, "t1", "turn_commit_request"), *(ev(2 + i, "t1", "llm_delta", i, f"{i},") for i in range(25)), ev(40, "t1", "audio_complete")]
    pace = [*rows, ev(200, "t2", "turn_commit_request"), END]
    got = sorted(stream(spark, tmp_path, pace, "parts", lambda e: sn.turn_texts(e, 60_000, "2 seconds", rows_per_part=10), files=9), key=lambda r: r.part)
    want = sorted((r for r in tn.assemble_turn_text(spark.createDataFrame(rows, SCHEMA), rows_per_part=10).collect()), key=lambda r: r.part)
    got = [r for r in got if r.turn_id == "t1"]
    assert [(r.part, r.assistant_text, r.llm_first_token_ms) for r in got] == [(r.part, r.assistant_text, r.llm_first_token_ms) for r in want]
    assert [r.status for r in got] == ["open", "open", "ok"] and got[-1].latency_ms_e2e == want[-1].latency_ms_e2e


def test_results_carry_the_latest_turn(spark, tmp_path):
    rows = [ev(1, "t1", "asr_partial", 0, "own"), ev(2, "t1", "audio_chunk"), ev(3, "t1", "asr_partial", 1, "a"), ev(4, "t2", "audio_chunk"), ev(5, "t1", "asr_final", 2, "late final"),
            ev(6, "t9", "asr_final", 0, "other", s="s2"), ev(7, "t2", "asr_final", 3, "b")]
    df = spark.createDataFrame(rows, SCHEMA)
    kind = F.col("type")
    batch = {(r.event_id, r.turn_id) for r in tn.asr_stamped(df, kind == "audio_chunk", kind.startswith("asr_")).collect()}
    assert batch == {(1, "t1"), (3, "t1"), (5, "t2"), (6, "t9"), (7, "t2")}
    got = stream(spark, tmp_path, [*shuffled(rows, 3), END], "latest", lambda e: sn.latest_turns(e, delay="20 seconds"), files=3)
    assert {(r.event_id, r.turn_id) for r in got} == batch


def test_gauge_stream_equals_batch_at_window_ends(spark, tmp_path):
    rows = [ev(i, "t", "open" if i % 3 else "close", s=f"s{i % 4}", at=i * 7) for i in range(60)]
    change = F.when(F.col("type") == "open", 1).otherwise(-1)
    build = lambda e: sn.connection_gauge(e.withColumn("change", change), "1 minute", "5 seconds")
    got = {r.window_end: r.active for r in stream(spark, tmp_path, [*rows, ev(1000, "t", "open"), ev(9000, "t", "open")], "gauge", build, files=6)}
    gauge = tn.active_connections(spark.createDataFrame([*rows, ev(1000, "t", "open")], SCHEMA), F.col("type") == "open", F.col("type") == "close")
    last = gauge.groupBy(F.window("event_time", "1 minute")["end"].alias("e")).agg(F.max_by("active", F.struct("event_time", "event_id")).alias("a")).collect()
    assert got == {r.e: r.a for r in last}


def test_history_keeps_what_was_said_before_a_cancel(spark, batch):
    users = spark.createDataFrame([("s1", "t1", 1, "q1"), ("s1", "t2", 2, "q2"), ("s2", "t3", 3, "q3")], "session_id string, turn_id string, id bigint, user_text string")
    rows = tn.thread_history(tn.turns_from_events(batch, users), "hi").orderBy("session_id", "turn", "side").collect()
    assert [(r.session_id, r.role, r.text) for r in rows] == [
        ("s1", "assistant", "hi"), ("s1", "user", "q1"), ("s1", "assistant", "你好，世界。"), ("s1", "user", "q2"), ("s1", "assistant", "好的"),
        ("s2", "assistant", "hi"), ("s2", "user", "q3")]
