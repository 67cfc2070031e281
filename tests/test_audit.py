"""Audit statistics on two turns, and bounds of the request parameters."""

import datetime as dt

import pytest

from talkweave.operators import audit as au

UTC = dt.timezone.utc


@pytest.fixture(scope="module")
def turns(spark):
    rows = [
        (1, "tr1", "s1", "t1", "text", "u1", "a1", ["faqs/试用.md"], ["index_match"], True, "s1", 100, 40, "ok", None, dt.datetime(2024, 1, 1, 23, 59, 59, tzinfo=UTC)),
        (2, "tr2", "s1", "t2", "voice", "u2", "", [], [], False, "s1", 200, 0, "error", "ORCHESTRATOR_FAILED", dt.datetime(2024, 1, 2, tzinfo=UTC)),
    ]
    from talkweave.sources.readers import TURN_SCHEMA

    return spark.createDataFrame(rows, TURN_SCHEMA)


def test_stats(turns):
    s = au.audit_stats(turns).collect()[0]
    assert (s.total_turns, s.ok_count, s.error_count, s.tool_called_count, s.wiki_hit_count, s.unique_sessions) == (2, 1, 1, 1, 1, 1)
    assert (s.avg_latency_ms, s.avg_first_token_ms, s.tool_called_rate) == (150.0, 20.0, 0.5)
    none = au.audit_stats(turns, au.TurnFilter(session_id="zz")).collect()[0]
    assert (none.total_turns, none.avg_latency_ms, none.wiki_hit_rate) == (0, 0.0, 0.0)


def test_filters_and_pages(turns):
    assert au.audit_filter(turns, au.TurnFilter(status="ok")).count() == 1
    day = au.TurnFilter(from_ts="2024-01-01", to_ts="2024-01-01")
    assert [r.id for r in au.audit_filter(turns, day).collect()] == [1]
    roll = au.page_sessions(turns).collect()[0]
    assert (roll.turn_count, roll.last_input_mode, roll.last_user_text, roll.total) == (2, "voice", "u2", 1)
    assert [r.id for r in au.page_turns(turns, limit=0).collect()] == [2]
    assert [r.id for r in au.session_turns(turns, "s1").collect()] == [1, 2]
    assert au.clip_user_text(turns, store=False).filter("user_text <> ''").count() == 0


def test_export(turns, tmp_path):
    from talkweave.sources.writers import export_turns_csv

    export_turns_csv(au.export_rows(turns), str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    assert text.startswith("id,created_at,session_id") and "faqs/试用.md" in text and text.index("\n2,") < text.index("\n1,")


def test_bounds(turns):
    def ids(**bounds):
        return [r.id for r in au.audit_filter(turns, au.TurnFilter(**bounds)).orderBy("id").collect()]

    assert ids(to_ts="2024-01-01") == [1] and ids(from_ts="2024-01-01T23:59:59Z") == [1, 2] and ids(from_ts="2024-01-02T01:00:00+02:00") == [1, 2]
    assert ids(from_ts=" ") == [1, 2] and ids(from_ts=dt.datetime(2024, 1, 2, tzinfo=UTC)) == [2]
    with pytest.raises(Exception, match="yesterday"):
        ids(from_ts="yesterday")
