"""Audit analytics over conversation turns."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from talkweave import rules
from talkweave.functions.text import parse_time_bound


@dataclass(frozen=True)
class TurnFilter:
    session_id: str | None = None
    turn_id: str | None = None
    trace_id: str | None = None
    status: str | None = None
    input_mode: str | None = None
    from_ts: datetime | str | None = None  # text: a day or an ISO instant
    to_ts: datetime | str | None = None


def audit_filter(turns: DataFrame, f: TurnFilter) -> DataFrame:
    """Conjunction of the set conditions; each is a plain comparison and reaches the scan."""
    for name in ("session_id", "turn_id", "trace_id", "status", "input_mode"):
        value = getattr(f, name)
        if value:
            turns = turns.filter(F.col(name) == value)
    for value, is_end in ((f.from_ts, False), (f.to_ts, True)):
        if value is None or (isinstance(value, str) and not value.strip()):
            continue
        bound = parse_time_bound(F.lit(value), is_end) if isinstance(value, str) else F.lit(value)
        turns = turns.filter(F.col("created_at") <= bound if is_end else F.col("created_at") >= bound)
    return turns


def turn_by_id(turns: DataFrame, turn_pk: int) -> DataFrame:
    return turns.filter(F.col("id") == turn_pk)


def clip_user_text(turns: DataFrame, store: bool = True, max_chars: int = 2000) -> DataFrame:
    c = F.col("user_text")
    if not store:
        return turns.withColumn("user_text", F.lit(""))
    return turns.withColumn("user_text", F.substring(c, 1, max_chars)) if max_chars > 0 else turns


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def audit_stats(turns: DataFrame, f: TurnFilter = TurnFilter(), digits: bool = True, exact_sessions: bool = True) -> DataFrame:
    """Counts, averages and rates of the filtered turns in one row.

    Every status other than ``ok`` counts as an error. Averages include zero values.
    """
    ok = F.col("status") == "ok"
    wiki_hit = F.col("tool_called") & (F.size("wiki_sources") > 0)
    sessions = F.count_distinct("session_id") if exact_sessions else F.approx_count_distinct("session_id")
    g = audit_filter(turns, f).agg(
        F.count(F.lit(1)).alias("total_turns"),
        F.count_if(ok).alias("ok_count"),
        F.count_if(~ok).alias("error_count"),
        F.coalesce(F.avg("latency_ms_e2e"), F.lit(0.0)).alias("avg_latency_ms"),
        F.coalesce(F.avg("llm_first_token_ms"), F.lit(0.0)).alias("avg_first_token_ms"),
        F.count_if("tool_called").alias("tool_called_count"),
        F.count_if(wiki_hit).alias("wiki_hit_count"),
        sessions.alias("unique_sessions"),
    )
    total = F.col("total_turns")
    out = g.withColumn("tool_called_rate", _rate(F.col("tool_called_count"), total)).withColumn(
        "wiki_hit_rate", _rate(F.col("wiki_hit_count"), total))
    if digits:
        for name, n in (("avg_latency_ms", 1), ("avg_first_token_ms", 1), ("tool_called_rate", 4), ("wiki_hit_rate", 4)):
            out = out.withColumn(name, F.bround(name, n))
    return out


def counts_by(turns: DataFrame, *columns: str) -> DataFrame:
    """Counts per value of each column, all columns in one pass."""
    cols = [F.col(c) for c in columns]
    grouped = turns.groupingSets([[c] for c in cols], *cols).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"))
    last = len(columns) - 1
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(columns):
        # in the grouping id a zero bit marks the column that is grouped
        chosen = F.col("_g").bitwiseAND(1 << (last - i)) == 0
        name = F.when(chosen, c).otherwise(name)
        value = F.when(chosen, F.col(c)).otherwise(value)
    return grouped.select(name.alias("dimension"), value.alias("value"), "n")


def session_rollup(turns: DataFrame, f: TurnFilter = TurnFilter(), digits: bool = True) -> DataFrame:
    """Per session nine aggregates plus mode and text of the turn with the greatest id."""
    ok = F.col("status") == "ok"
    g = audit_filter(turns, f).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("turn_count"),
        F.count_if(ok).alias("ok_count"),
        F.count_if(~ok).alias("error_count"),
        F.avg("latency_ms_e2e").alias("avg_latency_ms"),
        F.avg("llm_first_token_ms").alias("avg_first_token_ms"),
        F.count_if("tool_called").alias("tool_called_count"),
        F.min("created_at").alias("first_turn_at"),
        F.max("created_at").alias("last_turn_at"),
        F.max_by(F.struct("input_mode", "user_text"), "id").alias("_last"),
    )
    if digits:
        g = g.withColumn("avg_latency_ms", F.bround("avg_latency_ms", 1)).withColumn(
            "avg_first_token_ms", F.bround("avg_first_token_ms", 1))
    return g.withColumn("last_input_mode", F.col("_last.input_mode")).withColumn(
        "last_user_text", F.col("_last.user_text")).drop("_last")


def clamp_page(limit: int, offset: int, cap: int = rules.PAGE_SIZE_CAP) -> tuple[int, int]:
    return max(1, min(limit, cap)), max(0, offset)


def page_sessions(turns: DataFrame, f: TurnFilter = TurnFilter(), limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of sessions, newest last turn first, with the number of sessions beside."""
    limit, offset = clamp_page(limit, offset)
    grouped = session_rollup(turns, f)
    total = audit_filter(turns, f).agg(F.count_distinct("session_id"))
    return (grouped.orderBy(F.desc("last_turn_at"), "session_id").offset(offset).limit(limit)
            .withColumn("total", total.scalar()))


def page_turns(turns: DataFrame, f: TurnFilter = TurnFilter(), limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of turns, greatest id first, with the number of matching turns beside."""
    limit, offset = clamp_page(limit, offset)
    matching = audit_filter(turns, f)
    total = matching.agg(F.count(F.lit(1)))
    return matching.orderBy(F.desc("id")).offset(offset).limit(limit).withColumn("total", total.scalar())


def session_turns(turns: DataFrame, session_id: str, limit: int = 100) -> DataFrame:
    """The newest turns of one session, oldest first."""
    limit, _ = clamp_page(limit, 0)
    return audit_filter(turns, TurnFilter(session_id=session_id)).orderBy(F.desc("id")).limit(limit).orderBy("id")


EXPORT_COLUMNS = [
    "id", "created_at", "session_id", "turn_id", "trace_id", "input_mode", "status", "latency_ms_e2e",
    "llm_first_token_ms", "tool_called", "wiki_sources", "retrieval_notes", "user_text", "assistant_text", "error_code",
]


def export_rows(turns: DataFrame, f: TurnFilter = TurnFilter(), limit: int = 2000) -> DataFrame:
    """Rows of the CSV export: newest id first, list columns joined, missing error blank.

    The requested limit is honoured up to 5000.
    """
    picked = audit_filter(turns, f).orderBy(F.desc("id")).limit(max(1, min(limit, 5000)))
    shaped = {
        "created_at": F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
        "wiki_sources": F.array_join("wiki_sources", "|"),
        "retrieval_notes": F.array_join("retrieval_notes", "|"),
        "error_code": F.coalesce("error_code", F.lit("")),
    }
    return picked.select(*[shaped[c].alias(c) if c in shaped else F.col(c) for c in EXPORT_COLUMNS])


# --- metrics ------------------------------------------------------------------------

def metric_counters(turns: DataFrame, tool: str = rules.SEARCH_TOOL) -> DataFrame:
    """Counter samples as (name, labels, value); ``tool`` labels the calls of the search tool."""
    def sample(name: str, df: DataFrame, labels: dict[str, str]) -> DataFrame:
        pairs = [x for k, c in labels.items() for x in (F.lit(k), F.col(c))]
        return df.select(F.lit(name).alias("name"), F.create_map(*pairs).alias("labels"), F.col("n").cast("double").alias("value"))

    by_turn = turns.groupBy("status", "input_mode").agg(F.count(F.lit(1)).alias("n"))
    tools = turns.filter("tool_called").groupBy(F.lit(tool).alias("tool")).agg(F.count(F.lit(1)).alias("n"))
    notes = turns.select(F.explode("retrieval_notes").alias("note")).groupBy("note").agg(F.count(F.lit(1)).alias("n"))
    return (
        sample("voice_turn_total", by_turn, {"status": "status", "input_mode": "input_mode"})
        .unionByName(sample("voice_agent_tool_calls_total", tools, {"tool": "tool"}))
        .unionByName(sample("voice_wiki_retrieval_notes_total", notes, {"note": "note"}))
    )


def metric_histogram(turns: DataFrame, value: Column, buckets: list[float], label: Column) -> DataFrame:
    """Cumulative bucket counts, sum and count per label, in one aggregation.

    ``value`` is in milliseconds; bounds are in seconds. The sum stays in milliseconds.
    """
    counts = [F.count_if(value <= b * 1000.0).alias(f"b{i}") for i, b in enumerate(buckets)]
    g = turns.groupBy(label.alias("label")).agg(*counts, F.count(value).alias("n"), F.sum(value).alias("sum_ms"))
    pairs = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("c")) for i, b in enumerate(buckets)]
    pairs.append(F.struct(F.lit(float("inf")).alias("le"), F.col("n").alias("c")))
    return g.select("label", F.explode(F.array(*pairs)).alias("p"), "n", "sum_ms").select(
        "label", F.col("p.le").alias("le"), F.col("p.c").alias("cumulative"), "n", "sum_ms")


def exact_percentiles(df: DataFrame, keys: list[str], value: str, points: list[float]) -> DataFrame:
    """Exact percentiles from value counts: equal values are merged before any group is gathered."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(
        *[F.percentile(value, F.lit(p), F.col("_n")).alias(f"p{round(p * 100)}") for p in points],
        F.sum("_n").alias("n"))


def latency_slo(turns: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """End-to-end latency percentiles per input mode against their targets."""
    targets = targets or rules.LATENCY_TARGETS_MS
    p = exact_percentiles(turns, ["input_mode"], "latency_ms_e2e", [0.5, 0.95, 0.99])
    met = [(F.col(name) <= limit) for name, limit in targets.items()]
    return p.withColumn("met", met[0] & met[1] & met[2])


def voice_slo(events: DataFrame) -> DataFrame:
    """Duplicate-commit rate against its target."""
    commits = events.filter(F.col("type") == "turn_commit_request").groupBy("session_id", "turn_id").agg(F.count(F.lit(1)).alias("n"))
    dup = commits.agg(F.sum(F.col("n") - 1).alias("duplicates"), F.sum("n").alias("commits"))
    return dup.withColumn("duplicate_rate", _rate(F.col("duplicates"), F.col("commits"))).withColumn(
        "met", F.col("duplicate_rate") < rules.DUPLICATE_COMMIT_TARGET)


def barge_in_delays(events: DataFrame) -> DataFrame:
    """``stop_ms`` of each turn with an effective cancel: from the cancel to the turn's last delta after it, 0 if none came."""
    from talkweave.operators.turns import TURN, turn_bounds

    cancels = turn_bounds(events).filter(F.col("cancel").isNotNull()).select(*TURN, "cancel")
    deltas = events.filter("type = 'llm_delta'").groupBy(*TURN).agg(F.max(F.struct("event_time", "event_id")).alias("_last"))
    stop = F.unix_millis("_last.event_time") - F.unix_millis("cancel.event_time")
    return cancels.join(deltas, TURN, "left").select(*TURN, F.when(F.col("_last") > F.col("cancel"), stop).otherwise(0).alias("stop_ms"))


def barge_in_slo(delays: DataFrame, target_ms: float = rules.BARGE_IN_TARGET_MS) -> DataFrame:
    """95th percentile of ``stop_ms`` (cancel request to acknowledged stop) against its target."""
    return exact_percentiles(delays, [], "stop_ms", [0.95]).withColumn("met", F.col("p95") <= target_ms)


def metric_value(name: str, labels: dict[str, str] | None = None, prefix: bool = False) -> Column:
    """Aggregate for one dashboard card: samples by name (or prefix) and labels, summed."""
    test = F.col("name") == name
    if prefix:
        test = test | F.col("name").startswith(name + "_")
    for k, v in (labels or {}).items():
        test = test & (F.element_at("labels", k) == v)
    return F.coalesce(F.sum(F.when(test, F.col("value"))), F.lit(0.0))


def ops_summary(metrics: DataFrame, missing: list[str], mode: str = "live", audit_enabled: bool = True) -> DataFrame:
    """Readiness flags and card sums in one row."""
    def turns(status: str) -> Column:
        return sum((metric_value("voice_turn_total", {"status": status, "input_mode": m}) for m in ("voice", "text")), F.lit(0.0))

    return metrics.agg(
        F.lit("ready" if not missing else "not_ready").alias("ready_status"),
        F.lit(mode).alias("mode"),
        F.lit(audit_enabled).alias("audit_enabled"),
        metric_value("voice_ws_connections_active").alias("connections"),
        turns("ok").alias("turns_ok"),
        turns("error").alias("turns_error"),
        metric_value("voice_agent_tool_calls_total", prefix=True).alias("tool_calls"),
    )
