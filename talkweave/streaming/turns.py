"""Stateful turn operators on streams: commit once, cancel, state, sequence and segments.

State lives per turn. ``ttl_ms`` says how long after its last update it is dropped; an event that
comes later starts its turn anew, so the caller chooses it. Expiry needs the processing-time clock,
which keeps a query running; a run that should end with its input (``availableNow``) passes None.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from talkweave import rules


def _in_order(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """Events of one key in this micro-batch, by arrival."""
    return pd.concat(list(batches)).sort_values(["event_time", "event_id"], kind="stable")


class ExpiringProcessor(StatefulProcessor):
    """A processor whose state expires ``ttl_ms`` after its last update (None: never)."""

    schema = ""

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl_ms = ttl_ms

    def close(self) -> None:
        pass


class TurnDecisions(ExpiringProcessor):
    """Commit outcomes, cancel acknowledgements and session states of one turn."""

    schema = "session_id string, turn_id string, event_id bigint, outcome string, generation_id string, cancelled boolean, state string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turn = handle.getValueState("turn", "committed boolean, generation_id string", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        committed, active = self.turn.get() if self.turn.exists() else (False, "")
        out = []
        own = f"g_{key[1]}"
        for e in _in_order(rows).itertuples():
            if e.type == "turn_commit_request":
                if committed:
                    out.append((e.event_id, "turn_rejected", None, None, None))
                else:
                    committed, active = True, own
                    out.append((e.event_id, "turn_committed", own, None, "thinking"))
            elif e.type == "cancel":
                claimed = e.generation_id or own
                hit = bool(active) and claimed == active
                active = "" if hit else active
                out.append((e.event_id, "cancel_ack", claimed, hit, "interrupted" if hit else None))
            elif e.type == "llm_delta" and active:
                out.append((e.event_id, "llm_delta", active, None, "speaking"))
            elif e.type == "audio_complete" and active:
                out.append((e.event_id, "audio_complete", active, None, "listening"))
        self.turn.update((committed, active))
        result = pd.DataFrame(out, columns=["event_id", "outcome", "generation_id", "cancelled", "state"])
        result.insert(0, "turn_id", key[1])
        result.insert(0, "session_id", key[0])
        yield result


class SequenceCheck(ExpiringProcessor):
    """Flags of sequence numbers inside a turn: duplicate, out of order, after a gap, or ok.

    The numbers seen are kept as ranges, of which there are as many as there are open gaps.
    """

    schema = "session_id string, turn_id string, event_id bigint, seq bigint, flag string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "low array<bigint>, high array<bigint>", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        low, high = (list(map(int, x)) for x in (self.seen.get() if self.seen.exists() else ((), ())))
        out = []
        for e in _in_order(rows).itertuples():
            seq = int(e.seq)
            at = bisect_right(low, seq)  # ranges that begin at or before it
            if at and seq <= high[at - 1]:
                flag = "duplicate"
            else:
                flag = "out_of_order" if at < len(low) else "gap" if high and seq > high[-1] + 1 else "ok"
                before, after = at > 0 and high[at - 1] + 1 == seq, at < len(low) and low[at] - 1 == seq
                if before and after:
                    high[at - 1] = high.pop(at)
                    low.pop(at)
                elif before:
                    high[at - 1] = seq
                elif after:
                    low[at] = seq
                else:
                    low.insert(at, seq)
                    high.insert(at, seq)
            out.append((key[0], key[1], e.event_id, seq, flag))
        self.seen.update((low, high))
        yield pd.DataFrame(out, columns=["session_id", "turn_id", "event_id", "seq", "flag"])


class SegmentCutter(ExpiringProcessor):
    """Speakable segments of a turn: the rest of a delta waits for the next one."""

    schema = "session_id string, turn_id string, chunk_index bigint, text string"
    max_run = 120

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rest = handle.getValueState("rest", "buffer string, next bigint", ttlDurationMs=self.ttl_ms)

    def cut(self, buffer: str) -> tuple[list[str], str]:
        pieces, start = [], 0
        for at, ch in enumerate(buffer):
            if ch in rules.SEGMENT_BOUNDARIES:
                pieces.append(buffer[start:at + 1])
                start = at + 1
        tail = buffer[start:]
        while len(tail) >= self.max_run:
            pieces.append(tail[: self.max_run])
            tail = tail[self.max_run:]
        return [p.strip() for p in pieces if p.strip()], tail

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        buffer, index = self.rest.get() if self.rest.exists() else ("", 0)
        out = []
        events = pd.concat(list(rows)).sort_values(["seq", "event_id"], kind="stable")
        for e in events.itertuples():
            found, buffer = self.cut(buffer + e.text) if e.type == "llm_delta" else ([buffer.strip()], "")
            for text in filter(None, found):
                out.append((key[0], key[1], index, text))
                index += 1
        self.rest.update((buffer, index))
        yield pd.DataFrame(out, columns=["session_id", "turn_id", "chunk_index", "text"])


def _apply(events: DataFrame, processor: ExpiringProcessor) -> DataFrame:
    return events.groupBy("session_id", "turn_id").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=processor.schema, outputMode="Append",
        timeMode="None" if processor.ttl_ms is None else "ProcessingTime")


def turn_decisions(events: DataFrame, ttl_ms: int | None) -> DataFrame:
    """Stream of outcomes for commits, cancels, deltas and completions (event_id, event_time, type, generation_id)."""
    return _apply(events, TurnDecisions(ttl_ms))


def sequence_flags(events: DataFrame, ttl_ms: int | None) -> DataFrame:
    return _apply(events, SequenceCheck(ttl_ms))


def stream_segments(events: DataFrame, ttl_ms: int | None) -> DataFrame:
    """Segments from deltas; an ``audio_complete`` event drains what is left."""
    return _apply(events.filter("type IN ('llm_delta', 'audio_complete')"), SegmentCutter(ttl_ms))


def finished_once(turns: DataFrame, delay: str) -> DataFrame:
    """First row of each turn on a stream with ``event_time``; repeats within ``delay`` are left out."""
    return turns.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["session_id", "turn_id"])


def audit_sink(path: str):
    """``foreachBatch`` body that writes a micro-batch to a folder of its own (``epoch=N``).

    A repeated batch replaces its folder, and nothing written before is read. Turns that repeat across
    batches are left out upstream by :func:`finished_once` as far as its delay reaches; a table that knows
    its turns for good is :func:`talkweave.streaming.audittable.audit_table`.
    """
    from talkweave.operators.turns import audit_rows

    def write(batch: DataFrame, epoch: int) -> None:
        audit_rows(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write
