"""Stream operators that follow event time: rows wait until the watermark passes them, then act in order.

A row waits in its key's list; a timer at its time fires when no earlier row can come any more. So the
answer does not depend on how the input was split or shuffled, and equals the batch form's. What comes
after its time was passed is given back, marked as late. State is bounded by the rows inside the
watermark's delay and by the open turns of a session.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_EVENT = "at bigint, event_id bigint, turn_id string, type string, seq bigint, text string, generation_id string"
_FIELDS = ["at", "event_id", "turn_id", "type", "seq", "text", "generation_id"]


def _plain(value):
    """Missing values as None, numbers as Python's."""
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    return value.item() if hasattr(value, "item") else value


class InOrder(StatefulProcessor):
    """Hands a key's rows to :meth:`event` by (time, event id), each once the watermark has passed it.

    ``at`` is in microseconds. Subclasses answer with tuples of their ``schema`` without the last
    field, ``late``.
    """

    schema = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _EVENT)
        self.progress = handle.getValueState("progress", "passed_ms bigint")
        self.open()

    def open(self) -> None:
        """States of the subclass."""

    def begin(self, key: tuple, now_ms: int) -> None:
        """Before the rows of one release."""

    def event(self, key: tuple, e: tuple) -> Iterator[tuple]:
        raise NotImplementedError

    def end(self, key: tuple, now_ms: int) -> Iterator[tuple]:
        """After the rows of one release; may set a further timer."""
        return iter(())

    def late(self, key: tuple, e: tuple) -> tuple:
        raise NotImplementedError

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        names = [f.strip().split(" ")[0] for f in self.schema.split(",")]
        return pd.DataFrame(rows, columns=names).astype(object)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = self.progress.get()[0] if self.progress.exists() else -1
        fresh, late = [], []
        for frame in rows:
            for values in zip(*(frame[c].tolist() for c in _FIELDS)):
                e = tuple(map(_plain, values))
                if e[0] // 1000 < passed:
                    late.append((*self.late(key, e), True))
                else:
                    fresh.append(e)
        if fresh:
            self.waiting.appendList(fresh)
            self.handle.registerTimer(min(e[0] for e in fresh) // 1000)
        if late:
            yield self._frame(late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = [tuple(e) for e in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((e for e in held if e[0] // 1000 < now), key=lambda e: e[:2])
        rest = [e for e in held if e[0] // 1000 >= now]
        self.begin(key, now)
        out = [row for e in due for row in self.event(key, e)]
        out += self.end(key, now)
        if due:
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(min(e[0] for e in rest) // 1000)
            else:
                self.waiting.clear()
            self.progress.update((now,))
        if out:
            yield self._frame([(*row, False) for row in out])

    def close(self) -> None:
        pass


class SessionStates(InOrder):
    """State of a session after each of its events; the turns of the session lie in a map.

    A turn that saw no event for ``keep_ms`` is forgotten (None: never); a commit that comes later
    begins it anew.
    """

    schema = "session_id string, event_id bigint, type string, state string, late boolean"

    def __init__(self, keep_ms: int | None = None) -> None:
        self.keep_ms = keep_ms

    def open(self) -> None:
        self.turns = self.handle.getMapState("turns", "turn_id string", "active boolean, last_ms bigint")
        self.state = self.handle.getValueState("state", "state string")

    def begin(self, key, now_ms):
        self.now = self.state.get()[0] if self.state.exists() else "listening"

    def event(self, key, e):
        at, event_id, turn, kind, _, _, generation = e
        known = self.turns.containsKey((turn,))
        active = bool(self.turns.getValue((turn,))[0]) if known else False
        if kind == "turn_commit_request" and not known:
            known, active, self.now = True, True, "thinking"
        elif kind == "cancel" and active and generation in (None, f"g_{turn}"):
            active, self.now = False, "interrupted"
        elif kind == "llm_delta" and active:
            self.now = "speaking"
        elif kind == "audio_complete" and active:
            self.now = "listening"
        if known:
            self.turns.updateValue((turn,), (active, at // 1000))
        yield key[0], event_id, kind, self.now

    def end(self, key, now_ms):
        self.state.update((self.now,))
        if self.keep_ms is not None:
            for turn in [k[0] for k, v in self.turns.iterator() if v[1] + self.keep_ms < now_ms]:
                self.turns.removeKey((turn,))
        return iter(())

    def late(self, key, e):
        return key[0], e[1], e[3], None


class TurnTexts(InOrder):
    """Text, latencies and status of a turn, once the watermark is ``idle_ms`` past its last event.

    Deltas between the commit and an effective cancel count, in order of their numbers. As soon as
    ``rows_per_part`` deltas with consecutive numbers stand at the front they are passed on as a part,
    which is open and has no latency yet; the last part has both. A delta whose number lies in a part that
    was passed on is late.
    """

    schema = ("session_id string, turn_id string, part bigint, assistant_text string, llm_first_token_ms bigint, latency_ms_e2e bigint, "
              "status string, late boolean")

    def __init__(self, idle_ms: int, rows_per_part: int = 4096) -> None:
        self.idle_ms, self.rows_per_part = idle_ms, rows_per_part

    def open(self) -> None:
        self.turn = self.handle.getValueState("turn", "commit bigint, cancel bigint, first bigint, done bigint, last bigint, part bigint, next bigint")
        self.deltas = self.handle.getListState("deltas", "seq bigint, event_id bigint, text string")

    def begin(self, key, now_ms):
        self.t = list(self.turn.get()) if self.turn.exists() else [None, None, None, None, None, 0, None]
        self.held = [tuple(d) for d in self.deltas.get()] if self.deltas.exists() else []

    def event(self, key, e):
        at, event_id, turn, kind, seq, text, generation = e
        commit, cancel, first, done, _, part, after = self.t
        self.t[4] = at
        if kind == "turn_commit_request" and commit is None:
            self.t[0] = at
        elif commit is not None and cancel is None:
            if kind == "cancel" and generation in (None, f"g_{turn}"):
                self.t[1] = at
            elif kind == "audio_complete" and done is None:
                self.t[3] = at
            elif kind == "llm_delta":
                self.t[2] = at if first is None else first
                if after is not None and seq < after:
                    yield key[0], key[1], None, text, None, None, "late_delta"
                else:
                    self.held.append((seq, event_id, text))

    def _flush(self, key):
        self.held.sort()
        while len(self.held) > self.rows_per_part:
            front = self.held[:self.rows_per_part]
            begin = 0 if self.t[6] is None else self.t[6]
            numbers = sorted({s for s, _, _ in front})
            if numbers[0] != begin or numbers[-1] - begin + 1 != len(numbers) or self.held[self.rows_per_part][0] == front[-1][0]:
                return
            yield key[0], key[1], self.t[5], "".join(x or "" for _, _, x in front), self._ms(self.t[2]) or 0, None, "open"
            self.held = self.held[self.rows_per_part:]
            self.t[5], self.t[6] = self.t[5] + 1, front[-1][0] + 1

    def _ms(self, at):
        return None if at is None or self.t[0] is None else at // 1000 - self.t[0] // 1000

    def end(self, key, now_ms):
        if self.t[4] is None:
            return
        yield from self._flush(key)
        if self.t[4] // 1000 + self.idle_ms < now_ms:
            commit, cancel, first, done, _, part, _ = self.t
            if commit is not None:
                self.held.sort()
                parts = [self.held[i:i + self.rows_per_part] for i in range(0, len(self.held), self.rows_per_part)] or [[]]
                status = "ok" if done is not None else "cancelled" if cancel is not None else "open"
                for n, rows in enumerate(parts):
                    yield (key[0], key[1], part + n, "".join(x or "" for _, _, x in rows), self._ms(first) or 0,
                           self._ms(cancel if done is None else done), status)
            self.turn.clear()
            self.deltas.clear()
            return
        self.turn.update(tuple(self.t))
        if self.held:
            self.deltas.put(self.held)
        self.handle.registerTimer(self.t[4] // 1000 + self.idle_ms)

    def late(self, key, e):
        return key[0], key[1], None, e[5], None, None, "late"


class LatestTurn(InOrder):
    """Recognised texts with the turn the session had opened last; before any, their own turn."""

    schema = "session_id string, event_id bigint, type string, text string, turn_id string, late boolean"

    def __init__(self, opens: tuple[str, ...], results: tuple[str, ...]) -> None:
        self.opens, self.results = opens, results

    def open(self) -> None:
        self.latest = self.handle.getValueState("latest", "turn_id string")

    def begin(self, key, now_ms):
        self.turn = self.latest.get()[0] if self.latest.exists() else None

    def event(self, key, e):
        if e[3] in self.opens:
            self.turn = e[2]
        if e[3] in self.results:
            yield key[0], e[1], e[3], e[5], e[2] if self.turn is None else self.turn

    def end(self, key, now_ms):
        if self.turn is not None:
            self.latest.update((self.turn,))
        return iter(())

    def late(self, key, e):
        return key[0], e[1], e[3], e[5], None


class RunningSum(StatefulProcessor):
    """Running sum over rows that come window by window."""

    schema = "window_end timestamp, active bigint"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n = self.total.get()[0] if self.total.exists() else 0
        found = pd.concat(list(rows)).sort_values("window_end")
        found["active"] = found["change"].cumsum() + n
        self.total.update((int(found["active"].iloc[-1]),))
        yield found[["window_end", "active"]]

    def close(self) -> None:
        pass


def _ordered(events: DataFrame, keys: list[str], processor: InOrder, delay: str) -> DataFrame:
    """Events with their time as a number: rows behind the watermark reach the processor, which reports them."""
    marked = events.withWatermark("event_time", delay)
    have = set(events.columns)
    rows = marked.select("session_id", F.unix_micros("event_time").alias("at"), F.col("event_id").cast("bigint").alias("event_id"), "turn_id", "type",
                         F.col("seq").cast("bigint").alias("seq"), "text", (F.col("generation_id") if "generation_id" in have else F.lit(None)).cast("string").alias("generation_id"))
    return rows.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=processor.schema, outputMode="Append", timeMode="EventTime")


def session_states(events: DataFrame, delay: str = "1 minute", keep_ms: int | None = None) -> DataFrame:
    """Stream form of :func:`talkweave.operators.turns.session_state`, with late rows marked (``state`` null)."""
    return _ordered(events, ["session_id"], SessionStates(keep_ms), delay)


def turn_texts(events: DataFrame, idle_ms: int, delay: str = "1 minute", rows_per_part: int = 4096) -> DataFrame:
    """Stream form of :func:`talkweave.operators.turns.assemble_turn_text`; see :class:`TurnTexts`."""
    return _ordered(events, ["session_id", "turn_id"], TurnTexts(idle_ms, rows_per_part), delay)


def latest_turns(events: DataFrame, opens: tuple[str, ...] = ("audio_chunk",), results: tuple[str, ...] = ("asr_partial", "asr_final"),
                 delay: str = "1 minute") -> DataFrame:
    """Stream form of :func:`talkweave.operators.turns.asr_stamped`."""
    return _ordered(events, ["session_id"], LatestTurn(opens, results), delay)


def connection_gauge(changes: DataFrame, width: str = "1 minute", delay: str = "1 minute") -> DataFrame:
    """Open connections at the end of each window that saw a change (``event_time``, ``change``: +1 or -1).

    Windows add up their changes in all tasks; only one row a window reaches the running sum.
    """
    sums = changes.withWatermark("event_time", delay).groupBy(F.window("event_time", width).alias("w")).agg(F.sum("change").alias("change"))
    rows = sums.select(F.lit("all").alias("gauge"), F.col("w.end").alias("window_end"), "change")
    return rows.groupBy("gauge").transformWithStateInPandas(
        statefulProcessor=RunningSum(), outputStructType=RunningSum.schema, outputMode="Append", timeMode="None")
