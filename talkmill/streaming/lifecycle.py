"""The lifecycle as a stateful stream: a session falls idle or is ended by a hook, cools down and is confirmed, or comes back."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from talkmill.functions.fixed_values import COOLDOWN_HOURS, IDLE_MINUTES, TRANSITIONS
from talkmill.operators.store import session_id

OUT = "session_id string, state string, event string, at_ms long, work string"
NEXT = {(a, on): (b, effect) for a, on, b, effect in TRANSITIONS}
#: What transformWithState keeps its values and timers in.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SessionLife(StatefulProcessor):
    """A session's state, when it began, and one event-time timer for what is due next.

    Events of a batch are taken in order of time, and timers that are due between two of them fire there, so a replay
    gives the same changes whatever batches it comes in, but for events that come too late for the watermark. An illegal event changes nothing, and one that
    leaves the state as it is doesn't start its time anew, unless it is a message.
    """

    def __init__(self, idle_ms: int, cool_ms: int):
        self.idle_ms, self.cool_ms = idle_ms, cool_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("life", "state string, since_ms long")

    def due(self, state: str, since: int) -> tuple[str, int] | None:
        """The timer that runs in a state: its event and time."""
        return {"active": ("IDLE_TIMEOUT", since + self.idle_ms), "pending_end": ("COOLDOWN_ELAPSED", since + self.cool_ms)}.get(state)

    def advanced(self, key, state: str, since: int, until: int) -> tuple[str, int, list[Row]]:
        """The state after all timers that are due before ``until``, and their changes."""
        out = []
        while (timer := self.due(state, since)) and timer[1] < until:
            (state, effect), since = NEXT[state, timer[0]], timer[1]
            out.append(self.change(key, state, timer[0], since, effect))
        return state, since, out

    @staticmethod
    def change(key, state: str, event: str, at: int, effect: str | None) -> Row:
        # A confirmed session's messages are to be extracted.
        return Row(session_id=key[0], state=state, event=event, at_ms=at, work="extract" if effect == "confirm" else None)

    def keep(self, state: str, since: int, now: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if state == "deleted":
            self.held.clear()
            return
        self.held.update((state, since))
        if timer := self.due(state, since):
            self.handle.registerTimer(max(timer[1], now) + 1)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known, now = self.held.exists(), max(0, timerValues.getCurrentWatermarkInMs())
        state, since = tuple(self.held.get()) if known else ("active", None)
        out = []
        for at, event in sorted((r.at_ms, r.event) for r in rows):
            if since is not None:
                state, since, fired = self.advanced(key, state, since, at)
                out += fired
            if (state, event) in NEXT:
                before, (state, effect) = state, NEXT[state, event]
                out.append(self.change(key, state, event, at, effect))
                if state != before or effect in ("touch", "rollback"):
                    since = max(at, since or 0)
            since = at if since is None else since
        if since is not None:
            state, since, fired = self.advanced(key, state, since, now)
            out += fired
            self.keep(state, since, now)
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.held.exists():
            now = timerValues.getCurrentWatermarkInMs()
            state, since, out = self.advanced(key, *tuple(self.held.get()), now)
            self.keep(state, since, now)
            yield from out


def hook_events(lines: DataFrame, source: str) -> DataFrame:
    """(session_id, event, ts) of hook lines (line): ``{event, sid, ts}`` in JSON. Only ends of sessions count; bad lines give nothing."""
    m = F.from_json("line", "event string, sid string, ts string")
    told = lines.select(m.alias("m")).filter("m.event = 'session-end' and m.sid is not null")
    return told.select(session_id(F.lit(source), F.col("m.sid")).alias("session_id"), F.lit("END_SIGNAL").alias("event"), F.try_to_timestamp("m.ts").alias("ts")).filter("ts is not null")


def lifecycle(events: DataFrame, idle_minutes: int = IDLE_MINUTES, cooldown_hours: int = COOLDOWN_HOURS, late: str = "1 hour", hooks: DataFrame | None = None) -> DataFrame:
    """(session_id, state, event, at_ms, work): every change of state; ``work`` is ``extract`` where a session is confirmed.

    ``events`` streams (session_id, event, ts), and so does ``hooks``, a second input with a watermark of its own. Event time drives the
    timers; the watermark is ``late`` behind the slower input. A session's state is two values and a timer, in a RocksDB state store.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    inputs = [x.withWatermark("ts", late).selectExpr("session_id", "event", "unix_millis(ts) as at_ms", "ts") for x in (events, hooks) if x is not None]
    rows = inputs[0] if hooks is None else inputs[0].unionByName(inputs[1])
    life = SessionLife(idle_minutes * 60_000, cooldown_hours * 3_600_000)
    return rows.groupBy("session_id").transformWithState(life, OUT, "append", "EventTime")
