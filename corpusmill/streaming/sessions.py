"""Editing sessions of a selection as a stream: events in order of time, limits, timers, snapshots.

A session's events are held back until the watermark has passed them, then taken by time and order, so that
events that come late, but within the watermark's delay, are judged as if they had come in time; later ones
are dropped by Spark. Each is judged as ``select.admitted`` judges requests: by itself first, then by what the session
holds, within caps on files, on full files and on turns. A session that is idle for some time ends: a timer
emits its snapshot and clears its state, and the next event begins a new one. Snapshots may be given as the
state that a later stream begins with.

A session is one key: its events are taken one after the other, which is what its caps are about;
its state is bounded by them, and by the events of the watermark's delay. Each read, write or timer of a session is
a call from its task to Spark's, and these calls are most of the work: a session has one value, read and written
once when events come and once when its timer ends, and one timer, at the first time at which there is something to do."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

EVENTS = "session string, ord long, ts timestamp, action string, path string, mode string, size long"
FOUND = "session string, kind string, ord long, at_ms long, turn int, path string, mode string, error string, held string"
#: What a later stream may begin with: a session, the time of its last event, its turns, and what it holds (as in FOUND).
SNAPSHOT = "session string, at_ms long, turn int, held string"
_ORDER, _MODES = ("ms", "ord"), ("full", "slices", "codemap_only")


@dataclass(frozen=True)
class Caps:
    files: int = 12
    full: int = 4
    bytes: int = 80_000
    turns: int = 200
    idle_ms: int = 1_800_000


def judged(held: dict[str, str], turn: int, action: str, path: str | None, mode: str | None, size: int | None, caps: Caps) -> str | None:
    """Applies an event to what a session holds; the error if it is refused."""
    if turn > caps.turns:
        return "TURN_LIMIT"
    if action == "clear":
        held.clear()
    elif action == "remove":
        if held.pop(path, None) is None:
            return "NOT_SELECTED"
    elif action != "add" or not (path or "").strip() or mode not in _MODES:
        return "INVALID_SELECTION_ENTRY"
    elif (size or 0) > caps.bytes:
        return "FILE_TOO_LARGE"
    elif path not in held and len(held) >= caps.files:
        return "MAX_FILES_EXCEEDED"
    elif sum(m == "full" for p, m in held.items() if p != path) + (mode == "full") > caps.full:
        return "MAX_FULL_FILES_EXCEEDED"
    else:
        held[path] = mode
    return None


class Sessions(StatefulProcessor):
    def __init__(self, caps: Caps):
        self.caps = caps

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # waiting: [ms, ord, action, path, mode, size] of each event held back.
        self.now = handle.getValueState("now", "held string, last_ms long, turn int, timer long, waiting string")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        due = initialState.at_ms + self.caps.idle_ms
        self.now.update((initialState.held, initialState.at_ms, initialState.turn, due, "[]"))
        self.handle.registerTimer(due)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        come = [(r.ms, r.ord, r.action, r.path, r.mode, r.size) for r in rows]
        held, last, turn, timer, waiting = self.now.get() or ("{}", None, 0, None, "[]")
        # Expired at once where the watermark has passed them already, else when it does.
        due = max(min(x[0] for x in come), timerValues.getCurrentWatermarkInMs() + 1)
        if timer is None or due < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timer := due)
        self.now.update((held, last, turn, timer, json.dumps(json.loads(waiting) + come)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        upto = timerValues.getCurrentWatermarkInMs()
        held, last, turn, _, waiting = self.now.get() or ("{}", None, 0, None, "[]")
        held, every = json.loads(held), sorted(json.loads(waiting), key=lambda x: (x[0], x[1]))
        ready, later = [x for x in every if x[0] <= upto], [x for x in every if x[0] > upto]
        row = lambda kind, ms, **more: Row(**{c.split()[0]: None for c in FOUND.split(", ")} | {"session": key[0], "kind": kind, "at_ms": ms, "turn": turn} | more)
        for ms, number, action, path, mode, size in ready:
            if last is not None and ms - last > self.caps.idle_ms:
                yield row("closed", last, held=json.dumps(held, sort_keys=True))
                held, turn = {}, 0
            last, turn = ms, turn + 1
            yield row("event", ms, ord=number, path=path, mode=mode, error=judged(held, turn, action, path, mode, size, self.caps))
        if last is not None and upto >= last + self.caps.idle_ms and not (later and later[0][0] - last <= self.caps.idle_ms):
            yield row("closed", last, held=json.dumps(held, sort_keys=True))
            held, last, turn = {}, None, 0
        dues = [x[0] for x in later[:1]] + ([] if last is None else [last + self.caps.idle_ms])
        if dues:
            self.now.update((json.dumps(held), last, turn, min(dues), json.dumps(later)))
            self.handle.registerTimer(min(dues))
        else:
            self.now.clear()


def sessions(events: DataFrame, caps: Caps = Caps(), delay: str = "1 hour", begun: DataFrame | None = None) -> DataFrame:
    """FOUND of a stream of EVENTS: a row for each event, and one for each session that ended,
    with what it held. ``begun`` (SNAPSHOT): sessions to go on with."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = events.withColumn("ms", F.unix_millis("ts")).withWatermark("ts", delay)
    first = None if begun is None else begun.groupBy("session")
    return timed.groupBy("session").transformWithState(Sessions(caps), FOUND, "Append", "EventTime", initialState=first)


def follow(found: DataFrame, checkpoint: str, path: str) -> StreamingQuery:
    """Appends all that there is to Parquet at ``path``."""
    return found.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
