"""Editing sessions as a stream: order, caps, timers, late events, snapshots."""

import datetime
import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.operators import select
from corpusmill.streaming import sessions

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
CAPS = sessions.Caps(files=2, full=1, bytes=50, turns=4, idle_ms=60_000)


def event(session, ord, second, action="add", path="a", mode="slices", size=1):
    return (session, ord, START + datetime.timedelta(seconds=second), action, path, mode, size)


def run(spark, tmp_path, batches, delay="30 seconds", begun=None, caps=CAPS):
    for k, rows in enumerate([*batches, [event("", 0, 10**9)]]):
        spark.createDataFrame(rows, sessions.EVENTS).coalesce(1).write.parquet(f"{tmp_path}/events/{k:03d}")
    stream = spark.readStream.schema(sessions.EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/events")
    sessions.follow(sessions.sessions(stream, caps, delay, begun), f"{tmp_path}/state", f"{tmp_path}/found").awaitTermination()
    return spark.read.parquet(f"{tmp_path}/found").where("session <> ''").collect()


def told(rows):
    return {r.ord: (r.turn, r.error) for r in rows if r.kind == "event"}


def ended(rows):
    return sorted((r.session, r.at_ms // 1000 - int(START.timestamp()), r.turn, r.held) for r in rows if r.kind == "closed")


def test_order_caps_and_idle_sessions(spark, tmp_path):
    rows = run(
        spark,
        tmp_path,
        [
            [event("s", 3, 20, path="b", mode="full"), event("s", 1, 0, mode="full"), event("t", 9, 5, action="remove")],
            [event("s", 2, 10, path="b"), event("s", 4, 25, path="c"), event("s", 5, 26), event("t", 10, 200, mode="odd"), event("t", 11, 201, size=99)],
            [event("s", 6, 120, path="c"), event("t", 12, 202, action="clear"), event("t", 13, 203, path=" ")],
        ],
        delay="10 minutes",
    )
    assert told(rows) == {
        1: (1, None), 2: (2, None), 3: (3, "MAX_FULL_FILES_EXCEEDED"), 4: (4, "MAX_FILES_EXCEEDED"), 5: (5, "TURN_LIMIT"), 6: (1, None),
        9: (1, "NOT_SELECTED"), 10: (1, "INVALID_SELECTION_ENTRY"), 11: (2, "FILE_TOO_LARGE"), 12: (3, None), 13: (4, "INVALID_SELECTION_ENTRY"),
    }
    assert ended(rows) == [("s", 26, 5, '{"a": "full", "b": "slices"}'), ("s", 120, 1, '{"c": "slices"}'), ("t", 5, 1, "{}"), ("t", 203, 4, "{}")]


def test_late_events_are_dropped_and_snapshots_go_on(spark, tmp_path):
    first = run(spark, tmp_path / "1", [[event("s", 1, 0), event("s", 2, 100, path="b")], [event("u", 3, 200)], [event("s", 4, 10, path="late"), event("s", 5, 190, path="c")]])
    assert told(first) == {1: (1, None), 2: (1, None), 3: (1, None), 5: (1, None)}
    assert ended(first) == [("s", 0, 1, '{"a": "slices"}'), ("s", 100, 1, '{"b": "slices"}'), ("s", 190, 1, '{"c": "slices"}'), ("u", 200, 1, '{"a": "slices"}')]
    begun = spark.createDataFrame([("s", int(START.timestamp() * 1000) + 190_000, 3, json.dumps({"c": "full"}))], sessions.SNAPSHOT)
    again = run(spark, tmp_path / "2", [[event("s", 6, 195, path="d", mode="full"), event("s", 7, 196, path="d")]], begun=begun)
    assert told(again) == {6: (4, "MAX_FULL_FILES_EXCEEDED"), 7: (5, "TURN_LIMIT")}
    assert ended(again) == [("s", 196, 5, '{"c": "full"}')]


@pytest.mark.parametrize("parts", [1, 3])
def test_admission_equals_the_batch(spark, sf_dir, tmp_path, parts):
    from corpusmill.plans import changes

    every = changes.edit_events(spark, sf_dir).where("action = 'add'")
    caps = sessions.Caps(files=3, full=1, bytes=60_000, turns=10**6, idle_ms=10**12)
    requests = every.select(F.xxhash64("session").alias("session"), F.rank().over(Window.orderBy("ts", "ord")).cast("long").alias("ord"), F.col("ord").alias("id"), "path", "mode", "size", F.lit(False).alias("never"), F.lit(False).alias("binary"))
    batch = select.admitted(requests, caps.files, caps.full, caps.bytes).join(requests.select("ord", "id"), "ord")
    expected = {r.id: r.error for r in batch.collect()}
    batches = [[tuple(r) for r in every.where(F.col("ord") % parts == k).collect()] for k in range(parts)]
    rows = run(spark, tmp_path, batches, delay="100 days", caps=caps)
    assert {r.ord: r.error for r in rows if r.kind == "event"} == expected


class Calls:
    """The value and the timers of one session; counts what is asked of them."""

    def __init__(self):
        self.n, self.value, self.timers = 0, None, set()

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.n += 1
        return self.value

    def update(self, value):
        self.n, self.value = self.n + 1, value

    def clear(self):
        self.n, self.value = self.n + 1, None

    def registerTimer(self, at):
        self.n += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.n += 1
        self.timers.remove(at)


def test_a_session_has_one_value_and_one_timer(spark):
    from types import SimpleNamespace

    of = lambda ord, ms: SimpleNamespace(ms=ms, ord=ord, action="add", path=f"p{ord}", mode="slices", size=1)
    at = lambda upto: SimpleNamespace(getCurrentWatermarkInMs=lambda: upto)
    calls, one = Calls(), sessions.Sessions(CAPS)
    one.init(calls)
    one.handleInputRows(("s",), iter([of(2, 5_000), of(3, 6_000)]), at(0))
    one.handleInputRows(("s",), iter([of(1, 4_000)]), at(0))
    one.handleInputRows(("s",), iter([of(4, 90_000)]), at(0))
    assert calls.timers == {4_000} and calls.n <= 10
    calls.n, calls.timers = 0, set()  # Spark deletes a timer that has ended
    rows = list(one.handleExpiredTimer(("s",), at(70_000), None))
    assert [(r.kind, r.ord, r.at_ms) for r in rows] == [("event", 1, 4_000), ("event", 2, 5_000), ("event", 3, 6_000), ("closed", None, 6_000)]
    assert calls.timers == {90_000} and calls.n == 3


def test_batches_are_of_as_many_files(spark, sf_dir, monkeypatch):
    from corpusmill.plans import changes

    found = []
    monkeypatch.setattr(changes, "FILE_ROWS", 2)

    def follow(stream, state, path):
        top = state.removesuffix("/state")
        found.extend(spark.read.option("recursiveFileLookup", True).parquet(f"{top}/events").inputFiles())
        raise InterruptedError

    monkeypatch.setattr(changes.sessions, "follow", follow)
    with pytest.raises(InterruptedError):
        changes._run_sessions(spark, sf_dir)
    each = {k: sum(f"/{k}/" in x for x in found) for k in {x.split("/")[-2] for x in found}}
    assert each.pop("99999") == 1 and len(set(each.values())) == 1 and max(each.values()) > 1
