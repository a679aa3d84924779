"""The index as keyed state: batches against the batch merge, replays, layouts."""

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import index
from corpusmill.plans import changes, registry
from corpusmill.sources.shared import folders
from corpusmill.streaming import stateful


def event(path, ord, mtime=1.0, hash="h", gone=False, names=(), targets=()):
    return (path, ord, gone, 5, mtime, hash, [("function", n, f"def {n}", k) for k, n in enumerate(names)], [(t, False) for t in targets])


def run(spark, folder, layout=stateful.LAYOUT, **kw):
    checkpoint, before = stateful.opened(spark, f"{folder}/state", layout, **kw)
    stream = spark.readStream.schema(stateful.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/events")
    stateful.follow(stream, checkpoint, f"{folder}/changes-{layout}").awaitTermination()
    return checkpoint, before


def add(spark, folder, rows):
    spark.createDataFrame(rows, stateful.EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/events")


def held(spark, checkpoint):
    found = stateful.indexed(spark, checkpoint)
    files = {r.path: (r.mtime, r.hash, r.layout) for r in found["files"].collect()}
    return files, sorted((r.path, r.name) for r in found["symbols"].collect()), sorted((r.path, r.target) for r in found["imports"].collect())


def done(spark, folder, layout=stateful.LAYOUT):
    return {(r.path, r.ord): r.action for r in spark.read.parquet(f"{folder}/changes-{layout}").collect()}


def test_events_replace_symbols_and_imports_in_one_step(spark, tmp_path):
    folder = str(tmp_path)
    add(spark, folder, [event("a", 1, names=["f", "g"], targets=["x"]), event("b", 1, names=["h"]), event("c", 1)])
    checkpoint, before = run(spark, folder)
    assert before is None
    assert held(spark, checkpoint) == ({"a": (1.0, "h", 2), "b": (1.0, "h", 2), "c": (1.0, "h", 2)}, [("a", "f"), ("a", "g"), ("b", "h")], [("a", "x")])
    add(spark, folder, [event("a", 2, 2.0, "h2", names=["k"]), event("b", 2, 2.0), event("c", 2, gone=True), event("d", 3, 1.0, "h", names=["q"]), event("d", 4, 2.0, "h3"), event("e", 2, gone=True)])
    run(spark, folder)
    assert held(spark, checkpoint) == ({"a": (2.0, "h2", 2), "b": (2.0, "h", 2), "d": (2.0, "h3", 2)}, [("a", "k"), ("b", "h")], [])
    assert done(spark, folder) == {
        ("a", 1): "upsert", ("b", 1): "upsert", ("c", 1): "upsert", ("a", 2): "upsert", ("b", 2): "touch", ("c", 2): "delete", ("d", 3): "upsert", ("d", 4): "upsert", ("e", 2): "unchanged",
    }
    run(spark, folder)  # nothing new: nothing changes
    assert len(done(spark, folder)) == 9
    add(spark, folder, [event("a", 9, 2.0, "h2", names=["other"])])  # sent again
    run(spark, folder)
    assert done(spark, folder)["a", 9] == "unchanged"
    assert held(spark, checkpoint)[1] == [("a", "k"), ("b", "h")]


def test_another_layout_is_refused_or_built_anew(spark, tmp_path):
    folder = str(tmp_path)
    add(spark, folder, [event("a", 1, names=["f"]), event("b", 1)])
    old, _ = run(spark, folder, layout=1)
    with pytest.raises(ValueError, match="layout 1"):
        stateful.opened(spark, f"{folder}/state", rebuild=False)
    new, before = run(spark, folder)
    assert before == 1 and new != old and folders(spark, f"{folder}/state") == ["layout-2"]
    files, symbols, _ = held(spark, new)
    assert set(files) == {"a", "b"} and symbols == [("a", "f")]
    assert stateful.status(stateful.indexed(spark, new)["files"]).first().current
    assert not stateful.status(spark.createDataFrame([("a", 1, 1, 1.0, "h")], "path string, layout int, size long, mtime double, hash string")).first().current
    assert stateful.opened(spark, f"{folder}/state") == (new, 2)


def test_batches_of_documents_equal_the_batch_merge(spark, sf_dir):
    every = registry.files(spark, sf_dir)
    checkpoint, _ = changes._run_index(spark, sf_dir)
    state = None
    for events in changes.file_events(every):  # the scan that each batch stands for: what was there before, and its events
        last = events.groupBy("path").agg(F.max_by(F.struct("path", "size", "mtime", "hash", "gone"), "ord").alias("x")).select("x.*")
        scan = last.where("not gone").drop("gone")
        if state is not None:
            scan = scan.unionByName(state.join(last.select("path"), "path", "left_anti").select("path", "size", "mtime", "hash"))
            state = index.merged(scan, state)
        else:
            state = index.merged(scan, scan.where("false"))
    found = stateful.indexed(spark, checkpoint)["files"].select("path", "size", "mtime", "hash")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, state.select("path", "size", "mtime", "hash").collect()))


def test_batches_are_written_by_as_many_tasks_as_read_them(spark, sf_dir, monkeypatch):
    parts = []
    made = changes.file_events
    more = lambda every: [e.repartition(3) for e in made(every)]
    monkeypatch.setattr(changes, "file_events", more)
    follow = stateful.follow

    def followed(stream, *where):
        parts.append(len(spark.read.schema(stateful.EVENTS).option("recursiveFileLookup", True).parquet(where[1].replace("/changes", "/events")).inputFiles()))
        return follow(stream, *where)

    monkeypatch.setattr(stateful, "follow", followed)
    _, found = changes._run_index(spark, sf_dir)
    assert parts == [3, 6, 9]
    assert {r.ord for r in spark.read.parquet(found).select("ord").distinct().collect()} == {10, 20, 31, 32, 33}
