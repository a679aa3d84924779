"""Small cases with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text
from corpusmill.operators import index, rank, redact, runs, scan, search, select, slices, transcript
from corpusmill.sources.corpus import read_folder
from corpusmill.streaming import incremental


def test_tokens(spark):
    rows = spark.createDataFrame([("",), ("a",), ("x" * 7,), ("x" * 8,), (None,)], "t string")
    assert [r[0] for r in rows.select(text.tokens(F.col("t"))).collect()] == [0, 1, 2, 3, 0]


def test_truncate_and_lines(spark):
    rows = spark.createDataFrame([("abcdef\r\nx\n",)], "t string")
    got = rows.select(text.truncate(F.col("t"), 4), text.lines_of(F.col("t"))).first()
    assert got[0] == "abc…"
    assert got[1] == ["abcdef", "x"]


def test_globs(spark):
    paths = spark.createDataFrame([("a.ts",), ("x/a.ts",), ("x/y/a.ts",), ("x/a.js",)], "path string")
    hit = lambda g: sorted(r[0] for r in paths.where(text.matches_any(F.col("path"), [g])).collect())
    assert hit("**/*.ts") == ["a.ts", "x/a.ts", "x/y/a.ts"]
    assert hit("x/*.ts") == ["x/a.ts"]
    assert hit("x/*.{ts,js}") == ["x/a.js", "x/a.ts"]


def test_task_terms():
    got = rank.task_terms("Refactor src/auth/login.ts and src/auth/login.ts to improve LoginFlow LoginFlow.")
    assert got["path"] == ["src/auth/login.ts"]
    assert got["identifier"] == ["LoginFlow"]
    assert got["search"] == ["refactor", "src", "auth", "login", "ts", "improve", "flow"]
    assert not any(rank.task_terms("a an the to in by on").values())


def test_plain_search_words_weigh_twelve():
    assert rank.term_weights({"search": ["auth"]}) == {"auth": 12}


def test_scan_reasons_in_order(spark):
    files = spark.createDataFrame([("n/x.py", 9), ("b.png", 9), ("big.py", 99), ("k/big.py", 99), ("e/x.py", 9), ("ok.py", 9)], "path string, size long")
    got = scan.classify(files, 50, never=["n/**"], include=["k/**"], exclude=["e/**"], binary_endings=["png"])
    assert {r.path: r.reason for r in got.collect()} == {"n/x.py": "never", "b.png": "binary", "big.py": "size", "k/big.py": None, "e/x.py": "excluded", "ok.py": None}


def test_layered_ignore_rules(spark):
    files = spark.createDataFrame([("a/log/x.txt",), ("a/log/keep.txt",), ("b/x.txt",)], "path string")
    rules = spark.createDataFrame([(0, 0, "", "^a/log/.*$", False), (1, 0, "a", "^log/keep[.]txt$", True)], "layer int, ord int, base string, regex string, negated boolean")
    got = {r.path: r.ignored for r in scan.ignored(files, rules).collect()}
    assert got == {"a/log/x.txt": True, "a/log/keep.txt": False, "b/x.txt": False}


def test_incremental_plan(spark):
    scanned = spark.createDataFrame([("a", 1.0, "h"), ("b", 2.0, "h"), ("c", 2.0, "new"), ("d", 1.0, "h")], "path string, mtime double, hash string")
    state = spark.createDataFrame([("a", 1.0, "h"), ("b", 1.0, "h"), ("c", 1.0, "old"), ("e", 1.0, "h")], "path string, mtime double, hash string")
    got = {r.path: r.action for r in index.plan(scanned, state).collect()}
    assert got == {"a": "unchanged", "b": "touch", "c": "upsert", "d": "upsert", "e": "delete"}


def test_import_share(spark):
    scores = spark.createDataFrame([("m", 60.0)], "path string, raw double")
    edges = spark.createDataFrame([("m", "s"), ("m", "t"), ("m", "s"), ("m", "m")], "src string, dst string")
    assert sorted(tuple(r) for r in rank.import_boost(scores, edges).collect()) == [("s", 6.0), ("t", 6.0)]


def test_bias_with_tests(spark):
    changed = spark.createDataFrame([("src/login.ts",)], "path string")
    known = spark.createDataFrame([("src/login.test.ts", 1), ("src/login.ts", 1), ("src/app.ts", 1)], "path string, size long")
    edges = spark.createDataFrame([("src/app.ts", "src/login.ts")], "src string, dst string")
    tests = rank.test_candidates(changed).join(known.select(F.col("path").alias("test_path")), "test_path")
    got = {r.path: (r.boost, r.reasons, r.mode) for r in rank.change_bias(changed, edges, tests, known, review=True).collect()}
    assert got == {
        "src/login.ts": (260, "changed_file", "full"),
        "src/app.ts": (90, "imports_changed_file", None),
        "src/login.test.ts": (75, "tests_changed_module", None),
    }


def test_slices_merge_and_cap(spark):
    rows = spark.createDataFrame([("p", 1, 3), ("p", 4, 5), ("p", 10, 12), ("p", 14, 15), ("p", 30, 31)], "path string, first long, last long")
    merged = slices.merged(rows)
    assert sorted(tuple(r) for r in merged.collect()) == [("p", 1, 5), ("p", 10, 12), ("p", 14, 15), ("p", 30, 31)]
    assert sorted(tuple(r) for r in slices.capped(merged, 2).collect()) == [("p", 1, 15), ("p", 30, 31)]


def test_priority(spark):
    chosen = spark.createDataFrame([("src/main.ts", "core")], "path string, priority string")
    signals = spark.createDataFrame([("src/main.ts", False, False, False, 0, None)], "path string, explicit boolean, mentioned boolean, changed boolean, hits long, hops int")
    assert select.priority_scores(chosen, signals).first().score == 350


def test_ladder_stops_when_it_fits(spark):
    rows = spark.createDataFrame([("a", "full", 1, 500, 100), ("b", "full", 2, 600, 100)], "path string, mode string, score long, full_tokens long, slice_tokens long")
    got = [(r.step, r.path, r.total) for r in select.ladder(rows, 350).orderBy("ord").collect()]
    assert got == [("full_to_slices", "a", 700), ("full_to_slices", "b", 200)]


def test_search_context_and_snippet(spark):
    files = spark.createDataFrame([("a", "one\nTwo x\nthree\nx")], "path string, content string")
    got = [(r.line, r.col, r.before, r.after) for r in search.hits(files, "X", context=1).orderBy("line").collect()]
    assert got == [(2, 5, ["one"], ["three"]), (4, 1, ["three"], [])]
    assert search.snippet(files, "three", 1).first().text == "Two x\nthree\nx"
    assert search.hits(files, "^t", regex=True).count() == 2


def test_redaction(spark):
    key = "AKIA" + "ABCDEFGHIJKLMNOP"
    files = spark.createDataFrame([(f"{key} and a@b.cd, d41d8cd98f00b204e9800998ecf8427e",)], "content string")
    assert files.select(redact.redacted(F.col("content"))).first()[0] == "‹REDACTED:aws_access_key_id› and ‹REDACTED:email›, d41d8cd98f00b204e9800998ecf8427e"
    assert {r.category: r.spans for r in redact.counts(files).collect()} == {"api_key": 1, "email": 1}


def test_turn_gate(spark):
    rows = spark.createDataFrame([(1, 0, "ab"), (1, 1, "cd"), (1, 2, "ef")], "conv_id long, turn long, text string")
    assert [r.verdict for r in transcript.turn_gate(rows, 2, 100).orderBy("turn").collect()] == ["go", "last", "stop"]


def test_read_folder(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.py").write_text("print()\n")
    (tmp_path / "b.bin").write_bytes(b"a\x00b")
    got = {r.path: (r.size, r.language, r.binary, r.content) for r in read_folder(spark, str(tmp_path)).collect()}
    assert got == {"d/x.py": (8, "python", False, "print()\n"), "b.bin": (3, "text", True, None)}


def test_stream_of_scans(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", 1, 1.0, "h"), ("b", 1, 1.0, "h")], incremental.STATE).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(incremental.STATE).parquet(source)
    run = incremental.follow(stream, target).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert incremental.version(spark, target, 1).count() == 2


def test_a_missing_time_is_no_missing_file(spark):
    schema = "path string, size long, mtime double, hash string"
    scanned = spark.createDataFrame([("a", 1, None, "h"), ("b", 1, None, "new")], schema)
    old = spark.createDataFrame([("a", 1, 1.0, "h"), ("b", 1, None, "old"), ("c", 1, None, "h")], schema)
    assert {r.path: r.action for r in index.plan(scanned, old).collect()} == {"a": "touch", "b": "upsert", "c": "delete"}
    assert {r.path: r.hash for r in index.merged(scanned, old).collect()} == {"a": "h", "b": "new"}


def test_patches_without_hunks_count_by_their_header(spark):
    files = spark.createDataFrame([("renamed", 9, 7), ("big", 5, 0), ("small", 1, 7)], "path string, relevance long, header long")
    hunks = spark.createDataFrame([("big", 1, 14), ("big", 2, 700), ("small", 1, 7)], "path string, ord long, chars long")
    got = {r.path: (r.hunks, r.tokens) for r in select.patch_cap(files, hunks, 10, 9).collect()}
    assert got == {"renamed": (0, 2), "big": (1, 4)}


def test_ignore_rules():
    assert scan.ignore_regex("# x") is None and scan.ignore_regex("  ") is None
    assert scan.ignore_regex("!a/b") == ("^a/b(?:/.*)?$", True)
    assert scan.ignore_regex("build/") == ("^(?:.*/)?build/.*$", False)


def test_run_records_are_stored_and_read(spark, tmp_path):
    folder = f"{tmp_path}/runs"
    row = lambda run, n: (run, "task", 10, n, [("a", "full", "core", "r", 1, {"x": 1.0})], [], [])
    runs.persist(spark.createDataFrame([row("20240101T000000-a", 1), row("20240102T000000-b", 2)], runs.RECORD), folder)
    runs.persist(spark.createDataFrame([row("20240101T000000-a", 3)], runs.RECORD), folder)
    assert runs.read(spark, folder).first().run_id == "20240102T000000-b"
    assert [r.estimated for r in runs.read(spark, folder, "20240101T000000-a").collect()] == [3]
    with pytest.raises(ValueError, match="safe"):
        runs.persist(spark.createDataFrame([row("../x", 1)], runs.RECORD), folder)


def test_imprecise_intervals_meet_by_cells(spark):
    marks = spark.createDataFrame([("a", f"s{k}", k * 50 + 1, k * 50 + 49, "") for k in range(40)], "path string, name string, line long, last_line long, signature string")
    spans = spark.createDataFrame([("a", k * 50 + 10, k * 50 + 55) for k in range(39)], "path string, first long, last long")
    got = {r.first: (r.name, r.contained) for r in index.enclosing_ranges(spans, marks).collect()}
    assert got == {k * 50 + 10: (f"s{k}", False) for k in range(39)}


def test_empty_inputs(spark):
    files = spark.createDataFrame([], "path string, size long, hash string, language string, content string")
    assert scan.classify(files, 10, rules=scan.ignore_rules(files)).count() == 0
    assert rank.package_entrypoints(files).count() == 0
    assert redact.swept(files).count() == 0
    assert scan.capped_tree(files).count() == 0


def test_import_hops(spark):
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "d"), ("d", "e"), ("e", "f"), ("z", "z")]
    edges = spark.createDataFrame(links, "src string, dst string")
    at = lambda names: spark.createDataFrame([(n,) for n in names], "path string")
    hops = lambda *a, **k: {r.path: r.hops for r in rank.import_hops(*a, **k).collect()}
    assert hops(at("a"), edges) == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 4, "f": 5}
    assert hops(at("axx"), edges) == {"a": 0, "x": 0, "b": 1, "d": 1, "c": 2, "e": 2, "f": 3}
    assert hops(at("a"), edges, most=2) == {"a": 0, "b": 1, "c": 2}
    assert hops(at("a"), edges, wanted=["b", "a", "d", "q"]) == {"a": 0, "b": 1, "d": 3}
    assert hops(at("q"), edges, wanted=["b"]) == {}
    assert hops(at(""), edges) == {}


def test_base_scores_leave_out_files_without_a_term(spark):
    files = spark.createDataFrame([("a/handler.ts", "x", 1), ("b.ts", "a handler here", 2), ("c.ts", None, 3)], "path string, content string, size int")
    terms = rank.task_terms("handler")
    found = rank.base_scores(files, F.col("content"), terms)
    assert {r.path: (r.raw, r.hits) for r in found.collect()} == {"b.ts": (12.0, 1)}
    kept = rank.base_scores(files, F.coalesce("content", F.lit("")), terms, keep=("size",), unscored=True).collect()
    assert {r.path: (r.raw, r["size"]) for r in kept} == {"a/handler.ts": (0.0, 1), "b.ts": (12.0, 2), "c.ts": (0.0, 3)}
