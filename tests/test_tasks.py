"""Many tasks at once against each task by itself."""

import pytest
from pyspark.sql import functions as F

from corpusmill.functions.text import base_name
from corpusmill.operators import rank, tasks
from corpusmill.plans import registry

TASKS = [
    (1, "Find that handler with ThingList from src/auth/login.ts"),
    (2, "aa aaa tion tions on"),
    (3, ""),
    (4, None),
    (5, "the of and"),
    (6, "Fix MAX_SIZE in ./util/index.ts and /api/users/{id}, config.value"),
    (7, "main main MAIN src1 model"),
]


@pytest.mark.parametrize("most", [256, 2])
def test_equal_to_one_task_at_a_time(spark, sf_dir, monkeypatch, most):
    monkeypatch.setattr(tasks, "MOST_TASKS", most)
    extra = spark.createDataFrame([("src/auth/login.ts", "aaaaaaa tions ThingList THINGLIST max_size İ"), ("aa/aaa", "aaaa"), ("null", None), ("tion/on", "")], "path string, content string")
    files = registry.files(spark, sf_dir).select("path", "content").unionByName(extra)
    text, entry = F.concat_ws("\n", "path", "content"), base_name(F.col("path")).startswith("main.")
    found = tasks.ranked(spark.createDataFrame(TASKS, "task_id long, text string"), files.repartition(3), text, entry, limit=40).collect()
    for task, words in TASKS:
        scores = rank.base_scores(files, text, rank.task_terms(words or ""), entry)
        expected = rank.finished(scores, limit=40).join(scores.select("path", "hits", "matched"), "path")
        assert sorted((r.path, r.raw, r.score, r.hits, r.matched) for r in found if r.task_id == task) == sorted((r.path, r.raw, r.score, r.hits, ",".join(r.matched)) for r in expected.collect()), task


def test_occurrences_do_not_overlap_themselves():
    automaton = tasks._automaton(["aa", "aaa", "aba", "b"])
    assert tasks._counts(automaton, "aaaaabababa") == {0: 2, 1: 1, 2: 2, 3: 3}


def test_no_tasks_and_no_files(spark):
    none = spark.createDataFrame([], "task_id string, text string")
    files = spark.createDataFrame([("a", "b")], "path string, content string")
    assert tasks.ranked(none, files, F.col("content")).collect() == []
    one = spark.createDataFrame([("x", "word")], "task_id string, text string")
    assert tasks.ranked(one, files.where("false"), F.col("content")).collect() == []
