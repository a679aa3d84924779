"""The trigram index: what it must hold, what it reads, how it is updated."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import grams, search


@pytest.mark.parametrize(
    ("pattern", "expected"),
    [
        ("abc", ["abc"]), ("ab+cd", ["ab", "cd"]), ("ab*c", ["a", "c"]), ("a(bc)d", ["a", "d"]), ("a|b", []), (r"a\.b\w", ["a.b"]), ("x[a-z]y", ["x", "y"]), ("(?i)abc", []),
        ("ab{2}c", ["a", "c"]), ("^abc$", ["abc"]), ("[^]x]abc", ["abc"]), ("a[b[c]", []), ("th[ae]+ [a-z]*ing", ["th", " ", "ing"]), ("ab?", ["a"]), ("a((b)c)def", ["a", "def"]),
    ],
)
def test_literals(pattern, expected):
    assert grams.literals(pattern) == expected


def test_literals_are_in_every_match():
    r = random.Random(2)
    tokens = ["a", "b", "c", "[ab]", "(ab)", "(a|b)", "a+", "b*", "c?", r"\.", ".", "a{0,2}", "^", "$"]
    for _ in range(3000):
        pattern = "".join(r.choice(tokens) for _ in range(r.randrange(1, 7)))
        text = "".join(r.choice("abc.") for _ in range(12))
        if found := re.search(pattern, text):
            assert all(x in found.group() for x in grams.literals(pattern)), pattern


def test_equal_to_a_scan(spark, tmp_path, monkeypatch):
    r = random.Random(1)
    words = ["alpha", "Beta", "gamma", "delta.x", "épée", "İstanbul", "tion", "a b"]
    rows = [(f"p{k}", "\n".join(" ".join(r.choices(words, k=r.randrange(5))) for _ in range(r.randrange(6)))) for k in range(300)] + [("null", None), ("blank", ""), ("cr", "alpha\r\nBeta")]
    first = spark.createDataFrame(rows, "path string, content string").repartition(3)
    index = grams.GramIndex(spark, str(tmp_path / "i"), block=16)
    index.add(first)
    patterns = [("alpha", False, False), ("BETA", False, False), ("Beta", False, True), ("no such", False, False), ("al", False, False), ("épé", False, False), ("istan", False, False), ("a[a-z]+ta", True, True), ("gam+a delta", True, False), ("(x|y)", True, False)]

    def compare(of, at):
        for p, regex, case in patterns:
            expected = search.hits(of, p, regex, case, 1)
            assert sorted(map(tuple, at.hits(p, regex, case, 1).collect())) == sorted(map(tuple, expected.collect())), p

    compare(first, index)
    for most in (0, 200):  # candidates are joined, or pushed to the scan
        monkeypatch.setattr(grams, "MOST_RANGES", most)
        found = {x.path for x in index.candidates("gamma delta").collect()}
        assert found == {p for p, t in rows if t and all(g in t.lower() for g in grams.grams_of("gamma delta"))} and len(found) < 100
    changed = [(p, "alpha changed" if k % 2 else "nothing") for k, (p, _) in enumerate(rows[:50])] + [("new", "Beta gamma delta.x")]
    gone = spark.createDataFrame([(p,) for p, _ in rows[50:80]], "path string")
    index.add(spark.createDataFrame(changed, "path string, content string"), gone)
    now = spark.createDataFrame(changed + rows[80:], "path string, content string")
    compare(now, index)
    index.add(spark.createDataFrame([("p0", "alpha again"), ("new", "x")], "path string, content string"))
    now = spark.createDataFrame([("p0", "alpha again"), ("new", "x"), *changed[1:-1], *rows[80:]], "path string, content string")
    compare(now, index)
    compare(now, index.compacted(str(tmp_path / "j")))
    assert index.segments() == [1, 2, 3]


def test_only_pages_with_candidates_are_read(spark, tmp_path):
    rows = spark.range(0, 20_000, 1, 1).select(F.concat(F.lit("p"), "id").alias("path"), F.when(F.col("id") == 12_345, "the needle here").otherwise(F.sha2(F.col("id").cast("string"), 512)).alias("content"))
    index = grams.GramIndex(spark, str(tmp_path / "i"))
    index.add(rows)
    found = index.hits("needle")
    assert [r.path for r in found.collect()] == ["p12345"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,12345)" in plan


def test_blocks_of_several_tasks_and_each_text_taken_once(spark, tmp_path, monkeypatch):
    taken, made = spark.sparkContext.accumulator(0), grams._postings

    def counted(size):
        def f(frames):
            def each():
                for frame in frames:
                    taken.add(len(frame) if hasattr(frame, "columns") and not hasattr(frame, "num_rows") else frame.num_rows)
                    yield frame

            yield from made(size)(each())

        return f

    monkeypatch.setattr(grams, "_postings", counted)
    conf = {"spark.sql.files.maxPartitionBytes": "20k", "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k) for k in conf}
    hadoop = spark._jsc.hadoopConfiguration()
    hadoop.set("parquet.block.size", "10000")
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 2000, 1, 1).select(F.concat(F.lit("p"), "id").alias("path"), F.concat(F.sha2(F.col("id").cast("string"), 512), F.when(F.col("id") % 3 == 0, F.lit(" needle")).otherwise("")).alias("content"))
        index = grams.GramIndex(spark, str(tmp_path / "i"))
        index.add(rows)
        assert index._read("texts", 1).rdd.mapPartitions(lambda x: [any(True for _ in x)]).filter(bool).count() > 1
        assert taken.value == 2000
        assert index.hits("needle").count() == 667
    finally:
        hadoop.unset("parquet.block.size")
        for k, v in before.items():
            spark.conf.set(k, v)
