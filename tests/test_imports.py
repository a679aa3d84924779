"""Imports and edges: candidates once for each base, edges of few files without all others."""

from corpusmill.operators import index
from corpusmill.plans import registry


def test_candidates_are_made_once_for_each_base(spark):
    raw = spark.createDataFrame([("x", "a"), ("y", "a"), ("y", "a"), ("y", "b"), ("z", "gone"), ("z", None), (None, "b")], "src_path string, base string")
    known = spark.createDataFrame([("a.py",), ("a.ts",), ("b/index.go",), ("b/index.go",)], "path string")
    found = index.resolve_imports(raw, known)
    assert sorted(map(str, found.collect())) == sorted(map(str, spark.createDataFrame([("x", "a", "a.ts"), ("y", "a", "a.ts"), ("y", "b", "b/index.go"), (None, "b", "b/index.go")], found.schema).collect()))
    made = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "posexplode" in x]
    assert made and not any("src_path" in x for x in made)


def test_edges_among_few_files(spark, sf_dir):
    every = registry.edges(spark, sf_dir)
    few = registry.files(spark, sf_dir).where("doc_id % 7 = 0").select("path")
    paths = {r.path for r in few.collect()}
    expected = sorted(tuple(r) for r in every.collect() if r.src in paths and r.dst in paths)
    found = registry.edges(spark, sf_dir, few)
    assert expected and sorted(map(tuple, found.collect())) == expected
