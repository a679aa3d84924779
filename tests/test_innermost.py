"""Scopes are read once for all parts of the sweep."""

from corpusmill.operators import scopes


def test_scopes_are_read_once(spark):
    code = spark.createDataFrame([("a", "python", "class A:\n    def f(self):\n        pass\n")], "path string, language string, content string")
    points = spark.createDataFrame([("a", 1), ("a", 3), ("a", 9)], "path string, at long")
    found = scopes.innermost(points, scopes.scopes(code))
    assert {(r.at, r.name) for r in found.collect()} == {(1, "A"), (3, "f"), (9, None)}
    plan = found._jdf.queryExecution().withCachedData().toString()
    assert "InMemoryRelation" in plan
